"""Every registered query of the reference operators against its DuckDB SQL on sf0.001."""

import datetime
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.plans.all_queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v)) if v % 1 else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_pushdown_reaches_the_scan(spark):
    from millrace.sources.files import explain

    plan = explain(QUERIES["scan_range"](spark, D))
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_apply_ranks_in_an_order_of_its_own(spark):
    """A sort before the shuffle does not reach the window where blocks come from several executors."""
    plan = QUERIES["join_apply"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.splitlines() if "row_number()" in x and "Window " in x)
    assert "o_totalprice" in window and "DESC" in window


def _sketches_per_value(spark, name: str, value: str) -> list[str]:
    plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Aggregate" in x and "approx" in x and value in x.partition("functions=")[0]]


def test_agg_approx_keeps_sketches_per_status_only(spark):
    assert not _sketches_per_value(spark, "agg_approx", "o_custkey")


def test_agg_approx_judges_as_percentiles_do(spark, tmp_path):
    orders = [(s, i % k if k else None, None if s == "none" else float(v)) for s, k, m in (("a", 5, 1), ("b", 1, 7), (None, 3, 50), ("none", 0, 3)) for i, v in enumerate([1, 1, 2, 9, 9, 9, 9, 12, -4, 30][:m] * 3)]
    spark.createDataFrame(orders, "o_orderstatus string, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    o = spark.read.parquet(f"{tmp_path}/orders.parquet")
    want = o.groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", 0.5, 10000).alias("m"), F.percentile("o_totalprice", [0.45, 0.55]).alias("p")).selectExpr("o_orderstatus", "true as distinct_ok", "m between p[0] and p[1] as median_ok")
    got = QUERIES["agg_approx"](spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_agg_approx_distinct_keeps_sketches_per_flag_only(spark):
    assert not _sketches_per_value(spark, "agg_approx_distinct", "l_partkey")
