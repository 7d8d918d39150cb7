import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import compat as C
from millrace.functions import vectors as V
from millrace.operators import relational as R
from millrace.operators import vector_search as S
from millrace.operators.layered_graph import LayeredGraph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_update_delete_null_predicate(spark):
    t = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, v int")
    assert rows(R.update(t, {"v": F.col("v") + 1}, F.col("v") > 5)) == [(1, 11), (2, None), (3, 31)]
    assert [r[0] for r in R.delete(t, F.col("v") > 15).orderBy("id").collect()] == [1, 2]
    assert R.delete(t).count() == 0
    with pytest.raises(ValueError):
        R.update(t, {"nope": F.lit(1)})


def test_insert_pads_missing_columns(spark):
    t = spark.createDataFrame([(1, "a")], "id int, s string")
    assert rows(R.insert(t, spark.createDataFrame([(2,)], "id int"))) == [(1, "a"), (2, None)]


def test_merge(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, v int")
    s = spark.createDataFrame([(2, 5), (3, 99), (4, 7)], "id int, v int")
    got = R.merge(t, s, ["id"], {"v": F.col("t.v") + F.col("s.v")}, F.col("s.v") == 99)
    assert rows(got) == [(1, 10), (2, 25), (4, 7)]


def test_as_of_join_ties_and_missing(spark):
    a = spark.createDataFrame([("x", 5, "l1"), ("x", 1, "l2"), ("y", 9, "l3")], "k string, t int, n string")
    b = spark.createDataFrame([("x", 5, "r5"), ("x", 2, "r2")], "k string, t int, v string")
    got = {r.n: r.r_v for r in R.as_of_join(a, b, ["k"], "t", ["v"]).collect()}
    assert got == {"l1": "r5", "l2": None, "l3": None}


def test_sequence_is_gapless(spark):
    t = spark.range(1000).repartition(7).withColumnRenamed("id", "k")
    got = sorted((r.k, r.n) for r in R.with_sequence(t, "n", ["k"]).collect())
    assert got == [(k, k + 1) for k in range(1000)]


def test_null_keys_do_not_match(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    assert a.join(a.withColumnRenamed("v", "w"), "k").count() == 1


def test_vector_functions(spark):
    r = spark.range(1).select(V.euclidean(F.lit([0.0, 0.0]), F.lit([3.0, 4.0])).alias("d"), V.cosine_distance(F.lit([1.0, 0.0]), F.lit([0.0, 2.0])).alias("c"), V.manhattan(F.lit([1.0, 2.0]), F.lit([3.0, 0.0])).alias("m"), V.normalize(F.lit([0.0, 0.0])).alias("z"), V.hamming(F.lit(7), F.lit(4)).alias("h"), V.hamming_words(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(2))).alias("hw")).first()
    assert r.d == 5.0 and abs(r.c - 1) < 1e-9 and r.m == 4.0 and r.z == [0.0, 0.0] and r.h == 2 and r.hw == 1
    with pytest.raises(ValueError):
        V.distance("other", F.lit([1.0]), F.lit([1.0]))


def test_unit_vectors_nearest(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 1.0, 0.0]), (5, [1.0, 1.0, 1.0])], "vec_id int, v array<double>")
    assert [r.vec_id for r in S.knn(t, "v", [1.0, 0.0, 0.0], 3).collect()] == [1, 4, 2]
    assert S.knn(t, "v", [1.0, 0.0, 0.0], 9, where=F.col("vec_id") > 3).count() == 2


def test_layered_graph_recall_and_delete():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    g = LayeredGraph(x, m=8, ef=64)
    hit = 0
    for q in range(20):
        want = set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[:5].tolist())
        hit += len(want & {i for _, i in g.search(x[q], 5, 64)})
    assert hit >= 90
    assert g.delete(3) and not g.delete(3)
    assert 3 not in {i for _, i in g.search(x[3], 5, 64)}


def test_quantizers(spark):
    t = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(11)], "vec_id int, v array<double>")
    q = S.ScalarQuantizer(t, "v")
    r = t.filter("vec_id = 10").select(q.encode(F.col("v")).alias("c"), q.decode(q.encode(F.col("v"))).alias("d")).first()
    assert r.c == [255, 0] and abs(r.d[0] - 10) < 1e-9
    b = S.BinaryQuantizer(t, "v")
    assert t.filter("vec_id = 9").select(b.encode(F.col("v")).alias("c")).first().c == [1]


def test_compat_functions(spark):
    r = spark.range(1).select(C.strpos(F.lit("hello"), F.lit("l")).alias("p"), C.trunc_number(F.lit(-1.7)).alias("t"), C.json_typeof(F.lit("[1]")).alias("j"), C.json_path(F.lit('{"a":[5,6]}'), "a", 1).alias("x"), C.to_char(F.lit("2024-03-05 07:08:09").cast("timestamp_ntz"), "YYYY-MM-DD HH24:MI:SS").alias("c"), C.json_contains(F.lit('{"a":"b"}'), "a", "b").alias("k")).first()
    assert (r.p, r.t, r.j, r.x, r.c, r.k) == (3, -1, "array", "6", "2024-03-05 07:08:09", True)
    reg = C.Registry(spark)
    reg.register_scalar("Twice", lambda x: x * 2, "int", 1)
    assert spark.range(1).select(reg.call("TWICE", F.lit(4)).alias("x")).first().x == 8
    with pytest.raises(TypeError):
        reg.call("twice", F.lit(1), F.lit(2))


def test_split_is_stable(spark):
    t = spark.range(2000)
    a = {r.id: r.split for r in R.split_by_hash(t, "id", {"train": 0.8, "test": 0.2}).collect()}
    b = {r.id: r.split for r in R.split_by_hash(spark.range(3000).repartition(5), "id", {"train": 0.8, "test": 0.2}).collect()}
    assert all(b[k] == v for k, v in a.items()) and 0.75 < sum(v == "train" for v in a.values()) / 2000 < 0.85


def test_merge_raises_where_several_source_rows_match(spark):
    t = spark.createDataFrame([(1, 10.0)], "id int, v double")
    s = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0), (2, 1.5)], "id int, v double")
    with pytest.raises(Exception, match="several source rows"):
        R.merge(t, s, ["id"], {"v": F.col("s.v")}).collect()
    assert rows(R.merge(t, s.filter("id = 2"), ["id"], {"v": F.col("s.v")})) == [(1, 10.0), (2, 1.0), (2, 1.5)]


def test_as_of_join_null_keys_match_nothing(spark):
    a = spark.createDataFrame([(None, 5, "l1"), ("x", 5, "l2"), ("x", None, "l3")], "k string, t int, n string")
    b = spark.createDataFrame([(None, 1, "rn"), ("x", 1, "rx"), ("x", None, "r0")], "k string, t int, v string")
    assert {r.n: r.r_v for r in R.as_of_join(a, b, ["k"], "t", ["v"]).collect()} == {"l1": None, "l2": "rx", "l3": None}


def test_salted_join_keeps_the_rows_of_a_plain_join(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k int, v int")
    small = spark.createDataFrame([(1, "one"), (3, "three"), (3, "drei"), (-5, "none"), (None, "null")], "k int, s string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = R.salted_join(big, small, ["k"], how=how)
        assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, ["k"], how).collect()))
    with pytest.raises(ValueError):
        R.salted_join(big, small, ["k"], how="full")


def test_sequences_are_gapless_over_many_partitions(spark):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        wide = spark.range(400_000, numPartitions=7).select((F.col("id") * 7919 % 400_009).alias("k"), F.repeat(F.lit("x"), 40).alias("pad"))
        got = R.with_sequence(wide, "seq", ["k"], 1, 1).select("k", "seq")
        want = got.selectExpr("count(*) n", "count(distinct seq) d", "min(seq) lo", "max(seq) hi").first()
        assert tuple(want) == (400_000, 400_000, 1, 400_000)
        assert got.selectExpr("seq - lag(seq) over (order by k) as step").filter("step <> 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    names = spark.createDataFrame([(x,) for x in ["b", None, "", "a", "zz", "é", "aa"]], "s string")
    assert [r.s for r in R.with_sequence(names, "n", ["s"]).orderBy("n").collect()] == [None, "", "a", "aa", "b", "zz", "é"]


def test_range_join_gives_a_ranges_points_in_one_run(spark):
    points = [(i, None if i == 7 else (i * 37 % 400) / 4 - 10) for i in range(300)]
    ranges = [(i, *[(0.0, 20.0), (-0.0, 20.0), (-9.5, -3.0), (5.0, 5.0), (30.0, 12.0), (None, 4.0), (11.0, 80.0)][i % 7]) for i in range(70)]
    a, b = spark.createDataFrame(points, "p int, v double"), spark.createDataFrame(ranges, "r int, lo double, hi double")
    got = [(r.p, r.r) for r in R.range_join(a, b, "v", "lo", "hi", 10.0).collect()]
    assert sorted(got) == sorted((p, r) for p, v in points for r, lo, hi in ranges if None not in (v, lo, hi) and lo <= v < hi)
    lists = {}
    for p, r in got:
        lists.setdefault(r, []).append(p)
    assert sum(x[1] != y[1] for x, y in zip(got, got[1:])) == len(lists) - 1
    assert all(lists[r] == lists[r % 7] for r in lists)


def test_ranges_of_many_rows_take_several_partitions(spark):
    t = spark.range(10_000).selectExpr("case when id % 1000 = 999 then null else id - 50 end as k")
    parts = R.parts_by_bounds(t, "k", [20_000, 0, 100], 1000)
    assert parts == [1, 1, 10, 1]
    got = R.partition_by_bounds(t, "k", [20_000, 0, 100], parts).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.countDistinct("k").alias("keys")).collect()
    assert max(r.n for r in got) <= 1100 and sum(r.n for r in got) == 10_000 and sum(r.keys for r in got) == 9990
    assert all((r.p == 0 and r.high < 0) or (r.p == 1 and 0 <= r.low and r.high < 100) or (2 <= r.p < 12 and r.low >= 100) for r in got)


def test_exchange_bounds_of_many_lines_reads_little_per_task(spark, tmp_path):
    from millrace.plans.all_queries import QUERIES

    spark.range(5_000_000).selectExpr("id div 4 as l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["exchange_bounds"](spark, str(tmp_path))
    assert rows(df) == [(0, 400, 0, 99), (1, 1600, 100, 499), (2, 2000, 500, 999), (3, 4_996_000, 1000, 1_249_999)]
    assert "REPARTITION_BY_NUM" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ", 6)" in plan
