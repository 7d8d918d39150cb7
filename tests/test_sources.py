import json

import pytest

from millrace.sources import files, foreign


def test_copy_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    files.copy_to(t, str(tmp_path / "c"))
    assert sorted(map(tuple, files.copy_from(spark, str(tmp_path / "c"), "id int, s string").collect())) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("codec", ["none", "lz4", "snappy", "zstd"])
def test_codecs(spark, tmp_path, codec):
    files.write_table(spark.range(100), str(tmp_path / codec), codec, sort_by=["id"])
    assert files.read_table(spark, str(tmp_path / codec), ["id"], "id >= 90").count() == 10


def test_compact(spark, tmp_path):
    spark.range(1000).repartition(20).write.parquet(str(tmp_path / "a"))
    assert files.compact(spark, str(tmp_path / "a"), str(tmp_path / "b")) == 1
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1000


def test_documents_source(spark, tmp_path):
    foreign.register(spark)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text("\n".join(json.dumps({"id": i, "name": f"n{i}", "x": i / 2 if i else None}) for i in range(10)))
    df = spark.read.format("documents").load(str(tmp_path / "d"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "x": "double"}
    assert df.filter("id > 6 and name is not null").count() == 3 and df.filter("x is null").count() == 1
    df.filter("id < 4").write.format("documents").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("documents").load(str(tmp_path / "out")).count() == 4


def test_keyvalue_source(spark, tmp_path):
    foreign.register(spark)
    p = tmp_path / "kv.json"
    p.write_text('{"key": "a:1", "value": "x"}\n{"key": "b:1", "value": {"f": 1}}\n')
    df = spark.read.format("keyvalue").load(str(p))
    assert sorted(map(tuple, df.collect())) == [("a:1", "string", "x"), ("b:1", "hash", '{"f": 1}')]
    assert df.filter("key like 'b:%'").count() == 1


def test_query_builder():
    Q = foreign.Qual
    sql, args = foreign.build_select("t", ["a"], [Q("a", "=", 1), Q("b", "in", [2, 3]), Q("c", "is null")], 5)
    assert sql == 'SELECT "a" FROM "t" WHERE "a" = $1 AND "b" IN ($2, $3) AND "c" IS NULL LIMIT 5' and args == [1, 2, 3]
    assert foreign.build_select('x"y', [], [Q("a", "<", 1)], style="question")[0] == 'SELECT * FROM `x"y` WHERE `a` < ?'
    with pytest.raises(ValueError):
        foreign.build_select("t", [], [Q("a", "; drop", 1)])
    pushed, local, share = foreign.plan_quals([Q("a", "=", 1), Q("b", "<>", 2)])
    assert len(pushed) == 1 and len(local) == 1 and share == 0.1
    assert foreign.plan_limit(5, 2, False) == 7 and foreign.plan_limit(5, 2, True) is None
    assert foreign.plan_join(("s", "s"), "left") and not foreign.plan_join(("s", "t"), "inner")


def test_catalog_views(spark):
    spark.range(3).createOrReplaceTempView("some_view")
    assert files.catalog_tables(spark).filter("table_name = 'some_view'").count() == 1
    assert files.catalog_columns(spark).filter("table_name = 'some_view' and column_name = 'id'").count() == 1
