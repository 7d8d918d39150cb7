import json

import pytest
from pyspark.sql import functions as F

from millrace.streaming import cdc

SCHEMA = "key long, op string, `table` string, lsn long, value double"


def write(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_upsert_stream_keeps_latest(spark, tmp_path):
    src = tmp_path / "in"
    write(src, [{"key": 1, "op": "c", "table": "t", "lsn": 1, "value": 1.0}, {"key": 2, "op": "c", "table": "t", "lsn": 2, "value": 2.0}])
    go = lambda: cdc.upsert_stream(spark.readStream.schema(SCHEMA).json(str(src)), str(tmp_path / "t"), ["key"], ["value"], str(tmp_path / "cp")).awaitTermination()
    go()
    write(src, [{"key": 1, "op": "u", "table": "t", "lsn": 3, "value": 9.0}, {"key": 2, "op": "d", "table": "t", "lsn": 4, "value": None}])
    go()  # resumes from the checkpoint
    assert [tuple(r) for r in cdc.latest_table(spark, str(tmp_path / "t")).collect()] == [(1, 9.0)]
    write(src, [{"key": 0, "op": "t", "table": "t", "lsn": 5, "value": None}, {"key": 7, "op": "r", "table": "t", "lsn": 6, "value": 7.0}])
    go()
    assert [tuple(r) for r in cdc.latest_table(spark, str(tmp_path / "t")).collect()] == [(7, 7.0)]


def test_fan_out(spark, tmp_path):
    src = tmp_path / "in"
    write(src, [{"key": i, "op": "d" if i % 2 else "u", "table": "t", "lsn": i, "value": 0.0} for i in range(10)])
    got = {}
    sinks = {n: (lambda df, n=n: got.__setitem__(n, df.count())) for n in ("gone", "all")}
    q = cdc.fan_out(spark.readStream.schema(SCHEMA).json(str(src)), [{"ops": ["d"], "to": ["gone"]}, {"to": ["all"]}], sinks, str(tmp_path / "cp"))
    q.awaitTermination()
    assert got == {"gone": 5, "all": 10}


def test_stream_dedup_needs_watermark_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    write(src, [{"id": i % 3, "ts": f"2024-01-01T00:0{i}:00"} for i in range(6)])
    s = spark.readStream.schema("id long, ts timestamp").json(str(src))
    with pytest.raises(ValueError):
        cdc.deduplicate(s, ["id"])
    q = cdc.deduplicate(s, ["id"], watermark=("ts", "1 hour")).writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dd").count() == 3
    batch = spark.read.schema("id long, ts timestamp").json(str(src))
    assert cdc.windowed_counts(batch, "ts", "2 minutes").count() == 3
    assert cdc.windowed_counts(batch, "ts", "2 minutes", session=True).first().n == 6


def test_envelope_round_trip_and_latest(spark):
    e = spark.createDataFrame([('{"id":1}', "c", 5)], "after string, op string, ts_ms long")
    assert cdc.parse(cdc.serialize(e)).select("after", "op", "ts_ms").first() == ('{"id":1}', "c", 5)
    assert "payload" in cdc.serialize(e, True).first().value
    log = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (2, "u", 3)], "key long, op string, lsn long")
    assert [r.key for r in cdc.latest(log, ["key"]).collect()] == [2]
    assert cdc.route(log.withColumn("table", F.lit("ab")), [{"tables": ["a*"], "ops": ["d"], "to": ["x"]}]).count() == 1
