"""Change data: envelope, deduplication, latest state, batching, routing; batch and Structured Streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = {"c": "insert", "u": "update", "d": "delete", "t": "truncate", "s": "schema", "r": "snapshot"}
ENVELOPE = """before string, after string, op string, ts_ms long,
  source struct<connector: string, db: string, schema: string, `table`: string, lsn: long, file: string, pos: long>,
  transaction struct<id: string, total_order: long>"""


def parse(df: DataFrame, column: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """Envelope columns from JSON text; before and after stay JSON."""
    return df.select(F.from_json(F.col(column).cast("string"), ENVELOPE, {"mode": mode}).alias("e")).select("e.*")


def serialize(df: DataFrame, with_schema: bool = False) -> DataFrame:
    """(value): the envelope as JSON, with its schema beside it on request."""
    body = F.struct(*df.columns)
    if not with_schema:
        return df.select(F.to_json(body).alias("value"))
    return df.select(F.to_json(F.struct(F.lit(df.schema.json()).alias("schema"), body.alias("payload"))).alias("value"))


def transform(df: DataFrame, *steps) -> DataFrame:
    """A chain of filters (Columns) and maps (functions of a DataFrame)."""
    for s in steps:
        df = df.filter(s) if isinstance(s, Column) else df.transform(s)
    return df


def deduplicate(df: DataFrame, keys: list[str], order: str | None = None, watermark: tuple[str, str] | None = None) -> DataFrame:
    """One event per key: the first by `order` in batch, within the watermark in a stream."""
    if df.isStreaming:
        if watermark is None:
            raise ValueError("a stream needs a watermark, else its state grows without bound")
        return df.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    if order is None:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest(df: DataFrame, keys: list[str], order: str = "lsn", keep_deleted: bool = False) -> DataFrame:
    """The last event of each key by a map-side aggregation; keys whose last event deletes them go."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*")
    return out if keep_deleted else out.filter("op <> 'd'")


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: str = "lsn") -> DataFrame:
    """The table after the changes: last event per key wins.  A truncate event (t) empties the table and voids the
    events before it, a snapshot event (r) is an insert, a schema event (s) changes no row."""
    cut = changes.agg(F.max(F.when(F.col("op") == "t", F.col(order)))).first()[0]
    if cut is not None:
        target, changes = target.limit(0), changes.filter(F.col(order) > F.lit(cut))
    last = latest(changes.filter("op not in ('s', 't')"), keys, order, keep_deleted=True)
    kept = target.join(last.select(*keys), keys, "left_anti").select(*keys, *columns)
    return kept.unionByName(last.filter("op <> 'd'").select(*keys, *columns))


def batches(df: DataFrame, key: Column, size: int, order: str) -> DataFrame:
    """Batch number of each event per key: at most `size` events each."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("batch", ((n - 1) / size).cast("long"))


def route(df: DataFrame, rules: list[dict], table: str = "table", op: str = "op") -> DataFrame:
    """A row per event and destination.  A rule: {"ops": [...] or None, "tables": [patterns], "to": [...]};
    a pattern is a name, `prefix*` or `*`."""
    hits = []
    for r in rules:
        pats = r.get("tables") or ["*"]
        t = F.lit(False)
        for p in pats:
            t = t | (F.lit(True) if p == "*" else F.col(table).startswith(p[:-1]) if p.endswith("*") else F.col(table) == p)
        o = F.lit(True) if not r.get("ops") else F.col(op).isin(*r["ops"])
        hits.append(F.when(t & o, F.array(*[F.lit(x) for x in r["to"]])).otherwise(F.array().cast("array<string>")))
    return df.withColumn("destination", F.explode(F.array_distinct(F.flatten(F.array(*hits)))))


def fan_out(stream: DataFrame, rules: list[dict], sinks: dict, checkpoint: str, table: str = "table", op: str = "op", trigger: dict | None = None):
    """Start a stream that writes each event to its destinations; `sinks` maps names to functions of a batch."""

    def write(batch: DataFrame, _id: int) -> None:
        routed = route(batch, rules, table, op).persist()
        for name, sink in sinks.items():
            sink(routed.filter(F.col("destination") == name).drop("destination"))
        routed.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upsert_stream(stream: DataFrame, path: str, keys: list[str], columns: list[str], checkpoint: str, order: str = "lsn", buckets: int = 64):
    """Keep a table of the latest rows, in `buckets` folders by key hash: a micro-batch rewrites the folders of its
    keys only.  The new folders are staged first, so that a batch that is run again after a failure ends the same;
    applying a batch twice changes nothing.  A truncate event rewrites all.  Read it with `latest_table`."""
    data = f"{path}/data"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path
        fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        empty = spark.createDataFrame([], batch.schema).select(*keys, *columns)
        if batch.filter("op = 't'").isEmpty():
            touched = [r.b for r in batch.filter("op <> 's'").select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
        else:
            touched = list(range(buckets))
        stage = f"{path}/_stage/{batch_id}"
        if not fs.exists(at(f"{stage}/_SUCCESS")):
            old = latest_table(spark, path, empty.schema).filter(bucket.isin(touched)) if fs.exists(at(data)) else empty
            new = apply_changes(old, batch, keys, columns, order).withColumn("_b", bucket)
            new.write.mode("overwrite").partitionBy("_b").parquet(stage)
        for b in touched:
            fs.delete(at(f"{data}/_b={b}"), True)
            if fs.exists(at(f"{stage}/_b={b}")):
                copy = spark._jvm.org.apache.hadoop.fs.FileUtil.copy
                fs.mkdirs(at(data))
                copy(fs, at(f"{stage}/_b={b}"), fs, at(f"{data}/_b={b}"), False, spark._jsc.hadoopConfiguration())
        fs.delete(at(f"{path}/_stage/{batch_id - 1}"), True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_table(spark, path: str, schema=None) -> DataFrame:
    """The rows that `upsert_stream` keeps."""
    read = spark.read if schema is None else spark.read.schema(schema)
    return read.option("basePath", f"{path}/data").parquet(f"{path}/data").drop("_b")


def windowed_counts(df: DataFrame, ts: str, window: str, slide: str | None = None, session: bool = False, late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per tumbling, sliding or session window, with a watermark for late events."""
    at = F.col(ts).cast("timestamp")
    df = df.withColumn("_ts", at).withWatermark("_ts", late)
    w = F.session_window("_ts", window) if session else F.window("_ts", window, slide)
    out = df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def change_log(events: DataFrame) -> DataFrame:
    """The events table read as changes of a table keyed by user: signup inserts, error deletes, others update."""
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return events.select(
        F.col("user_id").alias("key"), op.alias("op"), F.lit("events").alias("table"), F.col("event_id").alias("lsn"), F.expr("event_id div 10").alias("txn_id"),
        (F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts_ms"), "event_type", "value",
    )
