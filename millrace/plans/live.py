"""Queries that run as streams, and those of sources, catalogs, functions and commands that need a session's state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import compat as C
from ..operators import relational as R
from ..sources import files, foreign
from ..streaming import cdc
from . import frontends as Q
from .catalog import query, table
from .extended import _LOG, _ask, _log, _tables, _words


def _folder(spark, name: str) -> str:
    """A new folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/live/{name}-{uuid.uuid4().hex}"


def _events(spark, d):
    """The events as a stream of files."""
    kinds = table(spark, d, "events").schema
    return spark.readStream.schema(kinds).parquet(f"{d}/events*.parquet")


def _ended(stream, name: str, mode: str = "append"):
    """All that the stream gives for what is there now, as a table."""
    spark, at = stream.sparkSession, _folder(stream.sparkSession, name)

    def write(batch, _id):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    w = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state")
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


# --- streams
@query("st_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_tumbling(spark, d):
    got = _ended(cdc.windowed_counts(_events(spark, d), "ts", "1 day", keys=("event_type",)), "tumbling", "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("st_session", """SELECT min(ts) AS start, count(*) AS n, user_id FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '1 day' THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s""")
def st_session(spark, d):
    got = _ended(cdc.windowed_counts(_events(spark, d), "ts", "1 day", session=True, keys=("user_id",)), "session", "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "user_id")


@query("st_deduplicate", "SELECT DISTINCT user_id, event_type FROM events")
def st_deduplicate(spark, d):
    at = F.col("ts").cast("timestamp").alias("at")
    got = cdc.deduplicate(_events(spark, d).select("user_id", "event_type", at), ["user_id", "event_type"], watermark=("at", "10000 days"))
    return _ended(got, "dedup").select("user_id", "event_type")


@query("st_filter", "SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'purchase' AND value > 10")
def st_filter(spark, d):
    steps = F.col("event_type") == "purchase", lambda x: x.select("event_id", "value", (F.col("value") * 2).alias("doubled")), F.col("value") > 10
    return _ended(cdc.transform(_events(spark, d), *steps), "filter").select("event_id", "doubled")


@query("st_upsert", f"SELECT key, lsn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM {_LOG} l) t WHERE n = 1 AND op <> 'd'")
def st_upsert(spark, d):
    at = _folder(spark, "upsert")
    cdc.upsert_stream(cdc.change_log(_events(spark, d)), f"{at}/t", ["key"], ["lsn"], f"{at}/state", buckets=8).awaitTermination()
    return cdc.latest_table(spark, f"{at}/t")


@query("st_route", f"SELECT 'trash' AS destination, lsn FROM {_LOG} l WHERE op = 'd' UNION ALL SELECT 'search', lsn FROM {_LOG} l WHERE op IN ('c', 'u')")
def st_route(spark, d):
    at = _folder(spark, "route")
    rules = [{"ops": ["d"], "tables": ["ev*"], "to": ["trash"]}, {"ops": ["c", "u"], "to": ["search"]}]
    sinks = {n: (lambda df, n=n: df.select("lsn").write.mode("append").parquet(f"{at}/{n}")) for n in ("trash", "search")}
    cdc.fan_out(cdc.change_log(_events(spark, d)), rules, sinks, f"{at}/state").awaitTermination()
    trash, search = (spark.read.schema("lsn long").parquet(f"{at}/{n}").select(F.lit(n).alias("destination"), "lsn") for n in ("trash", "search"))
    return trash.unionAll(search)


@query("cdc_truncate", f"SELECT key, lsn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM {_LOG} l WHERE lsn > 100) t WHERE n = 1 AND op <> 'd'")
def cdc_truncate(spark, d):
    log = _log(spark, d).select("key", F.when(F.col("lsn") == 100, "t").when((F.col("op") == "c") & (F.col("lsn") % 2 == 0), "r").otherwise(F.col("op")).alias("op"), "lsn")
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("lsn"))
    return cdc.apply_changes(base, log, ["key"], ["lsn"])


# --- sources and catalogs
@query("datasource_pushdown", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def datasource_pushdown(spark, d):
    """Written and read as documents; the filters run in the reader."""
    foreign.register(spark)
    at, nation = _folder(spark, "nations"), table(spark, d, "nation")
    nation.write.format("documents").mode("append").save(at)
    got = spark.read.format("documents").schema(nation.schema).load(at)
    return got.filter("n_regionkey = 2 and n_nationkey > 5").select("n_nationkey", "n_name")


@query("table_write_sorted", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def table_write_sorted(spark, d):
    at = _folder(spark, "orders")
    files.write_table(table(spark, d, "orders"), at, "zstd", sort_by=["o_orderkey"])
    return files.read_table(spark, at, ["o_orderkey", "o_totalprice"], "o_orderkey between 100 and 200")


@query("table_compact", "SELECT c_custkey, c_name FROM customer")
def table_compact(spark, d):
    many, few = _folder(spark, "many"), _folder(spark, "few")
    files.write_table(table(spark, d, "customer").select("c_custkey", "c_name").repartition(8), many, "snappy")
    files.compact(spark, many, few)
    return spark.read.parquet(few)


@query("info_schema_columns", """SELECT * FROM (VALUES ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3),
    ('region', 'r_regionkey', 1), ('region', 'r_name', 2)) t(table_name, column_name, ordinal_position)""")
def info_schema_columns(spark, d):
    for name in ("nation", "region"):
        table(spark, d, name).createOrReplaceTempView(name)
    return files.catalog_columns(spark).filter("table_name in ('nation', 'region')").select("table_name", "column_name", "ordinal_position")


@query("explain_pushdown", "SELECT true AS pushed, true AS pruned")
def explain_pushdown(spark, d):
    plan = files.explain(table(spark, d, "orders").filter("o_orderkey = 7").select("o_totalprice"))
    return spark.createDataFrame([("EqualTo(o_orderkey,7)" in plan, "o_orderpriority" not in plan)], "pushed boolean, pruned boolean")


@query("fdw_text", """SELECT * FROM (VALUES ('select', 'SELECT "a" FROM "t" WHERE "b" >= $1 LIMIT 5'), ('insert', 'INSERT INTO "t" ("a", "b") VALUES ($1, $2), ($3, $4)'),
    ('update', 'UPDATE "t" SET "a" = $1 WHERE "b" = $2 AND "c" IN ($3, $4)'), ('delete', 'DELETE FROM `t` WHERE `b` IS NULL'), ('schema', '`a` DECIMAL(10,2) NOT NULL, `b` STRING')) t(kind, text)""")
def fdw_text(spark, d):
    Qual = foreign.Qual
    rows = [
        ("select", foreign.build_select("t", ["a"], [Qual("b", ">=", 1)], 5)[0]),
        ("insert", foreign.build_insert("t", ["a", "b"], [(1, 2), (3, 4)])[0]),
        ("update", foreign.build_update("t", {"a": 1}, [Qual("b", "=", 2), Qual("c", "in", [3, 4])])[0]),
        ("delete", foreign.build_delete("t", [Qual("b", "is null")], "question")[0]),
        ("schema", foreign.import_schema([("t", "a", "numeric(10, 2)", False), ("t", "b", "jsonb", True), ("u", "x", "int", True)], only=["t"])["t"]),
    ]
    return spark.createDataFrame(rows, "kind string, text string")


# --- functions
@query("agg_approx", "SELECT o_orderstatus, true AS distinct_ok, true AS median_ok FROM orders GROUP BY 1")
def agg_approx(spark, d):
    """Sketches against exact values: distinct counts to 10 %, the median between the exact percentiles beside it."""
    # apart from the distinct count, which in one aggregation with them would keep sketches for every customer
    o = table(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_totalprice")
    sketches = o.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.percentile_approx("o_totalprice", 0.5, 10000).alias("m"))
    exact = o.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("e"))
    # the estimate is one of the values, so its ranks tell whether it lies between interpolated percentiles; one row per status is broadcast
    known = sketches.join(exact.withColumnRenamed("o_orderstatus", "_s"), F.expr("o_orderstatus <=> _s")).withColumnRenamed("o_orderstatus", "_status")
    x, m, n = F.col("o_totalprice"), F.col("m"), F.col("n")
    ranks = o.join(F.broadcast(known), F.expr("o_orderstatus <=> _status")).groupBy("o_orderstatus", "a", "e", "m").agg(F.count(x).alias("n"), F.count_if(x < m).alias("below"), F.count_if(x <= m).alias("upto"))
    ok = F.when(n > 0, (F.col("upto") > F.ceil((n - 1) * 0.45)) & (F.col("below") <= F.floor((n - 1) * 0.55)))
    return ranks.select("o_orderstatus", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e") + 1).alias("distinct_ok"), ok.alias("median_ok"))


_JSON = "CASE n_nationkey % 6 WHEN 0 THEN '{\"a\": 1}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '\"s\"' WHEN 3 THEN 'true' WHEN 4 THEN 'null' ELSE '1.5' END"


@query("fn_json_typeof", f"SELECT n_nationkey, CASE json_type({_JSON}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM nation")
def fn_json_typeof(spark, d):
    return table(spark, d, "nation").select("n_nationkey", C.json_typeof(F.expr(_JSON)).alias("kind"))


@query("fn_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.k') = '7', false) AS seven FROM events")
def fn_json_path(spark, d):
    return table(spark, d, "events").select("event_id", C.json_path(F.col("props"), "k").alias("k"), C.json_contains(F.col("props"), "k", "7").alias("seven"))


@query("fn_to_timestamp", "SELECT o_orderkey, date_trunc('minute', o_orderdate) AS t, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS days FROM orders")
def fn_to_timestamp(spark, d):
    at = F.col("o_orderdate")
    text = C.to_char(at, "YYYY/MM/DD HH24:MI")
    days = F.extract(F.lit("DAY"), C.age(at, F.expr("timestamp_ntz'1990-01-01'"))).cast("long")
    return table(spark, d, "orders").select("o_orderkey", C.to_timestamp(text, "YYYY/MM/DD HH24:MI").cast("timestamp_ntz").alias("t"), days.alias("days"))


@query("udf_scalar", "SELECT c_custkey, c_name || '!' AS y FROM customer")
def udf_scalar(spark, d):
    known = C.Registry(spark)
    known.register_scalar("shout", lambda x: None if x is None else x + "!", "string", 1)
    return table(spark, d, "customer").select("c_custkey", known.call("SHOUT", F.col("c_name")).alias("y"))


@query("top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 2")
def top_per_group(spark, d):
    return R.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


# --- documents, keys and questions
_ask("document_insert", 'db.region.insertMany([{"r_regionkey": 90, "r_name": "NEW"}, {"r_regionkey": 91}])', "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (90, 'NEW'), (91, NULL)")
_ask("document_update", 'db.region.updateMany({"r_regionkey": {"$gte": 3}}, {"$set": {"r_name": "HIGH"}})', "SELECT r_regionkey, CASE WHEN r_regionkey >= 3 THEN 'HIGH' ELSE r_name END AS r_name FROM region")
_ask("document_delete", 'db.nation.deleteMany({"n_regionkey": {"$in": [1, 2]}})', "SELECT * FROM nation WHERE n_regionkey NOT IN (1, 2)")


def _commands(name: str, oracle: str, *commands: str) -> None:
    """Commands one after another; all but the last write."""

    def run(spark, d):
        kv = _tables(spark, d)["kv"]
        for c in commands:
            kv = Q.run_kv(kv, c)
        return kv

    query(name, oracle)(run)


_commands("kv_hash", "SELECT * FROM (VALUES ('a', '3'), ('b', '2')) t(field, value)", "HSET h a 1", "HSET h b 2", "HSET h a 3", "HGETALL h")
_commands("kv_hget", "SELECT '2' AS value", "HSET h a 1", "HSET h b 2", "HGET h b")
_commands("kv_list", "SELECT * FROM (VALUES (0, 'w'), (1, 'x'), (2, 'y')) t(pos, value)", "RPUSH l x y z", "LPUSH l w", "LRANGE l 0 -2")
_commands("kv_llen", "SELECT 3 AS n", "RPUSH l x y", "LPUSH l w", "LLEN l")
_commands("kv_set_members", "SELECT * FROM (VALUES ('a'), ('b')) t(value)", "SADD s a a b", "SADD s b", "SMEMBERS s")
_commands("kv_scard", "SELECT 2 AS n", "SADD s a a b", "SCARD s")
_commands("kv_exists", "SELECT CAST(2 AS BIGINT) AS n", "EXISTS cust:1 cust:2 cust:none")
_commands("kv_type", "SELECT 'list' AS type", "RPUSH l x", "TYPE l")
_commands("kv_ttl", "SELECT CAST(-1 AS BIGINT) AS ttl", "TTL cust:1")
_commands("kv_decr", "SELECT '4' AS value", "SET n 5", "DECR n", "GET n")
_commands("kv_del", "SELECT count(*) - 2 AS n FROM customer", "DEL cust:1 cust:2", "DBSIZE")
_commands("kv_flush", "SELECT CAST(0 AS BIGINT) AS n", "FLUSHDB", "DBSIZE")
_commands("kv_expire", "SELECT count(*) - 1 AS n FROM customer", "EXPIRE cust:3 -1", "DBSIZE")
_words("ask_list", "show customer where c_acctbal at least 5000 and c_nationkey is 3", "SELECT * FROM customer WHERE c_acctbal >= 5000 AND c_nationkey = 3")
_words("ask_maximum", "what is the maximum o_totalprice of orders", "SELECT max(o_totalprice) AS value FROM orders")
