"""Queries for vector search, change data, DML rewrites, special joins and the query front ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import compat as C
from ..functions import vectors as V
from ..operators import relational as R
from ..operators import vector_search as S
from ..streaming import cdc
from . import frontends as Q
from .catalog import query, table

_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _first_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 0").first().embedding]


# --- 2.10 vectors
@query("vector_distances", f"""SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q0}), 6) AS l2, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 6) AS cos,
    round(-list_inner_product(embedding::DOUBLE[], {_Q0}), 6) AS ip, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6) AS l1,
    round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings""")
def vector_distances(spark, d):
    q, v = F.lit(_first_vector(spark, d)), F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(V.euclidean(v, q), 6).alias("l2"), F.round(V.cosine_distance(v, q), 6).alias("cos"), F.round(V.inner_product_distance(v, q), 6).alias("ip"), F.round(V.l1_norm(v), 6).alias("l1"), F.round(V.l2_norm(v), 6).alias("norm"))


@query("vector_manhattan", f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], {_Q0}), lambda p: abs(p[1] - p[2]))), 5) AS l1 FROM embeddings")
def vector_manhattan(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.manhattan(F.col("embedding"), F.lit(_first_vector(spark, d))), 5).alias("l1"))


@query("vector_hamming", "SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INT) AS h FROM events")
def vector_hamming(spark, d):
    return table(spark, d, "events").select("event_id", V.hamming(F.col("event_id"), F.col("user_id")).alias("h"))


@query("vector_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: power(x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 2)))), 6) AS n FROM embeddings")
def vector_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.l2_norm(V.normalize(F.col("embedding"))), 6).alias("n"))


for _k in (1, 10, 50, 100):

    @query(f"vector_topk_{_k}", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q0}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q0}), vec_id LIMIT {_k}")
    def vector_topk(spark, d, k=_k):
        return S.knn(table(spark, d, "embeddings"), "embedding", _first_vector(spark, d), k).withColumn("distance", F.round("distance", 6))


@query("vector_filtered", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 6) AS distance FROM embeddings WHERE label = 3 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q0}), vec_id LIMIT 7")
def vector_filtered(spark, d):
    return S.knn(table(spark, d, "embeddings"), "embedding", _first_vector(spark, d), 7, "cosine", where=F.col("label") == 3).withColumn("distance", F.round("distance", 6))


@query("vector_ivf_all_lists", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q0}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q0}), vec_id LIMIT 10")
def vector_ivf_all_lists(spark, d):
    ivf = S.InvertedLists(table(spark, d, "embeddings"), "embedding", lists=8, iterations=5)
    return ivf.search(_first_vector(spark, d), 10, probes=8).withColumn("distance", F.round("distance", 6))


def _recall(spark, d, found, k: int = 10):
    """(k, recall_ok): whether at least 0.9 of the true k nearest are among the rows found."""
    exact = S.knn(table(spark, d, "embeddings"), "embedding", _first_vector(spark, d), k).select("vec_id")
    return exact.join(found.select("vec_id").distinct().withColumn("hit", F.lit(1)), "vec_id", "left").agg(F.count("*").cast("int").alias("k"), (F.count("hit") >= 0.9 * k).alias("recall_ok"))


_RECALL = "SELECT 10 AS k, true AS recall_ok"


@query("vector_layered_graph", _RECALL)
def vector_layered_graph(spark, d):
    return _recall(spark, d, S.layered_graph_search(table(spark, d, "embeddings"), "embedding", [_first_vector(spark, d)], 10))


@query("vector_ivf_probes", _RECALL)
def vector_ivf_probes(spark, d):
    """Twelve of sixteen lists."""
    ivf = S.InvertedLists(table(spark, d, "embeddings"), "embedding", lists=16, iterations=5)
    return _recall(spark, d, ivf.search(_first_vector(spark, d), 10, probes=12))


@query("vector_scalar_quantizer", """WITH u AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM u GROUP BY i)
    SELECT vec_id, CAST(sum(CAST(floor((x - lo) / greatest(hi - lo, 1e-12) * 255) AS INT)) AS BIGINT) AS code_sum FROM u JOIN b USING (i) GROUP BY vec_id""")
def vector_scalar_quantizer(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.aggregate(S.ScalarQuantizer(e, "embedding").encode(F.col("embedding")), F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))


@query("vector_binary_quantizer", """WITH u AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT i, median(x) AS m FROM u GROUP BY i)
    SELECT vec_id, CAST(sum(CASE WHEN x > m THEN 1 ELSE 0 END) AS INT) AS ones FROM u JOIN b USING (i) GROUP BY vec_id""")
def vector_binary_quantizer(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.aggregate(S.BinaryQuantizer(e, "embedding").encode(F.col("embedding").cast("array<double>")), F.lit(0), lambda s, x: s + F.bit_count(x)).alias("ones"))


@query("vector_product_quantizer", _RECALL)
def vector_product_quantizer(spark, d):
    """The 100 nearest by code, ranked again by their vectors."""
    e = table(spark, d, "embeddings")
    pq, q = S.ProductQuantizer(e, "embedding", parts=16, centroids=32, iterations=5), _first_vector(spark, d)
    near = e.select("vec_id", "embedding", pq.distance(pq.encode(F.col("embedding")), q).alias("rough")).orderBy("rough", "vec_id").limit(100)
    return _recall(spark, d, S.knn(near, "embedding", q, 10))


# --- 2.11 change data
_LOG = "(SELECT user_id AS key, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, event_id AS lsn, event_id // 10 AS txn_id, epoch_us(ts) // 1000 AS ts_ms, event_type, value FROM events)"


def _log(spark, d):
    return cdc.change_log(table(spark, d, "events"))


@query("cdc_change_log", f"SELECT key, op, lsn, txn_id, ts_ms FROM {_LOG} l")
def cdc_change_log(spark, d):
    return _log(spark, d).select("key", "op", "lsn", "txn_id", "ts_ms")


@query("cdc_envelope", f"SELECT lsn, op, key FROM {_LOG} l")
def cdc_envelope(spark, d):
    log = _log(spark, d)
    text = log.select(F.to_json(F.struct(F.to_json(F.struct("key", "value")).alias("after"), "op", "ts_ms", F.struct(F.lit("demo").alias("connector"), "table", "lsn").alias("source"))).alias("value"))
    return cdc.parse(text).select(F.col("source.lsn").alias("lsn"), "op", F.get_json_object("after", "$.key").cast("long").alias("key"))


@query("cdc_deduplicate", f"SELECT key, op, lsn FROM {_LOG} l")
def cdc_deduplicate(spark, d):
    log = _log(spark, d)
    return cdc.deduplicate(log.union(log.filter("lsn % 3 = 0")), ["key", "lsn"], "ts_ms").select("key", "op", "lsn")


@query("cdc_latest", f"SELECT key, lsn, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM {_LOG} l) t WHERE n = 1 AND op <> 'd'")
def cdc_latest(spark, d):
    return cdc.latest(_log(spark, d), ["key"]).select("key", "lsn", "op")


@query("cdc_apply", f"""SELECT key, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM {_LOG} l) t WHERE n = 1 AND op <> 'd'
    UNION ALL SELECT c_custkey, round(c_acctbal, 4) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def cdc_apply(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return cdc.apply_changes(base, _log(spark, d), ["key"], ["key", "value"][1:]).select("key", F.round("value", 4).alias("value"))


@query("cdc_transform", f"SELECT key, lsn, value * 2 AS doubled FROM {_LOG} l WHERE op = 'u' AND value > 10")
def cdc_transform(spark, d):
    return cdc.transform(_log(spark, d), F.col("op") == "u", lambda x: x.withColumn("doubled", F.col("value") * 2), F.col("value") > 10).select("key", "lsn", "doubled")


@query("cdc_batches", f"SELECT op, (rn - 1) // 100 AS batch, count(*) AS n FROM (SELECT op, row_number() OVER (PARTITION BY op ORDER BY lsn) AS rn FROM {_LOG} l) t GROUP BY 1, 2")
def cdc_batches(spark, d):
    return cdc.batches(_log(spark, d), F.col("op"), 100, "lsn").groupBy("op", "batch").agg(F.count("*").alias("n"))


@query("cdc_route", f"SELECT destination, count(*) AS n FROM (SELECT 'audit' AS destination FROM {_LOG} l UNION ALL SELECT 'trash' FROM {_LOG} l WHERE op = 'd' UNION ALL SELECT 'search' FROM {_LOG} l WHERE op IN ('c', 'u')) t GROUP BY 1")
def cdc_route(spark, d):
    rules = [{"to": ["audit"]}, {"ops": ["d"], "tables": ["ev*"], "to": ["trash", "audit"]}, {"ops": ["c", "u"], "tables": ["events"], "to": ["search"]}, {"tables": ["other"], "to": ["none"]}]
    return cdc.route(_log(spark, d), rules).groupBy("destination").agg(F.count("*").alias("n"))


@query("window_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    return cdc.windowed_counts(table(spark, d, "events"), "ts", "1 day", keys=("event_type",)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# --- 2.12 DML and utility
@query("dml_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update(spark, d):
    return R.update(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"o_totalprice": F.col("o_totalprice") + 1}, F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def dml_delete(spark, d):
    return R.delete(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") > 100000).select("o_orderkey")


@query("dml_insert_select", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(s_suppkey AS INT), s_name, NULL FROM supplier")
def dml_insert_select(spark, d):
    return R.insert(table(spark, d, "nation"), table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name")))


@query("dml_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 0 FROM customer WHERE c_custkey % 10 = 0")
def dml_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    ten = c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0))
    return R.upsert(c, ten.union(ten.withColumn("c_custkey", F.col("c_custkey") + 1000000)), ["c_custkey"])


@query("dml_merge", """SELECT c_custkey, CASE WHEN n IS NULL THEN c_acctbal ELSE c_acctbal + n END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE coalesce(n, 0) <= 15""")
def dml_merge(spark, d):
    src = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return R.merge(c, src, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("s.n")}, F.col("s.n") > 15, insert_unmatched=False)


@query("as_of_version", "SELECT c_custkey FROM (SELECT c_custkey, c_custkey % 5 + 1 AS xmin, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 + 3 END AS xmax FROM customer) v WHERE xmin <= 3 AND (xmax IS NULL OR xmax > 3)")
def as_of_version(spark, d):
    v = table(spark, d, "customer").selectExpr("c_custkey", "c_custkey % 5 + 1 AS xmin", "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 + 3 END AS xmax")
    return R.as_of(v, 3)


@query("sequence_numbers", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) * 5 + 95 AS seq FROM customer")
def sequence_numbers(spark, d):
    return R.with_sequence(table(spark, d, "customer").select("c_custkey"), "seq", ["c_custkey"], 100, 5)


@query("foreign_key_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def foreign_key_orphans(spark, d):
    return R.orphans(table(spark, d, "orders"), table(spark, d, "customer").filter("c_custkey % 4 <> 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("analyze_table", "SELECT 'n_nationkey' AS \"column\", count(*) AS n, count(*) - count(n_nationkey) AS nulls FROM nation UNION ALL SELECT 'n_name', count(*), count(*) - count(n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(*) - count(n_regionkey) FROM nation")
def analyze_table(spark, d):
    return R.analyze(table(spark, d, "nation")).select("column", "n", "nulls")


# --- joins and exchange
@query("join_as_of", "SELECT e.event_id, max(b.event_id) AS r_event_id FROM events e LEFT JOIN events b ON b.user_id = e.user_id AND b.event_type = 'signup' AND b.event_id <= e.event_id WHERE e.event_type = 'purchase' GROUP BY 1")
def join_as_of(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    left = e.filter("event_type = 'purchase'")
    return R.as_of_join(left, e.filter("event_type = 'signup'"), ["user_id"], "event_id", ["event_id"]).select("event_id", "r_event_id")


@query("join_range", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 100 AND o_totalprice < p_retailprice * 100 + 50")
def join_range(spark, d):
    ranges = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + 50).alias("hi"))
    return R.range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "lo", "hi", 50.0).select("o_orderkey", "p_partkey")


@query("join_salted", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_salted(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.salted_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_name")


def _placed(df, key: str):
    """Rows and distinct keys per partition, and the partition's key bounds."""
    at = df.select(F.spark_partition_id().alias("p"), F.col(key).alias("key"))
    return at.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.min("key").alias("low"), F.max("key").alias("high"))


#: What holds of where each scheme puts the orders' lines.
_PLACED = {
    "single": "count(*) = 1",
    # each task that reads deals its rows in turn, so it adds at most one to the difference
    "round_robin": "max(n) - min(n) <= 0.01 * sum(n) + 1",
    "hash": "sum(keys) = max(all_keys)",
    "range": "sum(keys) = max(all_keys) and bool_and(apart)",
}
for _s, _holds in _PLACED.items():

    @query(f"exchange_{_s}", f"SELECT count(*) AS n, CAST({1 if _s == 'single' else 4} AS BIGINT) AS parts, true AS placed FROM lineitem")
    def exchange(spark, d, scheme=_s, holds=_holds):
        li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
        got = _placed(R.partition(li, scheme, 4, ["l_orderkey"]), "l_orderkey")
        if scheme == "range":  # the bounds of partitions do not overlap
            apart = F.expr("coalesce(low > lag(high) over (order by p), true)")
            got = got.withColumn("apart", apart)
        all_keys = li.agg(F.countDistinct("l_orderkey")).first()[0]
        return got.withColumn("all_keys", F.lit(all_keys)).agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.expr(holds).alias("placed"))


@query("exchange_bounds", "SELECT CAST(l_orderkey >= 100 AS INT) + CAST(l_orderkey >= 500 AS INT) + CAST(l_orderkey >= 1000 AS INT) AS p, count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY 1")
def exchange_bounds(spark, d):
    """Ranges of many lines take several partitions, so that a task reads some megabytes at most; their figures are put together."""
    li, bounds = table(spark, d, "lineitem").select("l_orderkey"), [100, 500, 1000]
    parts = R.parts_by_bounds(li, "l_orderkey", bounds, 2_000_000)
    ends = F.array(*[F.lit(sum(parts[: i + 1])) for i in range(len(parts))])
    got = _placed(R.partition_by_bounds(li, "l_orderkey", bounds, parts), "l_orderkey").withColumn("p", F.size(F.filter(ends, lambda end: F.col("p") >= end)))
    return got.groupBy("p").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


# --- 2.13 front ends
def _tables(spark, d):
    kv = table(spark, d, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.lit("string").alias("type"), F.col("c_name").alias("value"), F.lit(None).cast("timestamp").alias("expiry"))
    return {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer"), "nation": table(spark, d, "nation"), "region": table(spark, d, "region"), "kv": kv}


def _ask(name, text, oracle):
    query(name, oracle)(lambda spark, d: Q.translate(text, spark, _tables(spark, d)))


_ask("dialect_mysql", "SELECT `o_orderkey` FROM `orders` WHERE o_orderstatus != 'F' ORDER BY o_orderkey LIMIT 10, 20", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY 1 LIMIT 20 OFFSET 10")
_ask("document_find", 'db.orders.find({"o_totalprice": {"$gt": 200000, "$lte": 300000}, "o_orderstatus": {"$in": ["F", "O"]}}, {"o_orderkey": 1, "o_totalprice": 1})', "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_totalprice <= 300000 AND o_orderstatus IN ('F', 'O')")
_ask("document_or_regex", 'db.customer.find({"$or": [{"c_mktsegment": {"$regex": "^B"}}, {"c_acctbal": {"$lt": 0}}], "c_name": {"$exists": true}}, {"c_custkey": 1})', "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^B') OR c_acctbal < 0")
_ask("document_count", 'db.orders.count({"o_orderstatus": {"$ne": "F"}})', "SELECT count(*) AS count FROM orders WHERE o_orderstatus <> 'F'")
_ask("document_aggregate", 'db.orders.aggregate([{"$match": {"o_totalprice": {"$gte": 50000}}}, {"$group": {"_id": "$o_custkey", "n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}, {"$match": {"n": {"$gt": 5}}}, {"$sort": {"top": -1, "_id": 1}}, {"$limit": 30}])', "SELECT o_custkey AS _id, n, top FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice >= 50000 GROUP BY 1) t WHERE n > 5 ORDER BY top DESC, _id LIMIT 30")
_ask("document_lookup", 'db.region.aggregate([{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "ns"}}, {"$unwind": "$ns"}, {"$group": {"_id": "$r_name", "n": {"$count": {}}}}])', "SELECT r_name AS _id, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
_ask("kv_get", "GET cust:17", "SELECT c_name AS value FROM customer WHERE c_custkey = 17")
_ask("kv_mget", "MGET cust:1 cust:2 cust:none", "SELECT 'cust:' || c_custkey AS key, c_name AS value FROM customer WHERE c_custkey IN (1, 2)")
_ask("kv_keys", "KEYS cust:1?", "SELECT 'cust:' || c_custkey AS key FROM customer WHERE c_custkey BETWEEN 10 AND 19")
_ask("kv_dbsize", "DBSIZE", "SELECT count(*) AS n FROM customer")


@query("kv_incr", "SELECT 'cust:' || c_custkey AS key, CASE WHEN c_custkey = 5 THEN '42' ELSE c_name END AS value FROM customer")
def kv_incr(spark, d):
    return Q.run_kv(Q.run_kv(_tables(spark, d)["kv"], "SET cust:5 40"), "INCRBY cust:5 2").select("key", "value")


def _words(name, text, oracle):
    def run(spark, d):
        for n, df in _tables(spark, d).items():
            df.createOrReplaceTempView(n)
        return Q.ask(spark, text)

    query(name, oracle)(run)


_words("ask_count", "How many orders where o_totalprice greater than 200000?", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000")
_words("ask_group", "count customer by c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
_words("ask_measure", "average c_acctbal of customer by c_nationkey", "SELECT c_nationkey, avg(c_acctbal) AS value FROM customer GROUP BY 1")
_words("ask_top", "top 5 customer by c_acctbal", "SELECT * FROM customer ORDER BY c_acctbal DESC LIMIT 5")


@query("template_variables", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def template_variables(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(Q.bind("SELECT o_orderkey FROM orders WHERE o_totalprice > {{low}} AND o_orderstatus = {{ status }}"), args={"low": 300000, "status": "O"})


@query("feature_group", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def feature_group(spark, d):
    ids = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.features(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_mktsegment"], ids)


_U = "CAST(concat('0x', left(md5(concat('42:', c_custkey)), 8)) AS BIGINT) / 4294967296.0"


@query("dataset_split", f"SELECT c_custkey, CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM customer")
def dataset_split(spark, d):
    return R.split_by_hash(table(spark, d, "customer").select("c_custkey"), "c_custkey", {"train": 0.8, "validation": 0.1, "test": 0.1})


@query("data_partitions", "SELECT part, count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM (SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey) - 1 AS part FROM customer) t GROUP BY part")
def data_partitions(spark, d):
    from ..sources.files import row_numbered

    return row_numbered(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 7).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


@query("fn_compat", "SELECT c_custkey, CAST(strpos(c_name, '#') AS INT) AS p, trunc(c_acctbal) AS t, '{\"a\": 1}' LIKE '{%' AS j FROM customer")
def fn_compat(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", C.strpos(F.col("c_name"), F.lit("#")).cast("int").alias("p"), C.trunc_number(F.col("c_acctbal")).cast("double").alias("t"), (C.json_typeof(F.lit('{"a": 1}')) == "object").alias("j"))


@query("fn_to_char", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS t FROM orders")
def fn_to_char(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.to_char(F.col("o_orderdate"), "DD.MM.YYYY HH24:MI").alias("t"))


@query("fn_session", "SELECT vec_id, CAST(len(embedding) AS INT) AS dims, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def fn_session(spark, d):
    C.register(spark)
    return table(spark, d, "embeddings").selectExpr("vec_id", "vector_dims(CAST(embedding AS ARRAY<DOUBLE>)) AS dims", "round(vector_norm(CAST(embedding AS ARRAY<DOUBLE>)), 5) AS norm")


# --- 2.9 functions of the user
@query("udf_pandas", "SELECT c_custkey, c_acctbal * 2 + 1 AS y FROM customer")
def udf_pandas(spark, d):
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    known = C.Registry(spark)
    known.register_scalar("twice_and_one", twice, "double", 1)
    return table(spark, d, "customer").select("c_custkey", known.call("Twice_And_One", F.col("c_acctbal")).alias("y"))


@query("udaf_pandas", "SELECT c_nationkey, CAST(max(c_custkey) - min(c_custkey) AS DOUBLE) AS spread FROM customer GROUP BY 1")
def udaf_pandas(spark, d):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    known = C.Registry(spark)
    known.register_aggregate("spread_of", spread)
    return table(spark, d, "customer").groupBy("c_nationkey").agg(known.call("spread_of", F.col("c_custkey")).alias("spread"))


@query("udtf_rows", "SELECT c_custkey, unnest(string_split(c_name, '#')) AS word FROM customer")
def udtf_rows(spark, d):
    @F.udtf(returnType="word string")
    class Split:
        def eval(self, text: str, mark: str):
            for w in (text or "").split(mark):
                yield (w,)

    spark.udtf.register("split_rows", Split)
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, word FROM customer, LATERAL split_rows(c_name, '#')")


@query("window_sliding", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 day', ts) - to_days(CAST(unnest([0, 1]) AS INTEGER)) AS start FROM events) t GROUP BY 1")
def window_sliding(spark, d):
    return cdc.windowed_counts(table(spark, d, "events"), "ts", "2 days", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("copy_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def copy_csv(spark, d):
    """COPY TO and FROM by way of a shared folder: tab-separated text with \\N for null."""
    from ..sources.files import copy_from, copy_to

    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/copy_customer"
    copy_to(c, path)
    return copy_from(spark, path, "c_custkey long, c_name string, c_acctbal double")
