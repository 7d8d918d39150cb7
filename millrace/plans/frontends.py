"""Query front ends: dialect detection, MySQL text, document queries, key-value commands, questions in words.

Document and key-value queries become DataFrame plans, never SQL text, so values cannot inject anything.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KV_COMMANDS = ("GET", "SET", "DEL", "MGET", "EXISTS", "INCR", "DECR", "INCRBY", "HGET", "HSET", "HGETALL", "LPUSH", "RPUSH", "LRANGE", "LLEN", "SADD", "SMEMBERS", "SCARD", "KEYS", "TYPE", "TTL", "EXPIRE", "PING", "DBSIZE", "FLUSHDB", "INFO")
_MYSQL = re.compile(r"`|\bAUTO_INCREMENT\b|\bENGINE\s*=|\bENUM\s*\(|\bUNSIGNED\b|\bLIMIT\s+\d+\s*,\s*\d+|\bSHOW\s+(TABLES|DATABASES)\b", re.I)


def detect(query: str) -> str:
    """redis, mongodb, mysql or postgresql."""
    word = query.strip().split(None, 1)[0].upper() if query.strip() else ""
    if word in KV_COMMANDS and not re.match(r"SET\s+\w+\s*=", query.strip(), re.I):
        return "redis"
    if re.match(r"\s*db\.\w+\.\w+\(", query) or re.match(r'\s*\{\s*"(find|aggregate|count)"', query):
        return "mongodb"
    return "mysql" if _MYSQL.search(query) else "postgresql"


def from_mysql(query: str) -> str:
    """Spark SQL for MySQL text; string literals are left as they are, an ENUM becomes text with its literals gone."""
    literal = r"'(?:[^'\\]|\\.|'')*'"
    enum = re.compile(rf"({literal})|\bENUM\s*\(\s*{literal}(?:\s*,\s*{literal})*\s*\)", re.I)
    query = enum.sub(lambda m: m[1] or "VARCHAR(50)", query)
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", query)
    for i in range(0, len(parts), 2):
        p = parts[i]
        p = re.sub(r"\bLIMIT\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", p, flags=re.I)
        p = re.sub(r"\s+AUTO_INCREMENT\b|\s+UNSIGNED\b|\s*ENGINE\s*=\s*\w+|\s*DEFAULT\s+CHARSET\s*=\s*\w+", "", p, flags=re.I)
        p = re.sub(r"\bDATETIME\b", "TIMESTAMP", p, flags=re.I)
        p = re.sub(r"\b(TINYTEXT|MEDIUMTEXT|LONGTEXT|TEXT)\b", "STRING", p, flags=re.I)
        p = re.sub(r"\bMEDIUMINT\b", "INT", p, flags=re.I)
        parts[i] = p.replace("||", " OR ").replace("&&", " AND ")
    return "".join(parts)


# --- document queries
_COMPARE = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def document_filter(spec: dict) -> Column:
    """A document filter as a predicate; unknown operators raise."""
    out = F.lit(True)
    for key, want in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts = [document_filter(s) for s in want]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "$and" else joined | p
            out = out & (~joined if key == "$nor" else joined)
            continue
        col = F.col(key)
        for op, v in (want.items() if isinstance(want, dict) else [("$eq", want)]):
            if op in _COMPARE:
                test = col.isNull() if v is None and op == "$eq" else col.isNotNull() if v is None and op == "$ne" else _COMPARE[op](col, F.lit(v))
            elif op in ("$in", "$nin"):
                test = col.isin(*v) if op == "$in" else ~col.isin(*v)
            elif op == "$regex":
                test = col.rlike(v)
            elif op == "$exists":
                test = col.isNotNull() if v else col.isNull()
            else:
                raise ValueError(f"unsupported operator {op}")
            out = out & test
    return out


def find(df: DataFrame, spec: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
    out = df.filter(document_filter(spec)) if spec else df
    if sort:
        out = out.orderBy(*[F.col(k).asc_nulls_first() if v > 0 else F.col(k).desc_nulls_last() for k, v in sort.items()])
    out = out.offset(skip) if skip else out
    out = out.limit(limit) if limit else out
    if projection:
        on = [k for k, v in projection.items() if v]
        out = out.select(*on) if on else out.drop(*projection)
    return out


_ACCUMULATE = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$push": F.collect_list, "$addToSet": F.collect_set}


def _value(e) -> Column:
    return F.col(e[1:]) if isinstance(e, str) and e.startswith("$") else F.lit(e)


def aggregate(df: DataFrame, stages: list[dict], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Stages in their order: $match $project $addFields $group $sort $skip $limit $unwind $lookup $count."""
    for stage in stages:
        (op, arg), *_ = stage.items()
        if op == "$match":
            df = df.filter(document_filter(arg))
        elif op == "$project":
            df = find(df, projection=arg) if all(v in (0, 1, True, False) for v in arg.values()) else df.select(*[F.col(k) if v == 1 else _value(v).alias(k) for k, v in arg.items()])
        elif op == "$addFields":
            df = df.withColumns({k: _value(v) for k, v in arg.items()})
        elif op == "$group":
            ident = arg["_id"]
            keys = [] if ident is None else [_value(v).alias(k) for k, v in ident.items()] if isinstance(ident, dict) else [_value(ident).alias("_id")]
            aggs = []
            for name, acc in arg.items():
                if name != "_id":
                    (f, e), *_ = acc.items()
                    aggs.append((F.count("*") if f == "$count" else _ACCUMULATE[f](_value(e))).alias(name))
            df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        elif op == "$sort":
            df = find(df, sort=arg)
        elif op == "$skip":
            df = df.offset(arg)
        elif op == "$limit":
            df = df.limit(arg)
        elif op == "$unwind":
            c = arg["path"] if isinstance(arg, dict) else arg
            df = df.withColumn(c[1:], F.explode(c[1:]))
        elif op == "$lookup":
            other = (tables or {})[arg["from"]]
            many = other.groupBy(F.col(arg["foreignField"]).alias("_fk")).agg(F.collect_list(F.struct(*other.columns)).alias(arg["as"]))
            df = df.join(many, F.col(arg["localField"]) == F.col("_fk"), "left").drop("_fk")
        elif op == "$count":
            df = df.agg(F.count("*").alias(arg))
        else:
            raise ValueError(f"unsupported stage {op}")
    return df


def run_document(query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """db.<table>.find({...}, {...}), findOne, count, countDocuments, aggregate([...]); insertOne, insertMany,
    updateMany and deleteMany return the table after them."""
    m = re.match(r"\s*db\.(\w+)\.(\w+)\((.*)\)\s*;?\s*\Z", query, re.S)
    if not m:
        raise ValueError("expected db.<collection>.<operation>(...)")
    df, args = tables[m[1]], json.loads(f"[{m[3]}]")
    if m[2] == "aggregate":
        return aggregate(df, args[0], tables)
    if m[2] in ("insertOne", "insertMany"):
        docs = args[0] if m[2] == "insertMany" else args[:1]
        extra = sorted({k for x in docs for k in x} - set(df.columns))
        if extra:
            raise ValueError(f"the table has no columns {extra}")
        text = df.sparkSession.createDataFrame([(json.dumps(x),) for x in docs], "d string")
        return df.unionByName(text.select(F.from_json("d", df.schema).alias("d")).select("d.*"))
    if m[2] == "updateMany":
        return document_update(df, args[0], args[1])
    if m[2] == "deleteMany":
        return df.filter(~F.coalesce(document_filter(args[0]), F.lit(False)))
    out = find(df, *args[:2])
    if m[2] in ("count", "countDocuments"):
        return out.agg(F.count("*").alias("count"))
    if m[2] not in ("find", "findOne"):
        raise ValueError(f"unsupported operation {m[2]}")
    return out.limit(1) if m[2] == "findOne" else out


def document_update(df: DataFrame, spec: dict, change: dict) -> DataFrame:
    """$set, $inc and $unset on the rows that match."""
    from ..operators.relational import update

    sets = {k: F.lit(v) for k, v in change.get("$set", {}).items()}
    sets |= {k: F.coalesce(F.col(k), F.lit(0)) + F.lit(v) for k, v in change.get("$inc", {}).items()}
    sets |= {k: F.lit(None) for k in change.get("$unset", {})}
    return update(df, sets, document_filter(spec))


# --- key-value commands over (key, type, value, expiry)
def _glob(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def run_kv(kv: DataFrame, command: str) -> DataFrame:
    """Reading commands as plans; writing commands return the table after them.  Hash values are JSON
    objects, lists and sets JSON arrays."""
    words = re.findall(r'"((?:[^"\\]|\\.)*)"|(\S+)', command)
    op, *args = [a or b for a, b in words]
    op = op.upper()
    live = kv.filter(F.col("expiry").isNull() | (F.col("expiry") > F.current_timestamp()))
    one = live.filter(F.col("key") == args[0]) if args else live
    items = F.from_json("value", "array<string>")
    fields = F.from_json("value", "map<string,string>")
    if op == "GET":
        return one.select("value")
    if op == "MGET":
        return live.filter(F.col("key").isin(*args)).select("key", "value")
    if op == "EXISTS":
        return live.filter(F.col("key").isin(*args)).agg(F.count("*").alias("n"))
    if op == "KEYS":
        return live.filter(F.col("key").rlike(_glob(args[0]))).select("key")
    if op == "DBSIZE":
        return live.agg(F.count("*").alias("n"))
    if op == "TYPE":
        return one.select("type")
    if op == "TTL":
        return one.select(F.coalesce(F.unix_timestamp("expiry") - F.unix_timestamp(F.current_timestamp()), F.lit(-1)).alias("ttl"))
    if op == "HGET":
        return one.select(F.element_at(fields, F.lit(args[1])).alias("value"))
    if op == "HGETALL":
        return one.select(F.explode(fields).alias("field", "value"))
    if op == "LLEN":
        return one.select(F.size(items).alias("n"))
    if op == "LRANGE":
        start, stop = int(args[1]), int(args[2])
        n = F.size(items)
        low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
        high = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
        return one.select(F.posexplode(F.slice(items, low + 1, F.greatest(high - low + 1, F.lit(0)))).alias("pos", "value"))
    if op == "SMEMBERS":
        return one.select(F.explode(F.array_distinct(items)).alias("value"))
    if op == "SCARD":
        return one.select(F.size(F.array_distinct(items)).alias("n"))
    rest = kv.filter(F.col("key") != args[0]) if args else kv
    spark = kv.sparkSession

    def put(kind: str, value: Column) -> DataFrame:
        row = spark.createDataFrame([(args[0],)], "key string").join(kv.withColumnRenamed("value", "old"), "key", "left")
        row = row.select("key", F.lit(kind).alias("type"), value.alias("value"), F.col("expiry"))
        return rest.unionByName(row.select(*kv.columns))

    if op == "SET":
        return put("string", F.lit(args[1]))
    if op in ("INCR", "DECR", "INCRBY"):
        by = int(args[1]) if op == "INCRBY" else 1 if op == "INCR" else -1
        return put("string", (F.coalesce(F.col("old").cast("long"), F.lit(0)) + by).cast("string"))
    if op == "HSET":
        old = F.coalesce(F.from_json("old", "map<string,string>"), F.create_map().cast("map<string,string>"))
        kept = F.map_filter(old, lambda k, _v: k != args[1])
        return put("hash", F.to_json(F.map_concat(kept, F.create_map(F.lit(args[1]), F.lit(args[2])))))
    if op in ("LPUSH", "RPUSH", "SADD"):
        old, new = F.coalesce(F.from_json("old", "array<string>"), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in args[1:]])
        value = F.concat(F.reverse(new), old) if op == "LPUSH" else F.concat(old, new)
        return put("set" if op == "SADD" else "list", F.to_json(F.array_distinct(value) if op == "SADD" else value))
    if op == "DEL":
        return kv.filter(~F.col("key").isin(*args))
    if op == "EXPIRE":
        due = F.when(F.col("key") == args[0], F.current_timestamp() + F.expr(f"INTERVAL {int(args[1])} SECONDS")).otherwise(F.col("expiry"))
        return kv.withColumn("expiry", due)
    if op == "FLUSHDB":
        return kv.limit(0)
    if op in ("PING", "INFO"):
        return spark.createDataFrame([("PONG" if op == "PING" else "keyspace",)], "reply string")
    raise ValueError(f"unsupported command {op}")


# --- questions in words
def _number(text: str):
    return float(text) if "." in text else int(text)


_OPS = {"greater than": ">", "more than": ">", "over": ">", "above": ">", "less than": "<", "under": "<", "below": "<", "at least": ">=", "at most": "<=", "equal to": "=", "equals": "=", "is": "="}
_PATTERNS = [
    (r"how many (\w+)(?: (?:where|with) (.+))?", "count"),
    (r"(?:what is the )?(average|total|sum|minimum|maximum|min|max|avg) (?:of )?(\w+) (?:of|in|from|for) (\w+)(?: by (\w+))?(?: (?:where|with) (.+))?", "measure"),
    (r"count (\w+) by (\w+)", "group"),
    (r"top (\d+) (\w+) by (\w+)", "top"),
    (r"(?:show|list|find|get)(?: all)?(?: the)? (\w+)(?: (?:where|with) (.+))?", "list"),
]
_AGG = {"average": "avg", "avg": "avg", "total": "sum", "sum": "sum", "minimum": "min", "min": "min", "maximum": "max", "max": "max"}


def _where(text: str | None) -> tuple[str, dict]:
    if not text:
        return "", {}
    parts, args = [], {}
    for i, p in enumerate(re.split(r"\s+and\s+", text)):
        m = re.match(rf"(\w+)\s+(?:is\s+)?({'|'.join(sorted(_OPS, key=len, reverse=True))}|=|<=|>=|<|>)\s+(.+)\Z", p.strip())
        if not m:
            raise ValueError(f"condition not understood: {p!r}")
        v = m[3].strip().strip("'\"")
        args[f"p{i}"] = _number(v) if re.fullmatch(r"-?\d+(\.\d+)?", v) else v
        parts.append(f"`{m[1]}` {_OPS.get(m[2], m[2])} :p{i}")
    return " WHERE " + " AND ".join(parts), args


def understand(question: str) -> dict:
    """{"sql", "args", "intent", "confidence"}; specific patterns come before general ones."""
    text = question.strip().rstrip("?.").lower() if not re.search(r"['\"]", question) else question.strip().rstrip("?.")
    for pattern, intent in _PATTERNS:
        m = re.fullmatch(pattern, text, re.I)
        if not m:
            continue
        if intent == "count":
            w, args = _where(m[2])
            sql = f"SELECT count(*) AS n FROM `{m[1]}`{w}"
        elif intent == "measure":
            w, args = _where(m[5])
            f = _AGG[m[1].lower()]
            sql = f"SELECT `{m[4]}`, {f}(`{m[2]}`) AS value FROM `{m[3]}`{w} GROUP BY `{m[4]}`" if m[4] else f"SELECT {f}(`{m[2]}`) AS value FROM `{m[3]}`{w}"
        elif intent == "group":
            sql, args = f"SELECT `{m[2]}`, count(*) AS n FROM `{m[1]}` GROUP BY `{m[2]}`", {}
        elif intent == "top":
            sql, args = f"SELECT * FROM `{m[2]}` ORDER BY `{m[3]}` DESC NULLS LAST LIMIT {int(m[1])}", {}
        else:
            w, args = _where(m[2])
            sql = f"SELECT * FROM `{m[1]}`{w}"
        return {"sql": sql, "args": args, "intent": intent, "confidence": 0.9}
    words = re.findall(r"\w+", text)
    return {"sql": f"SELECT * FROM `{words[-1]}`" if words else "", "args": {}, "intent": "list", "confidence": 0.5}


def ask(spark: SparkSession, question: str) -> DataFrame:
    got = understand(question)
    return spark.sql(got["sql"], args=got["args"] or None)


def variables(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{\{\s*(\w+)\s*\}\}", text)))


def bind(text: str) -> str:
    """{{name}} placeholders as named parameters, to be given as `args`."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", r":\1", text)


def translate(query: str, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Run a query of any dialect over the named tables."""
    kind = detect(query)
    if kind == "redis":
        return run_kv(tables["kv"], query)
    if kind == "mongodb":
        return run_document(query, tables)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(from_mysql(query) if kind == "mysql" else query)
