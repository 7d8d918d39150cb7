"""Foreign data: filters as text for a remote store, pushdown decisions, and Python data sources."""

from __future__ import annotations

import glob
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

OPERATORS = {"=", "<>", "<", "<=", ">", ">=", "like", "in", "is null", "is not null"}


@dataclass(frozen=True)
class Qual:
    column: str
    op: str
    value: object = None


def quote(name: str, q: str = '"') -> str:
    return q + name.replace(q, q + q) + q


def build_select(table: str, columns: list[str], quals: list[Qual], limit: int | None = None, style: str = "numbered") -> tuple[str, list]:
    """(SQL with placeholders, parameters): $1, $2 … for `numbered`, ? for `question`."""
    q = '"' if style == "numbered" else "`"
    params: list = []

    def hold(v) -> str:
        params.append(v)
        return f"${len(params)}" if style == "numbered" else "?"

    where = []
    for x in quals:
        op = x.op.lower()
        if op not in OPERATORS:
            raise ValueError(f"unsupported operator {x.op}")
        c = quote(x.column, q)
        if op.startswith("is"):
            where.append(f"{c} {op.upper()}")
        elif op == "in":
            where.append(f"{c} IN ({', '.join(hold(v) for v in x.value)})")
        else:
            where.append(f"{c} {op.upper()} {hold(x.value)}")
    sql = f"SELECT {', '.join(quote(c, q) for c in columns) or '*'} FROM {quote(table, q)}"
    sql += f" WHERE {' AND '.join(where)}" if where else ""
    return sql + (f" LIMIT {int(limit)}" if limit is not None else ""), params


def _where_text(quals: list[Qual], style: str, params: list) -> str:
    base = len(params)
    text, more = build_select("t", [], quals, style=style)
    at = text.find(" WHERE ")
    if at < 0:
        raise ValueError("a change without a filter would touch the whole remote table")
    params += more
    if style == "numbered":  # the filter's parameters come after those of the assignments
        return re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + base}", text[at:])
    return text[at:]


def build_insert(table: str, columns: list[str], rows: list[tuple], style: str = "numbered") -> tuple[str, list]:
    """One INSERT of several rows with placeholders."""
    q, n = ('"', 0) if style == "numbered" else ("`", 0)
    groups = []
    for r in rows:
        if len(r) != len(columns):
            raise ValueError("a row has another number of values than there are columns")
        groups.append("(" + ", ".join(f"${n + i + 1}" if style == "numbered" else "?" for i in range(len(r))) + ")")
        n += len(r)
    return f"INSERT INTO {quote(table, q)} ({', '.join(quote(c, q) for c in columns)}) VALUES {', '.join(groups)}", [v for r in rows for v in r]


def build_update(table: str, assignments: dict, quals: list[Qual], style: str = "numbered") -> tuple[str, list]:
    q, params = '"' if style == "numbered" else "`", list(assignments.values())
    sets = ", ".join(f"{quote(c, q)} = " + (f"${i + 1}" if style == "numbered" else "?") for i, c in enumerate(assignments))
    return f"UPDATE {quote(table, q)} SET {sets}" + _where_text(quals, style, params), params


def build_delete(table: str, quals: list[Qual], style: str = "numbered") -> tuple[str, list]:
    q, params = '"' if style == "numbered" else "`", []
    return f"DELETE FROM {quote(table, q)}" + _where_text(quals, style, params), params


#: Types of remote servers and Spark's; parameters in brackets are kept for decimals and text of a length.
REMOTE_TYPES = {
    "smallint": "SMALLINT", "int2": "SMALLINT", "tinyint": "TINYINT", "integer": "INT", "int": "INT", "int4": "INT", "mediumint": "INT", "bigint": "BIGINT", "int8": "BIGINT",
    "real": "FLOAT", "float4": "FLOAT", "float": "FLOAT", "double precision": "DOUBLE", "double": "DOUBLE", "float8": "DOUBLE", "numeric": "DECIMAL", "decimal": "DECIMAL",
    "boolean": "BOOLEAN", "bool": "BOOLEAN", "text": "STRING", "character varying": "VARCHAR", "varchar": "VARCHAR", "char": "CHAR", "character": "CHAR", "uuid": "STRING",
    "json": "STRING", "jsonb": "STRING", "bytea": "BINARY", "blob": "BINARY", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamp without time zone": "TIMESTAMP_NTZ",
    "timestamptz": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP", "datetime": "TIMESTAMP_NTZ", "time": "STRING",
}


def spark_type(remote: str) -> str:
    """Spark's type for a remote one, such as numeric(10,2); unknown types are read as text."""
    m = re.fullmatch(r"\s*([a-z0-9 ]+?)\s*(\(\s*\d+\s*(?:,\s*\d+\s*)?\))?(?:\s+unsigned)?\s*", remote.lower())
    kind = REMOTE_TYPES.get(m[1], "STRING") if m else "STRING"
    if kind in ("VARCHAR", "CHAR"):
        return kind + m[2].replace(" ", "") if m[2] else "STRING"
    return "DECIMAL" + (m[2].replace(" ", "") if m[2] else "(38,18)") if kind == "DECIMAL" else kind


def import_schema(columns: list[tuple[str, str, str, bool]], only: list[str] | None = None, but: list[str] | None = None) -> dict[str, str]:
    """Table name to Spark schema text, from a remote catalog's (table, column, type, nullable) rows in order;
    `only` and `but` limit the tables."""
    out: dict[str, list[str]] = {}
    for name, column, kind, nullable in columns:
        if (only is None or name in only) and name not in (but or []):
            out.setdefault(name, []).append(f"{quote(column, '`')} {spark_type(kind)}" + ("" if nullable else " NOT NULL"))
    return {k: ", ".join(v) for k, v in out.items()}


#: The share of rows that a filter is taken to keep: estimates of our own.
SELECTIVITY = {"=": 0.1, "<>": 0.9, "<": 0.33, "<=": 0.33, ">": 0.33, ">=": 0.33, "like": 0.2, "in": 0.2, "is null": 0.1, "is not null": 0.9}


def plan_quals(quals: list[Qual], threshold: float = 0.5) -> tuple[list[Qual], list[Qual], float]:
    """(pushed, kept local, selectivity of the pushed ones)."""
    pushed = [x for x in quals if SELECTIVITY.get(x.op.lower(), 1.0) < threshold]
    share = 1.0
    for x in pushed:
        share *= SELECTIVITY[x.op.lower()]
    return pushed, [x for x in quals if x not in pushed], share


def plan_limit(limit: int | None, offset: int | None, ordered: bool) -> int | None:
    """What to ask the remote store for: limit + offset, unless rows are ordered here."""
    return None if limit is None or ordered else limit + (offset or 0)


def plan_aggregates(functions: list[str]) -> tuple[list[str], list[str]]:
    """(pushed, computed here)."""
    able = {"count", "sum", "min", "max", "avg"}
    return [f for f in functions if f.lower() in able], [f for f in functions if f.lower() not in able]


def plan_join(servers: tuple[str, str], how: str) -> bool:
    return servers[0] == servers[1] and how.lower() in ("inner", "left", "right")


def _local(path: str) -> str:
    """A local path of a path or file: URL."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _DocumentReader(DataSourceReader):
    """JSON lines; equality, range, null, IN and prefix filters run while reading."""

    def __init__(self, schema, options):
        self.schema, self.path, self.tests = schema, _local(options["path"]), []

    def pushFilters(self, filters):
        able = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in", IsNull: "null", IsNotNull: "some", StringStartsWith: "prefix"}
        for f in filters:
            kind = able.get(type(f))
            if kind is None or len(f.attribute) != 1:
                yield f
            else:
                self.tests.append((kind, f.attribute[0], getattr(f, "value", None)))

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*.json*"))) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found] or [_File("")]

    def _keeps(self, doc: dict) -> bool:
        for kind, name, want in self.tests:
            v = doc.get(name)
            if kind == "null":
                ok = v is None
            elif v is None:
                ok = False
            elif kind == "some":
                ok = True
            elif kind == "in":
                ok = v in want
            elif kind == "prefix":
                ok = str(v).startswith(want)
            else:
                ok = {"eq": v == want, "gt": v > want if kind == "gt" else False, "ge": v >= want if kind == "ge" else False, "lt": v < want if kind == "lt" else False, "le": v <= want if kind == "le" else False}[kind]
            if not ok:
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        names = self.schema.fieldNames()
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    doc = json.loads(line)
                    if self._keeps(doc):
                        yield tuple(doc.get(n) for n in names)


class DocumentSource(DataSource):
    """format("documents"): a folder of JSON-lines files; without a schema one is inferred from all of them, so large folders should be given one."""

    @classmethod
    def name(cls):
        return "documents"

    def schema(self):
        kinds: dict[str, str] = {}
        path = _local(self.options["path"])
        for p in (sorted(glob.glob(os.path.join(path, "*.json*"))) if os.path.isdir(path) else [path]):
            with open(p, encoding="utf-8") as f:
                for line in f:
                    if not line.strip():
                        continue
                    for k, v in json.loads(line).items():
                        kind = "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
                        old = kinds.get(k)
                        if v is None:
                            kinds.setdefault(k, "")
                        elif old and old != kind:
                            kinds[k] = "double" if {kind, old} == {"bigint", "double"} else "string"
                        else:
                            kinds[k] = kind
        return ", ".join(f"`{k}` {v or 'string'}" for k, v in kinds.items())

    def reader(self, schema):
        return _DocumentReader(schema, self.options)

    def writer(self, schema, overwrite):
        return _DocumentWriter(schema, self.options, overwrite)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _DocumentWriter(DataSourceWriter):
    """One JSON-lines file per task, visible only once its name is final."""

    def __init__(self, schema, options, overwrite):
        self.schema, self.path, self.overwrite = schema, _local(options["path"]), overwrite

    def write(self, iterator):
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{uuid.uuid4().hex}.tmp")
        with open(name, "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(json.dumps(row.asDict(recursive=True), default=str) + "\n")
        return _Written(name)

    def commit(self, messages):
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "*.json")):
                os.remove(old)
        for m in messages:
            if m is not None:
                os.rename(m.path, m.path.removesuffix(".tmp") + ".json")

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class _KeyValueReader(DataSourceReader):
    def __init__(self, schema, options):
        self.path, self.prefix = _local(options["path"]), options.get("prefix", "")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("key",):
                self.prefix = max(self.prefix, f.value, key=len)
            yield f  # Spark checks again: the prefix only saves reading

    def partitions(self):
        return [_File(self.path)]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    d = json.loads(line)
                    if d["key"].startswith(self.prefix):
                        v = d["value"]
                        kind = "hash" if isinstance(v, dict) else "list" if isinstance(v, list) else "string"
                        yield (d["key"], d.get("type", kind), v if isinstance(v, str) else json.dumps(v))


class KeyValueSource(DataSource):
    """format("keyvalue"): a dump of one JSON object {"key", "value"} per line."""

    @classmethod
    def name(cls):
        return "keyvalue"

    def schema(self):
        return "key string, type string, value string"

    def reader(self, schema):
        return _KeyValueReader(schema, self.options)


SOURCES = {c.name(): c for c in (DocumentSource, KeyValueSource)}


def register(spark: SparkSession) -> None:
    """Make the Python sources known to the session and let their filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for c in SOURCES.values():
        spark.dataSource.register(c)
