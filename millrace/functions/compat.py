"""SQL functions that Spark lacks or names differently, as column expressions and as session functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def strpos(text: Column, part: Column) -> Column:
    return F.position(part, text)


def trunc_number(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def age(later: Column, earlier: Column) -> Column:
    return later - earlier


#: Format letters of to_char, longest first, and Spark's.
_LETTERS = (("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("Month", "MMMM"), ("Mon", "MMM"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("PM", "a"), ("Day", "EEEE"), ("Dy", "E"))


def date_pattern(pattern: str) -> str:
    """Translate a to_char pattern to a datetime pattern."""
    out, i = "", 0
    while i < len(pattern):
        for a, b in _LETTERS:
            if pattern.startswith(a, i) or (a.isupper() and pattern[i : i + len(a)].upper() == a):
                out, i = out + b, i + len(a)
                break
        else:
            c = pattern[i]
            out, i = out + (f"'{c}'" if c.isalpha() else c), i + 1
    return out


def to_char(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, date_pattern(pattern))


def to_timestamp(text: Column, pattern: str) -> Column:
    return F.to_timestamp(text, date_pattern(pattern))


def json_typeof(text: Column) -> Column:
    """object, array, string, number, boolean or null, as JSON names its types."""
    kind = F.schema_of_variant(F.parse_json(text))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def json_path(text: Column, *keys: str | int) -> Column:
    path = "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in keys)
    return F.get_json_object(text, path)


def json_contains(text: Column, key: str, value: str) -> Column:
    return F.coalesce(json_path(text, key) == F.lit(value), F.lit(False))


#: Session functions, in SQL so that Catalyst inlines them.
SESSION = {
    "strpos": "(s STRING, p STRING) RETURNS INT RETURN position(p IN s)",
    "trunc_number": "(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x >= 0 THEN floor(x) ELSE ceil(x) END",
    "gen_random_uuid": "() RETURNS STRING RETURN uuid()",
    "uuid_generate_v4": "() RETURNS STRING RETURN uuid()",
    "array_length": "(a ARRAY<STRING>) RETURNS INT RETURN size(a)",
    "vector_dims": "(v ARRAY<DOUBLE>) RETURNS INT RETURN size(v)",
    "vector_norm": "(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(v, 0D, (s, x) -> s + x * x))",
    "inner_product": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "l2_distance": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "cosine_distance": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) + 1e-10D)",
    "json_extract": "(j STRING, p STRING) RETURNS STRING RETURN get_json_object(j, p)",
}


def register(spark: SparkSession) -> None:
    for name, body in SESSION.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


class Registry:
    """Scalar and aggregate functions of a session by name, whatever its letter case; arity is checked."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def register_scalar(self, name: str, f, return_type: str, arity: int | None = None) -> None:
        self.known[name.lower()] = arity
        self.spark.udf.register(name, F.udf(f, return_type) if not hasattr(f, "evalType") else f)

    def register_aggregate(self, name: str, pandas_udf) -> None:
        self.known[name.lower()] = 1
        self.spark.udf.register(name, pandas_udf)

    def call(self, name: str, *args: Column) -> Column:
        key = name.lower()
        if key in self.known and self.known[key] not in (None, len(args)):
            raise TypeError(f"{name} takes {self.known[key]} arguments, not {len(args)}")
        return F.call_function(name, *args)
