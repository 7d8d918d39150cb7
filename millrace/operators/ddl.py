"""Tables of the session catalog: DDL, statistics, plans with timings, and a guard for foreign SQL text.

Parquet tables cannot rename or drop columns or update rows in place, so such changes write a new table and
swap the names; readers of the old one keep their snapshot.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relational

_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?\Z")


def _name(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a table or column name: {name!r}")
    return name


def create_table(spark: SparkSession, name: str, schema: str, if_not_exists: bool = False, primary_key: list[str] | None = None) -> None:
    """Primary keys are kept as a property; their uniqueness is checked by `violations`."""
    guard = "IF NOT EXISTS " if if_not_exists else ""
    keys = f" TBLPROPERTIES ('primary_key' = '{','.join(map(_name, primary_key))}')" if primary_key else ""
    spark.sql(f"CREATE TABLE {guard}{_name(name)} ({schema}) USING parquet{keys}")


def drop_table(spark: SparkSession, *names: str, if_exists: bool = True) -> None:
    for n in names:
        spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{_name(n)}")


def add_column(spark: SparkSession, name: str, column: str, kind: str) -> None:
    spark.sql(f"ALTER TABLE {_name(name)} ADD COLUMNS ({_name(column)} {kind})")


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {_name(old)} RENAME TO {_name(new)}")


def replace(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Swap a table's contents for `df`, which may read the table itself.  If the swap fails, the old table is back
    under its name."""
    new, old = f"{_name(name)}_{uuid.uuid4().hex[:8]}", f"{name}_{uuid.uuid4().hex[:8]}"
    df.write.format("parquet").saveAsTable(new)
    rename_table(spark, name, old)
    try:
        rename_table(spark, new, name)
    except Exception:
        rename_table(spark, old, name)
        drop_table(spark, new)
        raise
    drop_table(spark, old)


def rename_column(spark: SparkSession, name: str, old: str, new: str) -> None:
    replace(spark, name, spark.table(name).withColumnRenamed(old, _name(new)))


def drop_column(spark: SparkSession, name: str, column: str) -> None:
    replace(spark, name, spark.table(name).drop(column))


def update_table(spark: SparkSession, name: str, assignments: dict, where=None) -> None:
    replace(spark, name, relational.update(spark.table(name), assignments, where))


def delete_from(spark: SparkSession, name: str, where=None) -> None:
    replace(spark, name, relational.delete(spark.table(name), where))


def violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are null or occur more than once."""
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(null | (F.col("n") > 1))


def analyze(spark: SparkSession, name: str) -> None:
    spark.sql(f"ANALYZE TABLE {_name(name)} COMPUTE STATISTICS FOR ALL COLUMNS")


def explain_analyze(df: DataFrame, mode: str = "formatted") -> dict:
    """The plan with rows and milliseconds of one run that keeps nothing."""
    began = time.time()
    rows = df.count()
    return {"plan": df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode), "rows": rows, "ms": round((time.time() - began) * 1000, 1)}


FORBIDDEN = ("DROP", "TRUNCATE", "ALTER", "GRANT", "REVOKE")


def check_sql(text: str, longest: int = 100_000, statements: int = 1, read_only: bool = True) -> str:
    """`text` if it is one statement of bounded length without comments that hide text and, read-only, no
    writing verb; else ValueError.  Values belong into parameters, not into the text."""
    if len(text) > longest:
        raise ValueError("too long")
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", text)
    parts = [p for p in bare.split(";") if p.strip()]
    if not 1 <= len(parts) <= statements:
        raise ValueError(f"{len(parts)} statements")
    if "--" in bare or "/*" in bare.replace("/*+", ""):
        raise ValueError("comments are not allowed")
    verbs = {p.split()[0].upper() for p in parts}
    bad = verbs & {*FORBIDDEN, *(("INSERT", "UPDATE", "DELETE", "MERGE", "CREATE") if read_only else ())}
    if bad:
        raise ValueError(f"not allowed: {sorted(bad)}")
    return text
