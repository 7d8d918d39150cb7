"""Reading and writing tables: Parquet, CSV and COPY text, JSON, JDBC; compaction and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODECS = ("none", "lz4", "snappy", "zstd")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet scan; column choice and predicate reach the files."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, codec: str = "zstd", mode: str = "overwrite", partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Parquet write.  `sort_by` ranges the rows, so that row-group bounds prune later reads (the index scan's stand-in)."""
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r}: one of {CODECS}")
    if sort_by:
        df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    w = df.write.mode(mode).option("compression", codec)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def copy_from(spark: SparkSession, path: str, schema: str, delimiter: str = "\t", null: str = "\\N", header: bool = False, csv: bool = False) -> DataFrame:
    """COPY FROM: tab-separated text with \\N nulls, or CSV with quotes and empty nulls."""
    r = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST")
    if csv:
        return r.option("sep", "," if delimiter == "\t" else delimiter).option("nullValue", "" if null == "\\N" else null).csv(path)
    return r.option("sep", delimiter).option("nullValue", null).option("quote", "").csv(path)


def copy_to(df: DataFrame, path: str, delimiter: str = "\t", null: str = "\\N", header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", delimiter).option("nullValue", null).option("header", header).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Foreign tables; filters, limits, aggregates and joins are pushed down by Spark's dialects.
    partition: (column, lower, upper, tasks) for a parallel read."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k in ("pushDownPredicate", "pushDownAggregate", "pushDownLimit", "pushDownOffset"):
        r = r.option(k, "true")
    if partition:
        c, low, high, n = partition
        r = r.option("partitionColumn", c).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return r.options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def compact(spark: SparkSession, path: str, target: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite a table into files of about `file_bytes`; returns their number."""
    df = spark.read.parquet(path)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    n = max(1, -(-size // file_bytes))
    df.repartition(n).write.mode("overwrite").parquet(target)
    return n


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Remote to local column names."""
    return df.withColumnsRenamed(mapping)


def catalog_tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables of the session."""
    rows = [(t.catalog or "", (t.namespace or [""])[0] if t.namespace else "", t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def catalog_columns(spark: SparkSession) -> DataFrame:
    """information_schema.columns of the session."""
    rows = [(t.name, c.name, i + 1, c.dataType, "YES" if c.nullable else "NO") for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def pushed_filters(df: DataFrame) -> list[str]:
    """The predicates that reach the scans, as the plan states them."""
    import re

    return re.findall(r"PushedFilters: \[(.*?)\]", explain(df))


def row_numbered(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Contiguous data partitions of nearly equal size, numbered from 0; the first have the rows left over."""
    from ..operators.relational import with_sequence

    small, more = divmod(df.count(), parts)
    at, big = F.col("_at"), more * (small + 1)
    part = F.when(at < big, F.floor(at / (small + 1))).otherwise(more + F.floor((at - big) / max(1, small)))
    return with_sequence(df, "_at", order, 0).withColumn("part", part.cast("long")).drop("_at")
