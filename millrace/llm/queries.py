"""The registered queries: one per operator, over its whole table, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_pieces(spark: SparkSession, d: str) -> DataFrame:
    from .pieces import encode

    return encode(_docs(spark, d).select("doc_id", "text"))


def op2_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    from .mixing import mix_sizes

    return mix_sizes(_docs(spark, d).select("doc_id", "source", "text"))


def op3_jump_shards(spark: SparkSession, d: str) -> DataFrame:
    from .sharding import shard

    return shard(_docs(spark, d).select("doc_id", "text"))


def op4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    from .fingerprints import fingerprint_with_next

    return fingerprint_with_next(_docs(spark, d).select("doc_id", "text"))


def op5_graph_ann(spark: SparkSession, d: str) -> DataFrame:
    from .graph_ann import nearest

    return nearest(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"))


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_docs(spark, d).select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"))


def op7_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_docs(spark, d).select("doc_id", "text"))


def op8_secrets(spark: SparkSession, d: str) -> DataFrame:
    from .secrets import scan

    return scan(_docs(spark, d).select("doc_id", "text"))


def op9_licenses(spark: SparkSession, d: str) -> DataFrame:
    from .licenses import scan

    return scan(_docs(spark, d).select("doc_id", "text"))


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    from .lines import line_report

    return line_report(_docs(spark, d).select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_pieces, op2_mix_sources, op3_jump_shards, op4_fingerprints, op5_graph_ann, op6_toxicity, op7_near_dedup, op8_secrets, op9_licenses, op10_line_dedup)}
ORACLES: dict[str, str] = {}
