import random

import pytest

import __spark_entry__
import corpus_pipeline
from millrace.llm import common

from .conftest import SCHEMA, prose


def test_stages_keep_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, d), "t")
        seen.append((name, docs.count(), out.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    by = {n: (a, b) for n, a, b in seen}
    assert by["MinHash near-dedup"][1] <= by["MinHash near-dedup"][0]
    assert docs.filter("not lossless").count() == 0 and docs.count() > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_near_duplicates_go_from_80_percent(spark):
    w = prose(random.Random(4), 104).split(" ")
    texts = [" ".join(w), " ".join([*w[:20], "edit", *w[21:80], "edit", *w[81:]])]  # 90 of 110 shingles of 5 words
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    assert [r.doc_id for r in stage(spark, docs, "").collect()] == [0]


#: doc_ids that each stage keeps of the fixture of nulls, repeated rows and clashing columns.
KEPT = {
    "toxicity": [None, None, 1, 2, 2, 3],
    "line dedup": [None, 1, 2, 2, 3],  # the row with a null id comes last, so its only line repeats that of document 2
    "MinHash near-dedup": [None, None, 1, 2, 2, 3],  # null ids stay, rows that share an id are one document
    "source mixing": [None, 2],  # documents with words, the repeated one once
    "SentencePiece coding": [None, None, 1, 2, 2, 3],
}


@pytest.mark.parametrize("name", list(KEPT))
def test_stage_edges(spark, tmp_path, empty, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(2, 0), (3, 0), (None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    last = name == corpus_pipeline.STAGES[-1][0]
    got = stage(spark, odd, str(tmp_path))
    assert last or got.columns == odd.columns
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    if name == "source mixing":  # a row for each time that words of a document are taken
        ids = set(ids)
        assert all(r.n_chars == len(r.text) and "a b c d e f g h".find(r.text.strip()) >= 0 for r in rows)
    assert sorted(ids, key=lambda i: -1 if i is None else i) == KEPT[name]
    assert not last or all(r.lossless for r in rows)
    none = stage(spark, empty, str(tmp_path))
    assert none.count() == 0 and (last or none.columns == empty.columns)
