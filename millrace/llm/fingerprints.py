"""MinHash fingerprints of documents.

A fingerprint holds, for each of K universal hash permutations h(x) = (a x + b) mod 2^64 (a odd), the
smallest value over the text's 5-word shingles, cut to 16 bits.  The share of equal places estimates the
Jaccard similarity.  `similar` joins bands of the signature in Spark and confirms Jaccard on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, _powers, chunks, mix64, partitions, text_buffers, word_hashes

PERMS, SHINGLE, SEED = 128, 5, 20240501
#: A text without words has this fingerprint; it is like another only if that is empty too.
EMPTY = "ffff" * PERMS


def coefficients(perms: int = PERMS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    s = mix64(np.arange(1, 2 * perms + 1, dtype=np.uint64) + _U(seed))
    return s[:perms] | _U(1), s[perms:]


_A, _B = coefficients()


def minhash(shingles: np.ndarray, starts: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """(len(starts), perms) minima over the non-empty runs of `shingles` that begin at `starts`."""
    out = np.empty((len(starts), len(a)), np.uint64)
    i = 0
    while i < len(starts):  # pieces that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 13), side="right")) - 1)
        j = len(starts) if i + 1 >= len(starts) else j
        x = shingles[starts[i] : starts[j] if j < len(starts) else len(shingles)]
        at, h = starts[i:j] - starts[i], np.empty_like(x)
        for k in range(len(a)):
            np.multiply(x, a[k], out=h)
            h += b[k]
            out[i:j, k] = np.minimum.reduceat(h, at)
        i = j
    return out


def shingles_of(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, number of each text): k words each; a shorter text is one shingle."""
    w, first = word_hashes(data, offsets)
    n = np.diff(first)
    if len(w) == 0:
        return w, n
    coef, pad = _powers(k + 1), np.concatenate([w, np.zeros(k, np.uint64)])
    grams = np.zeros(len(w), np.uint64)
    for j in range(k):
        grams += pad[j : j + len(w)] * coef[j]
    place = np.arange(len(w)) - np.repeat(first[:-1], n)
    keep = place + k <= np.repeat(n, n)
    for d in np.flatnonzero((n > 0) & (n < k)).tolist():  # few: texts of one to four words
        a, m = int(first[d]), int(n[d])
        grams[a] = (w[a : a + m] * coef[:m]).sum(dtype=np.uint64, keepdims=True)[0] ^ _U(0xD1B54A32D192ED03 * m & 0xFFFFFFFFFFFFFFFF)
        keep[a] = True
    return mix64(grams[keep]), np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures cut to 16 bits, whether the text has words)."""
    out = np.full((len(offsets) - 1, PERMS), 0xFFFF, np.uint16)
    for i, j in chunks(offsets, 2 << 20):
        x, n = shingles_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        full = np.flatnonzero(n > 0)
        if len(full):
            out[i + full] = (mix64(minhash(x, (np.cumsum(n) - n)[full])) >> _U(48)).astype(np.uint16)
    return out, (out != 0xFFFF).any(axis=1)


def _texts(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return signatures(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))[0]


def _hex(sig: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in sig.astype(">u2")]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) for every row; a null text counts as empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sig = signatures(*text_buffers(batch.column(1)))[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(sig), pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """The report of each document, its edited text (the last half replaced by the start of the next
    document) and their likeness.

    Next is by ascending doc_id, null ids last, rows that share an id by the hash of their text; after the
    last comes the first.  A null text is empty; further columns are ignored.  Each row meets its
    successor without any global sort in one task: rows are dealt into ranges whose bounds are ids of the
    table, and the first rows of a range are also sent to the range before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(docs.sparkSession)
    got = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 20 * n).alias("q"), F.min("doc_id").alias("low")).first()
    bounds = np.array(sorted({got.low, *got.q}) if got.low is not None else [], np.int64)

    def deal(batches):
        import pyarrow as pa

        last = max(0, len(bounds) - 1)
        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            place = np.maximum(np.searchsorted(bounds, ids, side="right") - 1, 0)
            place[null] = last
            again = np.zeros(0, np.int64)
            if len(bounds):
                again = np.flatnonzero((bounds[np.minimum(place, last)] == ids) & ~null)
            take = np.concatenate([np.arange(len(ids)), again])
            bucket = np.concatenate([place, np.where(place[again] > 0, place[again] - 1, last)])
            guest = np.concatenate([np.zeros(len(ids), np.int32), np.ones(len(again), np.int32)])
            part = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(guest, pa.int32()), *part.columns], names=["bucket", "guest", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "bucket long, guest int, doc_id long, text string")
    dealt = dealt.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).repartition(n, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "h").select("bucket", "guest", "doc_id", "text")

    def report(batches):
        import pandas as pd

        held: list[tuple] = []  # the rows not written yet: (doc_id, text, signature)
        head = bucket = None
        done = False
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                ids = [None if pd.isna(x) else int(x) for x in part["doc_id"]]
                sigs = _texts(texts)
                pairs = []
                for b, g, i, t, s in zip(part["bucket"], part["guest"], ids, texts, sigs, strict=True):
                    row = (i, t, s)
                    if b != bucket:
                        if held and not done:
                            pairs.append((held.pop(), head))
                        held, head, bucket, done = [], row, b, False
                    if done:
                        continue
                    if held:
                        pairs.append((held.pop(), row))
                    if g:
                        done = True
                    else:
                        held = [row]
                if pairs:
                    yield _pairs(pairs)
        if held and not done:
            yield _pairs([(held.pop(), head)])

    return dealt.mapInPandas(report, REPORT)


def _pairs(pairs: list[tuple]):
    import pandas as pd

    edited = []
    for (_, t, _), (_, u, _) in pairs:
        half = len(t) // 2
        edited.append(t[: len(t) - half] + u[:half])
    own, nxt, sig = np.array([p[0][2] for p in pairs]), np.array([p[1][2] for p in pairs]), _texts(edited)
    return pd.DataFrame(
        {
            "doc_id": pd.array([p[0][0] for p in pairs], "Int64"),
            "n_chars": [len(p[0][1]) for p in pairs],
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            "fingerprint": _hex(own),
            "edited_fingerprint": _hex(sig),
            "near_edited": (own == sig).mean(axis=1),
            "near_next": (own == nxt).mean(axis=1),
        }
    )


def similar(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents with a Jaccard similarity of at least `percent`: MinHash bands joined in Spark,
    confirmed on full shingle sets; columns and defined cases as near_dedup.near_duplicates."""
    from . import near_dedup

    return near_dedup.near_duplicates(docs, id_col, text_col, percent=percent, signature=_full_signature)


def _full_signature(sets: list[np.ndarray]) -> np.ndarray:
    from .near_dedup import M

    if not sets:
        return np.zeros((0, M), np.uint64)
    n = np.array([len(s) for s in sets])
    return mix64(minhash(np.concatenate(sets), np.cumsum(n) - n, *coefficients(M)))
