"""Near-duplicate documents by SuperMinHash.

Each document's set is its distinct 5-word shingles (64-bit hashes).  Its SuperMinHash signature takes,
for every element, ranks r_j + j at the positions of a pseudorandom permutation and keeps the minimum
per position; a level j is only looked at while some position has no value below j (early stopping).
Signatures are cut into bands; sets that share a band are candidates, confirmed on the full sets with
integer arithmetic; the links are grouped by distributed union-find.

A signature has m = 216 positions; the rows of a band follow from the threshold, so that a pair at it is
missed with a probability of 1e-4 at most: at 0.85, 36 bands of 6 miss (1 - 0.85^6)^36 = 4e-8 (SuperMinHash's
negative correlation only lowers the variance).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import _U, _powers, apart, chunks, materialize, mix64, shingle_sets, text_buffers

M = 216
SHINGLE = 5
#: A link has 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 85
_GAMMA = _U(0x9E3779B97F4A7C15)


def super_minhash(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """SuperMinHash signatures (uint64: level in the high, rank in the low 32 bits) of the non-empty `sets`.

    All elements of all sets advance together, level by level; sets whose positions are all filled drop out.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):  # sets of like size together, so that they need about as many levels
        j, total = i, 0
        while j < len(order) and (j == i or total + sizes[order[j]] <= 1 << 16):
            total += sizes[order[j]]
            j += 1
        _levels([sets[t] for t in order[i:j]], order[i:j], out, m)
        i = j
    return out


def _levels(sets: list[np.ndarray], where: np.ndarray, out: np.ndarray, m: int) -> None:
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat, perm, low = sig.reshape(-1), None, _U(0xFFFFFFFF)
    for level in range(m):
        h = mix64(x + _U((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = (level + (((h & low) * _U(m - level)) >> _U(32)).astype(np.int64)).astype(np.int64)
        if level == 0:
            at = first = pick
        else:
            if perm is None:  # the Fisher-Yates state after level 0, only for sets that go on
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
                r = np.arange(len(x))
                perm[:, 0] = first
                perm[r, first] = 0
                perm[first == 0, 0] = 0
            r = np.arange(len(x))
            at = perm[r, pick]
            perm[r, pick] = perm[:, level]
            perm[:, level] = at
            at = at.astype(np.int64)
        np.minimum.at(flat, doc * m + at, (_U(level) << _U(32)) | (h >> _U(32)))
        open_ = (sig == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        keep = open_[doc]
        if not keep.all():
            x, doc, first = x[keep], doc[keep], first[keep]
            perm = perm[keep] if perm is not None else None
    out[where] = sig


def band_rows(percent: int) -> int:
    """The most rows of a band with which a pair at the threshold is missed with at most 1e-4."""
    return next((r for r in (6, 4, 3, 2) if (1 - (percent / 100) ** r) ** (M // r) <= 1e-4), 1)


def most_bits(percent: int) -> float:
    """Pairs are compared on full sets if at most so many of the M one-bit ranks differ: at the threshold a
    bit differs with probability (1 - percent / 100) / 2; this lies six standard deviations above the mean."""
    p = (1 - percent / 100) / 2
    return M * p + 6 * (M * p * (1 - p)) ** 0.5 + 2


def band_keys(sig: np.ndarray, rows: int = 6) -> np.ndarray:
    bands, coef = M // rows, _powers(rows + 1)[1 : rows + 1]
    h = (mix64(sig.copy()).reshape(len(sig), bands, rows) * coef).sum(axis=2, dtype=np.uint64)
    return mix64(h + _GAMMA * np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def one_bit(sig: np.ndarray) -> np.ndarray:
    """Four int64 words per signature, one bit per position."""
    bits = np.zeros((len(sig), 256), np.uint8)
    bits[:, : sig.shape[1]] = (sig & _U(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


SIGNED = "id long, th long, n_shingles long, digest string, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def _sign(batches, signature=super_minhash, rows: int = 6):
    import pyarrow as pa

    bands = M // rows
    for batch in batches:
        ids, th, text = batch.columns
        data, offsets = text_buffers(text)
        for i, j in chunks(offsets, 2 << 20):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
            full = [k for k, s in enumerate(sets) if len(s)]
            sig = signature([sets[k] for k in full])
            keys, words = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), 4), np.int64)
            if full:
                keys[full], words[full] = band_keys(sig, rows), one_bit(sig)
            some = np.array([len(s) > 0 for s in sets])
            ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i),
                    th.slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1))),
                    *[pa.array(words[:, k]) for k in range(4)],
                ],
                names=["id", "th", "n_shingles", "digest", "bands", "s0", "s1", "s2", "s3"],
            )


def _sets(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in chunks(offsets, 2 << 20):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "g"])


def bits_apart(a: str, b: str):
    return sum((F.bit_count(F.col(f"{a}_s{i}").bitwiseXOR(F.col(f"{b}_s{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}_s0").bitwiseXOR(F.col(f"{b}_s0"))))


def can_link(a: str, b: str, percent: int = PERCENT):
    """Necessary for a link: sizes within the threshold (exact) and few one-bit ranks apart."""
    small, large = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (100 * small >= percent * large) & (bits_apart(a, b) <= most_bits(percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, signature=super_minhash) -> DataFrame:
    """(id_col, n_shingles long, component_id, kept) for every row of `docs`; further columns are ignored.

    Defined cases: a null or wordless text has n_shingles 0, is linked with nothing and is kept; rows with
    a null id are returned with component_id null and kept true and take no part in linking; rows that
    share an id are documents of their own, each linked by its own text; repeated rows agree.
    Copies are collapsed to one class per distinct set before any candidate is formed.
    """
    return _components(docs, id_col, text_col, percent, signature).select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, signature=super_minhash) -> DataFrame:
    """id, th (hash of the text), n_shingles, component of every row of `docs`."""
    pairs_in = _keyed(docs, id_col, text_col)
    rows = band_rows(percent)
    signed = materialize(pairs_in.mapInArrow(lambda batches: _sign(batches, signature, rows), SIGNED), "signed")
    some = signed.filter("id is not null and n_shingles > 0")
    # any row of a class has its set: the text of the one with the smallest id stands for it
    classes = some.groupBy("digest", "n_shingles").agg(F.min("id").alias("rep"), F.min_by("th", "id").alias("th"), F.count("*").alias("copies"), F.first(F.struct("bands", "s0", "s1", "s2", "s3")).alias("x"))
    reps = materialize(classes.select(F.monotonically_increasing_id().alias("id"), F.col("n_shingles").alias("n"), "rep", "th", "copies", "digest", "x.*"), "reps")

    def contents(ids: DataFrame) -> DataFrame:
        places = reps.join(ids, "id", "left_semi").select(F.col("id").alias("class"), F.col("rep").alias("of"), F.col("th").alias("key"))
        texts = pairs_in.join(places, (F.col("id") == F.col("of")) & (F.col("th") == F.col("key"))).select(F.col("class").alias("id"), "text")
        texts = texts.groupBy("id").agg(F.min("text").alias("text"))  # repeated rows
        return texts.mapInArrow(_sets, "id long, c array<long>")

    bands = reps.select(F.explode("bands").alias("key"), "id")
    comp = common.link_components(reps.select("id", "n", "s0", "s1", "s2", "s3"), bands, contents, percent, lambda a, b: can_link(a, b, percent))
    # classes of one row without links, and rows without words, need no second look
    of_class = reps.select("id", "rep", "copies", "digest").join(comp, "id", "left").filter("component is not null or copies > 1")
    of_class = of_class.select("digest", "rep", F.coalesce("component", "id").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("smallest")).select(apart("component").alias("of"), "smallest")
    of_class = of_class.join(smallest, F.col("component") == F.col("of")).select(F.concat("digest", F.lit("")).alias("of"), "smallest")
    thin = signed.select("id", "th", "n_shingles", "digest")
    found = thin.filter("digest is not null and id is not null").join(of_class, F.col("digest") == F.col("of"), "left").select("id", "th", "n_shingles", F.coalesce("smallest", "id").alias("component"))
    return found.union(thin.filter("digest is null or id is null").select("id", "th", "n_shingles", F.col("id").alias("component")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` without the rows whose text is a near copy, from `percent` on, of that of a smaller doc_id.
    Rows with null ids, and null texts or texts without words, stay.  Rows that share a doc_id are one
    document and do not take each other out; repeated rows stay or go together.  Further columns are kept."""
    gone = _components(docs, "doc_id", "text", percent).filter("component <> id").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return keyed.join(gone, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_key") == F.col("_th")), "left_anti").select(*docs.columns)
