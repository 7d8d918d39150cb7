"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of an n-gram (3 to 5 bytes, ASCII letters lower-cased, white space as one kind of blank) is a
binary feature; its value is the naive Bayes log-count ratio between toxic and other labelled texts; a
logistic regression is trained on the scaled features.  Labels serve training only.

Bounds: the model is fitted on at most MAX_PER_CLASS labelled rows of each class (the ones with the
smallest id hashes), and keeps the FEATURES n-grams that tell the classes apart best.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _U, _WS, chunks, mix64, text_buffers

ORDERS, FEATURES, MAX_PER_CLASS = (3, 4, 5), 2048, 4000
#: An n-gram needs so many training texts; L2 penalty; steps of the optimiser; n-gram hashes are stored in a table of 2^TABLE.
LEAST_TEXTS, PENALTY, STEPS, TABLE = 8, 3e-4, 250, 20
_FOLD = _LOWER.copy()
_FOLD[_WS] = 32


def ngram_hashes(data: np.ndarray, offsets: np.ndarray):
    """Yields (hashes, rows) per order: all n-grams of each text, which do not cross texts."""
    text = _FOLD[data].astype(np.uint64) + _U(1)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    h, done = text.copy(), 1
    for n in ORDERS:
        while done < n:
            h = h[:-1] * _U(0x5851F42D4C957F2D) + text[done:] if len(h) else h
            done += 1
        if len(h):
            whole = row[: len(h)] == row[n - 1 :]
            yield mix64(h[whole] * _U(8) + _U(n & 7)), row[: len(h)][whole]


class Model:
    """weights: of the features by hash (sorted); score = sigmoid(bias + sum of the weights present)."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.table = None

    def _lookup(self):
        if self.table is None:
            shift = _U(64 - TABLE)
            self.table = np.zeros(1 << TABLE, bool)
            self.table[(self.hashes >> shift).astype(np.int64)] = True
        return self.table, _U(64 - TABLE)

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, features) pairs, each once: which features each text holds."""
        table, shift = self._lookup()
        keys = [np.zeros(0, np.int64)]
        for h, row in ngram_hashes(data, offsets):
            maybe = table[(h >> shift).astype(np.int64)]
            h, row = h[maybe], row[maybe]
            at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            if len(self.hashes):
                hit = self.hashes[at] == h
                keys.append(row[hit].astype(np.int64) * len(self.hashes) + at[hit])
        key = np.unique(np.concatenate(keys))
        return key // max(1, len(self.hashes)), key % max(1, len(self.hashes))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        for i, j in chunks(offsets, 1 << 20):
            row, k = self.present(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            np.add.at(z, i + row, self.weights[k])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _remainder(col: str):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the penalised logistic loss."""
    n, d = x.shape
    v = np.ones(d, np.float32) / np.sqrt(d)
    for _ in range(20):
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1.0 / (0.25 * (top / n + 1.0) + penalty)
    w, b = np.zeros(d, np.float32), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        g = 1.0 / (1.0 + np.exp(-(x @ pw + pb))) - y
        nw, nb = pw - rate * (x.T @ g / n + penalty * pw).astype(np.float32), pb - rate * float(g.mean())
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        pw, pb = nw + np.float32((s - 1) / t) * (nw - w), nb + (s - 1) / t * (nb - b)
        w, b = nw, nb
    return w.astype(np.float64), b


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, features: int = FEATURES) -> Model:
    """A model from the labelled rows whose crc32(doc_id) mod 5 is not 0.

    Labels that are null, ids that are null and labels without a document are left out; of several labels
    of an id the largest counts, of several rows of an id one.  At most `max_per_class` rows a class and
    `features` n-grams, each in LEAST_TEXTS texts or more, make the model.  Without a label of each class the score is the share of toxic labels.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(_remainder("doc_id") != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    n0, n1 = (int(x or 0) for x in known.agg(F.sum(1 - F.col("y")), F.sum("y")).first())
    prior = np.log((n1 + 1e-9) / (n0 + 1e-9)) if n0 + n1 else -50.0
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), float(prior))
    if not n0 or not n1:
        return empty
    pick = [known.filter(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for c in (0, 1)]
    picked = F.broadcast(pick[0].union(pick[1]))  # at most 2 * max_per_class rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(picked, "id")
    # of several rows of an id the one with the least hash counts, so that the bound holds for rows too
    texts = texts.withColumn("h", F.xxhash64("text")).withColumn("k", F.expr("row_number() over (partition by id order by h)"))
    texts = texts.filter("k = 1").select("y", "text").repartition(8, F.xxhash64("text"))

    def count(batches):
        import pandas as pd
        import pyarrow as pa

        for batch in batches:
            y = batch.column(0).to_numpy()
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, 1 << 20):
                keys, ys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
                for h, row in ngram_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    one = pd.DataFrame({"h": h, "r": row}).drop_duplicates()
                    keys.append(one["h"].to_numpy())
                    ys.append(y[i:j][one["r"].to_numpy()])
                got = pd.DataFrame({"h": np.concatenate(keys), "y": np.concatenate(ys)}).groupby("h")["y"].agg(["sum", "count"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got.index.to_numpy().view(np.int64)), pa.array(got["sum"].to_numpy().astype(np.int64)), pa.array(got["count"].to_numpy().astype(np.int64))],
                    names=["h", "pos", "n"],
                )

    counts = texts.mapInArrow(count, "h long, pos long, n long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    m1, m0 = (min(n, max_per_class) for n in (n1, n0))
    p, q = (F.col("pos") + 0.5) / (m1 + 1.0), (F.col("n") - F.col("pos") + 0.5) / (m0 + 1.0)
    pooled = (F.col("n") + 1.0) / (m1 + m0 + 2.0)
    stat = F.abs(p - q) / F.sqrt(pooled * (1.0 + 1e-9 - F.least(pooled, F.lit(0.999))))
    best = counts.filter(F.col("n") >= LEAST_TEXTS).withColumn("ratio", F.log(p / q)).orderBy(stat.desc(), "h").limit(features).select("h", "ratio").collect()
    if not best:
        return empty
    hashes, ratio = np.array([r.h for r in best], np.int64).view(np.uint64), np.array([r.ratio for r in best])
    order = np.argsort(hashes)
    hashes, ratio = hashes[order], ratio[order]
    model = Model(hashes, ratio, 0.0)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            bits = np.zeros((len(offsets) - 1, len(hashes)), bool)
            for i, j in chunks(offsets, 1 << 20):
                r, k = model.present(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bits[i + r, k] = True
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], names=["y", "bits"])

    got = texts.mapInArrow(rows, "y int, bits binary").orderBy("y", "bits").collect()  # at most 2 * max_per_class rows of features / 8 bytes
    y = np.array([r.y for r in got], np.float32)
    if y.min() == y.max():
        return empty
    x = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in got]), axis=1)[:, : len(hashes)].astype(np.float32)
    x *= ratio.astype(np.float32)
    w, b = _logistic(x, y, PENALTY, STEPS)
    shift = prior - np.log(y.sum() / (len(y) - y.sum()))  # from the classes' shares in the sample to those of all labels
    return Model(hashes, w * ratio, float(b + shift))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns `keep`, and score for every row of `docs`; a null text counts as empty."""
    names = ["doc_id", "text", *keep]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = model.scores(*text_buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(s)], names=["doc_id", *keep, "score"])

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names if c != "text") + ", score double"
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Nulls: a null text is empty and scored; a null id is kept and counts as the empty text in the check
    sum.  Repeated rows score alike.  Empty tables give no rows.  Further columns are ignored.
    """
    out = score(docs, fit(docs, labels))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (_remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose score reaches `threshold`.  A null text counts as empty, equal texts
    stay or go together, and ids and further columns play no part; an empty table stays empty."""
    model = fit(docs, labels)
    names, kinds = docs.columns, docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = model.scores(*text_buffers(batch.column(names.index("text"))))
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, kinds)
