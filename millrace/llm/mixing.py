"""Mixing sources to target weights.

The words of each source, taken document by document, are packed into blocks of a fixed number of words.
Output shards draw how many of their slots each source fills from a multinomial distribution over what
the sources still have to give; a source's n-th slot takes the block that a pseudorandom permutation of
its block indexes gives for n (a new permutation each time through); slots and blocks are joined by index.

Driver-side state is one small row per source and per (shard, source): sources are what a mix is
configured by, a few to a few thousand; their number does not grow with the documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _U, _WS, chunks, materialize, mix64, text_buffers

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK = 128
#: Rows of a chunk of a source's word count; slots of an output shard.  Both only size the work.
CHUNK_ROWS, SHARD_SLOTS, LEAST_SHARDS, SEED = 20_000, 1 << 20, 16, 20240501


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: `share` of all words split by weight, none above `most` times its
    size; what a source cannot take is shared again by weight among the others."""
    left, open_, out = share * sum(sizes), {i for i, s in enumerate(sizes) if s > 0}, [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def shard_draws(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) slots: each shard draws from a multinomial over what the sources have left; what
    a source cannot give is drawn again from the others.  Columns sum to `quotas`."""
    left, out = quotas.astype(np.int64).copy(), np.zeros((shards, len(quotas)), np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    for k in range(shards):
        need = -(-int(left.sum()) // (shards - k))
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += got
            left -= got
            need -= int(got.sum())
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1 (Feistel network with cycle walking), elementwise."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, x = _U((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        a, b = x[todo] >> _U(half), x[todo] & mask
        for r in range(4):
            a, b = b, a ^ (mix64(b + _U((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) & mask)
        x[todo] = (a << _U(half)) | b
        todo &= x >= _U(n)
    return x.astype(np.int64)


def _count(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = text_buffers(batch.column(2))
        sizes = np.zeros(len(offsets) - 1, np.int64)
        for i, j in chunks(offsets, 8 << 20):
            part = data[offsets[i] : offsets[j]]
            ws, at = _WS[part], offsets[i : j + 1] - offsets[i]
            start = ~ws
            start[1:] &= ws[:-1]
            begins = at[:-1][at[:-1] < at[1:]]
            start[begins] = ~ws[begins]
            sizes[i:j] = np.diff(np.searchsorted(np.flatnonzero(start), at))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), batch.column(3)], names=["doc_id", "source", "size", "fp"])


class Mix:
    """A mix of `docs` (doc_id, source, text; further columns are ignored).

    documents: (doc_id, source, size, fp, s, start): the place of each row in its source's words, s being
    the source's number.  slots: (shard, pos, s, epoch, block): what fills each slot of the output.
    parts: (s, start, size, block, from_word, words): the words of a document that lie in a block.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights=WEIGHTS, share: float = SHARE):
        spark: SparkSession = docs.sparkSession
        self.block = block
        rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fp"))
        thin = materialize(rows.mapInArrow(_count, "doc_id long, source string, size long, fp long"), "sizes")
        found = thin.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        self.sources, sizes = [r.source for r in found], [r["size"] for r in found]
        self.targets = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share)
        blocks = [-(-s // block) for s in sizes]
        quotas = np.array([min(MOST * b, round(t * b / s)) if s else 0 for s, b, t in zip(sizes, blocks, self.targets, strict=True)], np.int64)
        n = sum(r.n for r in found)
        info = [(i, s, z, t) for i, (s, z, t) in enumerate(zip(self.sources, sizes, self.targets, strict=True))]
        sources = spark.createDataFrame(info, "s int, name string, source_size long, target double")
        chunk = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(max(1, -(-n // CHUNK_ROWS)))).cast("int")
        thin = thin.join(sources, thin.source.eqNullSafe(sources.name)).drop("name").withColumn("chunk", chunk)
        sums = thin.groupBy("s", "chunk").agg(F.sum("size").alias("words"))
        sums = sums.select("s", "chunk", (F.expr("sum(words) over (partition by s order by chunk)") - F.col("words")).alias("before"))
        inside = F.expr("sum(size) over (partition by s, chunk order by doc_id, size, fp rows between unbounded preceding and current row)")
        thin = thin.withColumn("upto", inside).join(sums, ["s", "chunk"])
        self.documents = materialize(
            thin.select("doc_id", "source", "size", "fp", "s", "source_size", "target", (F.col("before") + F.col("upto") - F.col("size")).alias("start")), "placed"
        )

        total = int(quotas.sum())
        shards = max(LEAST_SHARDS, -(-total // SHARD_SLOTS)) if total else 0
        draws = shard_draws(quotas, shards, seed) if total else np.zeros((0, len(sizes)), np.int64)
        first = np.cumsum(draws, axis=0) - draws
        pos = np.cumsum(draws, axis=1) - draws
        plan = [(k, s, int(first[k, s]), int(draws[k, s]), int(pos[k, s]), int(draws[k].sum()), blocks[s]) for k in range(shards) for s in range(len(sizes)) if draws[k, s]]
        plan_df = spark.createDataFrame(plan, "shard int, s int, first long, n long, pos long, slots long, blocks long")

        def fill(batches):
            import pandas as pd

            for batch in batches:
                for r in batch.itertuples(index=False):
                    for at in range(0, r.n, 1 << 17):  # bounded pieces of a shard's slots
                        i = np.arange(at, min(r.n, at + (1 << 17)))
                        slot, got = r.first + i, np.zeros(len(i), np.int64)
                        epoch = slot // r.blocks
                        for e in np.unique(epoch):
                            m = epoch == e
                            got[m] = permuted(slot[m] % r.blocks, int(r.blocks), seed + 1_000_003 * int(r.s) + int(e))
                        yield pd.DataFrame({"shard": r.shard, "pos": permuted(r.pos + i, int(r.slots), seed + 7_000_003 * (int(r.shard) + 1)), "s": r.s, "epoch": epoch, "block": got})

        self.slots = plan_df.repartition(max(1, min(len(plan), shards)), "shard", "s").mapInPandas(fill, "shard int, pos long, s int, epoch long, block long") if plan else spark.createDataFrame([], "shard int, pos long, s int, epoch long, block long")
        b = F.lit(block)
        spans = self.documents.filter("size > 0").select("s", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
        begin, end = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        self.parts = spans.select("s", "start", "size", "block", (begin - F.col("start")).alias("from_word"), (end - begin).alias("words"))

    def taken(self) -> DataFrame:
        """documents with `taken`: words the mix takes of each, repeats counted."""
        draws = self.slots.groupBy("s", "block").agg(F.count("*").alias("draws"))
        got = self.parts.join(draws, ["s", "block"]).groupBy("s", "start", "size").agg(F.sum(F.col("words") * F.col("draws")).alias("taken"))
        return self.documents.join(got, ["s", "start", "size"], "left").withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`.

    A null text has no words; null sources are one source, the last; a document without words takes
    nothing; repeated rows are placed one after the other and taken independently.  Reruns agree: places
    depend on ids and sizes, draws on a fixed seed, neither on the partitioning.
    """
    return Mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken")


def _cut(batches):
    """Texts cut to the taken words: `runs` holds (first word, words) of neighbouring blocks."""
    import re

    import pyarrow as pa

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for i in range(0, batch.num_rows, 256):  # few texts are held twice at a time
            part, texts = batch.slice(i, 256), []
            for text, runs in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                raw = text.encode()
                starts = [m.start() for m in word.finditer(raw)]
                ends = [*starts[1:], len(raw)]
                runs = sorted((int(r["from_word"]), int(r["words"])) for r in runs)
                if runs and sum(n for _, n in runs) == len(starts):
                    texts.append(text)
                    continue
                texts.append(b"".join(raw[starts[a] : ends[a + n - 1]] for a, n in runs).decode())
            columns = part.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
        pa.default_memory_pool().release_unused()


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of `docs`: for each document a row per time that words of it are
    taken, its text cut to those words (white space kept), n_chars recomputed.  Rows that agree in doc_id,
    source and text count as one document."""
    names, rows = docs.columns, docs.dropDuplicates(["doc_id", "source", "text"]) if _repeats(docs) else docs
    mix = Mix(rows)
    # both sides grow with the words, but Spark's size check sees only what they are made from, a short plan and a table
    # of documents: without the hint it broadcasts them through the driver
    keyed = mix.slots.hint("merge").join(mix.parts, ["s", "block"]).groupBy("s", "start", "size", "epoch").agg(F.collect_list(F.struct("from_word", "words")).alias("runs"))
    keyed = keyed.join(mix.documents.filter("size > 0"), ["s", "start", "size"]).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("fp").alias("_fp"), "runs")
    full = rows.withColumn("_fp2", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    on = full["doc_id"].eqNullSafe(keyed["_id"]) & full["source"].eqNullSafe(keyed["_source"]) & (full["_fp2"] == keyed["_fp"])
    got = full.join(keyed, on).select(*[full[c] for c in names], "runs")
    out = got.mapInArrow(_cut, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _repeats(docs: DataFrame) -> bool:
    key = docs.groupBy("doc_id", F.xxhash64("source", "text")).count()
    return not key.filter("count > 1").isEmpty()
