"""Shared helpers: scratch tables, exact word hashing in numpy, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle files go at the end of a query, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


# --------------------------------------------------------------------------- scratch tables
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder.  A
    temporary one only where neither is set and the master is a single local process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _own_dir:
        _own_dir["own"] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own_dir["own"]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: lineage ends here, and a
    lost executor costs a re-read, not a re-computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)  # a new query, which takes up the setting
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    spark._jvm.System.gc()  # the driver's collector is what lets go of the shuffle files of earlier plans
    trim_native(spark)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def trim_native(spark: SparkSession) -> str | None:
    """Hand what the driver's JVM has freed outside its heap back to the system; returns the JVM's answer.
    The compiler's and the codecs' arenas stay with the C library otherwise, some 200 MB over a few hundred
    queries.  Where the JVM has no such command it is None, and all stays as it is."""
    jvm = spark._jvm
    try:
        # by the interface's method: the server's own class is not open to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return None


def discard(df: DataFrame | None) -> None:
    """Remove a table made by `materialize` that nothing will read again."""
    path = getattr(df, "_millrace_path", None)
    if path:
        _remove(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --------------------------------------------------------------------------- numpy hashing
_U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = 1 << int(n - 1).bit_length()
        _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, 0x5851F42D4C957F2D, np.uint64)]))
    return _POW


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; nulls count as empty."""
    import pyarrow as pa

    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int):
    """Runs (i, j) of rows of at most `limit` bytes each, or one row if it is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts `data[offsets[i]:offsets[i+1]]`, and the first word of
    each text (len(offsets) entries)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ws = _WS[data]
    start = ~ws
    start[1:] &= ws[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[at] = ~ws[at]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), first
    spans = np.diff(np.append(starts, n))
    base = starts[0]
    pos = np.arange(base, n, dtype=np.int64)
    pos -= np.repeat(starts, spans)
    word = ~ws[base:]
    longest = int(pos[word].max()) + 1
    np.minimum(pos, longest - 1, out=pos)
    text = data[base:]
    vals = _BYTE[_LOWER[text] if lower else text]
    vals *= _powers(longest)[pos]
    vals *= word
    return mix64(np.add.reduceat(vals, starts - base)), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles: with fewer than k words
    the whole sequence is one shingle; without words the set is empty."""
    w, first = word_hashes(data, offsets)
    coef = _powers(k + 1)
    none = np.zeros(0, np.uint64)
    if len(w) >= k:
        grams = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            grams += w[j : len(w) - k + 1 + j] * coef[j]
        grams = mix64(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            short = (w[a:b] * coef[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + np.full(1, b - a, np.uint64) * _U(0xD1B54A32D192ED03)))
        else:
            out.append(none)
    return out


# --------------------------------------------------------------------------- connected components
def apart(column: str) -> Column:
    """`column` itself, in a form whose exchange Spark does not take from an aggregation: both sides of a
    join are then plain shuffles, so that adaptive execution can split a hot key."""
    return F.col(column).bitwiseXOR(F.lit(0).cast("long"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of `edges(a, b)`; component is the smallest id reachable.

    Distributed union-find by alternating large-star and small-star: every round is an aggregation with
    map-side minimum and a join whose hot keys (hubs) adaptive execution can split; rounds are cut by
    tables in the shared folder.  The number of rounds is logarithmic in the longest path, and the last is
    the first that leaves stars only.
    """
    now = materialize(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
    )
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 or (up > 0 and low > 0)").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u").select(apart("u").alias("y"), "m")
        # an edge (u, v), u > v, becomes (u, smallest neighbour of v or v)
        large = now.join(low, F.col("v") == F.col("y"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(apart("u").alias("y"), "m")
        small = large.join(low, F.col("u") == F.col("y")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialize(small.distinct(), "cc")
        discard(now)
        now = new
    else:
        raise RuntimeError(f"connected_components: no fixed point after {max_rounds} rounds")
    low = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(low)


# --------------------------------------------------------------------------- linking within buckets
#: Buckets of up to so many members are compared pair by pair.  Sizes the work only: larger ones are compared exactly too.
SMALL = 64


def array_overlap(pairs: DataFrame) -> DataFrame:
    """a, b, i = |A & B|, u = |A | B| of `pairs(a, b, a_c, b_c)`, whose sets are arrays without repeats."""
    both = pairs.select("a", "b", F.size(F.array_intersect("a_c", "b_c")).alias("i"), (F.size("a_c") + F.size("b_c")).alias("n"))
    return both.select("a", "b", "i", (F.col("n") - F.col("i")).alias("u"))


def link_components(rows: DataFrame, bands: DataFrame | list[DataFrame], contents, percent: int, can_link, overlap=array_overlap, as_sets=lambda c: c, done=lambda what: None) -> DataFrame:
    """(id, component) of the sets that are linked with any other, in the graph whose candidate links are
    the pairs that share a bucket and whose links have 100 |A & B| >= percent |A | B|.

    rows: (id, sketch columns ...), one row per distinct set.  bands: (key, id), a row per bucket that a set
    is in; of several such tables, which share no bucket, each is shuffled by itself.  done("rows") is called
    when rows and bands are not read again, done("contents") when contents is not.  contents(ids) gives (id, c), what a set is made of; overlap(pairs) gives the sizes of the
    intersection and union of two of them, and as_sets(contents) turns c into the set as array<long>.
    can_link(a, b) is a cheap necessary condition on the sketches of two rows, given by their column
    prefixes.

    No all-pairs expansion.  First every set is compared to the leaders (smallest ids) of its buckets, at
    most one comparison per bucket, and the links found are closed.  What is left are buckets that hold
    several components and a third member.  In those of up to SMALL members, a fixed number, pairs across
    components that pass `can_link` are compared.  In larger ones only pairs are that moreover share an
    element among the first n - k + 1 of both, rarest first, k being what linked sets of their sizes have in
    common at least: an exact condition, which near copies below the threshold mostly fail.  One set per
    element and component goes first, then all, and a pair is formed at the first element that it shares.
    So a group of copies costs about as many comparisons as it has members, and no candidate that could
    join two components is left out.
    """
    stars = []
    for part in bands if isinstance(bands, list) else [bands]:
        buckets = part.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("size")).filter("size > 1")
        stars.append(materialize(part.join(buckets.select(apart("key").alias("of"), "leader", "size").hint("shuffle_hash"), F.col("key") == F.col("of")).drop("of"), "star"))
    star = reduce(DataFrame.union, stars)
    members = star.select("id").distinct()
    sketches = materialize(rows.join(members.hint("shuffle_hash"), "id", "left_semi"), "sketches")
    done("rows")
    held = materialize(contents(members), "contents")
    done("contents")

    def side(df: DataFrame, s: str, *but: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c in but else s if c == "id" else f"{s}_{c}") for c in df.columns])

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(held, "b"), "b").join(side(held, "a"), "a")
        return overlap(both.select("a", "b", "a_c", "b_c")).filter(f"i > 0 and 100 * i >= {percent} * u").select("a", "b")

    pairs = star.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(side(sketches, "b"), "b").join(side(sketches, "a"), "a").filter(can_link("a", "b")).select("a", "b")
    tested = [materialize(pairs, "pairs")]
    comp = materialize(connected_components(confirmed(tested[0])), "comp")

    def close(more: DataFrame) -> None:
        nonlocal comp
        links = materialize(confirmed(more), "links")
        if not links.isEmpty():
            old, stars = comp, comp.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
            comp = materialize(connected_components(stars.union(links)), "comp")
            discard(old)
        discard(links)

    def untested(pairs: DataFrame) -> DataFrame:
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        tested.append(materialize(pairs, "cross"))
        return tested[-1]

    def now_in(df: DataFrame) -> DataFrame:
        of = comp.select(F.col("id").alias("of"), F.col("component").alias("now"))
        return df.join(of, F.col("id") == F.col("of"), "left").withColumn("comp", F.coalesce("now", "id")).drop("of", "now")

    def mixed(df: DataFrame, key: str) -> DataFrame:
        """Rows of `df` (key, id, ...) with comp, of the keys that lie in several components."""
        df = now_in(df)
        some = df.groupBy(key).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select(apart(key).alias("of"))
        return materialize(df.join(some.hint("shuffle_hash"), F.col(key) == F.col("of"), "left_semi"), "mixed")

    third = mixed(star.filter("size > 2").select("key", "id", "size"), "key")
    small = third.filter(f"size <= {SMALL}").join(sketches, "id")
    cross = side(small, "a", "key").join(side(small, "b", "key"), "key").filter("a < b and a_comp <> b_comp").filter(can_link("a", "b"))
    close(untested(cross.select("a", "b").distinct()))
    large = mixed(third.filter(f"size > {SMALL}").select("key", "id"), "key")
    discard(third)
    third = large.select("id").distinct()
    if not large.isEmpty():
        sets = as_sets(held.join(third, "id").select("id", "c"))
        tokens = sets.select("id", F.size("c").alias("n"), F.explode("c").alias("token"))
        # elements of one set only come first in every order and meet no other set: they just use up the prefix
        ranked = tokens.withColumn("df", F.expr("count(*) over (partition by token)")).filter("df > 1")
        ranked = ranked.withColumn("r", F.expr("n - count(*) over (partition by id) + row_number() over (partition by id order by df, token)"))
        cut = ranked.filter(f"r <= n - ceil(n * {percent} / 100D - 1e-9) + 1").select("id", "token", "r", "n")
        heads = cut.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("r", "token"))).alias("p"))
        heads = materialize(sketches.drop("n").join(heads, "id"), "heads")
        least = f"ceil({percent} * (a_n + b_n) / {100 + percent}D - 1e-9)"  # elements that two linked sets share
        for limit in (1, None):  # first one set per element and component, then all: links merge components early
            now = now_in(heads).withColumn("x", F.explode("p")).withColumns({"r": F.col("x.r"), "token": F.col("x.token"), "p": F.col("p.token")}).drop("x")
            now = now.withColumns({"c0": F.expr("min(comp) over (partition by token)"), "c1": F.expr("max(comp) over (partition by token)")}).filter("c0 <> c1").drop("c0", "c1")
            if limit:
                now = now.withColumn("k", F.expr("row_number() over (partition by token, comp order by id)")).filter(f"k <= {limit}").drop("k")
            cross = side(now, "a", "token").join(side(now, "b", "token"), "token").filter("a < b and a_comp <> b_comp")
            cross = cross.filter(f"a_r <= a_n - {least} + 1 and b_r <= b_n - {least} + 1").filter(can_link("a", "b"))
            close(untested(cross.filter("element_at(array_intersect(a_p, b_p), 1) = token").select("a", "b").distinct()))
        discard(heads)
    for x in (*stars, large, held, sketches, *tested):
        discard(x)
    return comp
