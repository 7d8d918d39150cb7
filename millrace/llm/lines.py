"""Fuzzy line deduplication over the whole corpus, with DataFrame functions only.

A line's set holds the hashes of its character shingles in lower case: the 12 characters (UTF-16 units) at
every position, or the whole line if it is shorter.  Equal lines are collapsed first, by their text, and each
distinct line is signed once.  Its MinHash minima come from one 64-bit hash per shingle: minimum k is the
hash nearest, by exclusive or, to the fixed point k.  The points are spread evenly over the range, so this is
one-permutation hashing whose empty bins take the nearest other bin.  Bands of 2 of 20 minima give
candidates, confirmed by exact Jaccard on the full sets; distributed union-find groups the links and the
first line of each component, by document and place, stays.

A pair at similarity 0.8 is missed by the 10 bands with probability (1 - 0.8^2)^10 = 4e-5, at 0.9 with 6e-8.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import _U, apart, materialize, mix64

SHINGLE, BANDS, ROWS = 12, 10, 2
MINIMA = BANDS * ROWS
#: Two lines are linked from this Jaccard similarity on.
PERCENT = 80
#: Full sets are compared if so many minima agree: at the threshold 16 do, fewer than 8 with a probability of 1e-4.
LEAST_EQUAL = 8
#: Shingles signed per row, and bands shuffled at once; only size the work.
STEP, BANDS_AT_ONCE = 6, 4
#: Characters are UTF-16 units of two bytes: all shingles have the same length in bytes.
_CODE, _WIDTH = "UTF-16BE", 2 * SHINGLE
#: The place (from 1) of the last shingle of a line u.
_LAST_PLACE = f"greatest(octet_length(u) - {_WIDTH}, 0) + 1"
_BLANKS = " \t\n\x0b\x0c\r"
_LAST = 2**63 - 1
#: A sketch packs 14 bits of each minimum, four to a long in lanes of 15 bits.
_LANES = [sum(0x3FFF << (15 * k) for k in range(4)), sum(0x4000 << (15 * k) for k in range(4))]
_SKETCH, _KEYS = [f"s{k}" for k in range(MINIMA // 4)], [f"b{b}" for b in range(BANDS)]


def _points() -> list[int]:
    """The fixed points of the minima: evenly spread six top bits, pseudorandom low bits."""
    k = np.arange(MINIMA, dtype=np.uint64)
    return ((k * _U(64) // _U(MINIMA) << _U(58)) | (mix64((k + _U(1)) * _U(0x9E3779B97F4A7C15)) >> _U(6))).view(np.int64).tolist()


def shingles(line: str) -> Column:
    """The hashes of the shingles of column `line`, repeats included.  The line is decoded once."""
    return F.expr(f"element_at(transform(array(encode({line}, '{_CODE}')), u -> transform(sequence(1, {_LAST_PLACE}, 2), i -> xxhash64(substring(u, i, {_WIDTH})))), 1)")


def minima(lines: DataFrame) -> DataFrame:
    """id and the MINIMA minima m0, m1, ... of each of `lines(id, line)`, which are distinct in id."""
    wide = lines.select("id", F.encode("line", _CODE).alias("u")).withColumn("last", F.expr(_LAST_PLACE))
    places = wide.select("id", "u", "last", F.expr(f"explode(sequence(1, last, {2 * STEP}))").alias("i"))
    # beyond the last place the last shingle is taken again, which changes no minimum
    grams = places.select("id", *[F.expr(f"xxhash64(substring(u, least(i + {2 * j}, last), {_WIDTH}))").alias(f"g{j}") for j in range(STEP)])
    nearest = [F.min(F.least(*[F.col(f"g{j}").bitwiseXOR(F.lit(p)) for j in range(STEP)])) for p in _points()]
    return grams.groupBy("id").agg(*[m.alias(f"m{k}") for k, m in enumerate(nearest)])


def overlap(pairs: DataFrame) -> DataFrame:
    """a, b, i = |A & B|, u = |A | B| of the full sets of the lines of `pairs(a, b, a_c, b_c)`."""
    both = pairs.select("a", "b", shingles("a_c").alias("x"), shingles("b_c").alias("y"))
    both = both.select("a", "b", "x", "y", F.size(F.array_union("x", "y")).alias("u"))
    # a pair goes without the second count if even sets without repeats would be too far apart
    both = both.filter(100 * (F.size("x") + F.size("y") - F.col("u")) >= PERCENT * F.col("u"))
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), "u")


def as_sets(contents: DataFrame) -> DataFrame:
    """id, c array<long>: the sets of lines `contents(id, c)`."""
    return contents.select("id", F.array_distinct(shingles("c")).alias("c"))


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line that is not blank: did, th (the document's key), pos, line, and its 128-bit hash h1, h2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    # trimming looks at all characters of a line: few have a blank at an end
    blank_end = reduce(Column.__or__, [end("line", F.lit(b)) for end in (F.startswith, F.endswith) for b in _BLANKS])
    rows = rows.select("did", "th", "pos", F.when(blank_end, F.trim("line", F.lit(_BLANKS))).otherwise(F.col("line")).alias("line"))
    # lower case line by line: no letter's depends on what lies beyond a line feed
    rows = rows.filter("line <> ''").select("did", "th", "pos", F.lower("line").alias("line"))
    return rows.select("did", "th", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id, h1, h2, line, copies, first (smallest document) of each distinct line, as a table in the shared
    folder.  Lines are pre-aggregated before the one shuffle of their text."""
    found = _lines(docs).groupBy("h1", "h2", "line").agg(F.count("*").alias("copies"), F.min("did").alias("first"))
    # ids only have to be distinct, and are fixed by the table that is written here
    return materialize(found.select(F.monotonically_increasing_id().alias("id"), "*"), "lines")


def signed(found: DataFrame) -> DataFrame:
    """id, sketch and band keys of each distinct line, as a table in the shared folder."""
    bands = [F.xxhash64(F.lit(b), *[f"m{b + BANDS * r}" for r in range(ROWS)]).alias(_KEYS[b]) for b in range(BANDS)]
    lanes = [F.shiftleft(F.col(f"m{k}").bitwiseAND(F.lit(0x3FFF)), 15 * (k % 4)) for k in range(MINIMA)]
    sketch = [reduce(Column.bitwiseOR, lanes[4 * k : 4 * k + 4]).alias(s) for k, s in enumerate(_SKETCH)]
    return materialize(minima(found.select("id", "line")).select("id", *sketch, *bands), "signed")


def _can_link(a: str, b: str) -> Column:
    add, top = (F.lit(x).cast("long") for x in _LANES)
    differ = [F.bit_count((F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}")) + add).bitwiseAND(top)) for s in _SKETCH]
    return sum(differ[1:], differ[0]) <= MINIMA - LEAST_EQUAL


def line_components(found: DataFrame, text_done=lambda: None) -> DataFrame:
    """(id, component) of the distinct lines that are linked with another.  text_done() is called when
    `found` is not read again."""
    def contents(ids: DataFrame) -> DataFrame:
        return found.select("id", F.col("line").alias("c")).join(ids.hint("shuffle_hash"), "id", "left_semi")

    marks = signed(found)
    bands = [marks.select(F.explode(F.array(*_KEYS[b : b + BANDS_AT_ONCE])).alias("key"), "id") for b in range(0, BANDS, BANDS_AT_ONCE)]

    def done(what: str) -> None:
        if what == "rows":
            common.discard(marks)
        else:
            text_done()

    return common.link_components(marks.select("id", *_SKETCH), bands, contents, PERCENT, _can_link, overlap, as_sets, done)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(did, th, drops array<int>): the places of the lines that go, per document that loses any."""
    found = distinct_lines(docs)
    keys: list[DataFrame] = []

    def text_done() -> None:
        keys.append(materialize(found.select("id", "h1", "h2", "copies", "first"), "line-keys"))
        common.discard(found)

    comp = line_components(found, text_done)
    # lines that stand alone need no second look
    shared = keys[0].join(comp.select(apart("id").alias("of"), "component"), F.col("id") == F.col("of"), "left").filter("component is not null or copies > 1")
    shared = shared.select("h1", "h2", F.coalesce("component", "id").alias("component"), "first")
    lead = shared.groupBy("component").agg(F.min("first").alias("lead")).select(apart("component").alias("of"), "lead")
    shared = shared.join(lead, F.col("component") == F.col("of")).select(apart("h1").alias("k1"), apart("h2").alias("k2"), "component", "lead")
    places = _lines(docs).select("did", "th", "pos", "h1", "h2").join(shared, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    places = materialize(places.select("did", "th", "pos", "component", "lead"), "places")
    # the first place of each component is the first in its smallest document; all its other lines go
    led = places.filter("did = lead")
    first = led.groupBy("component").agg(F.min(F.struct("th", "pos")).alias("f")).select(apart("component").alias("of"), "f")
    rest = led.join(first, F.col("component") == F.col("of")).filter("th <> f.th or pos <> f.pos").select("did", "th", "pos")
    gone = places.filter("did <> lead").select("did", "th", "pos").union(rest)
    common.discard(keys[0])
    return gone.groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped array<int> for every row of `docs`.

    Lines are cut at line feeds and numbered from 0; white space around a line is ignored.  A null or empty
    text is one empty line; blank lines take no part.  Rows that agree in doc_id and
    text are one document; null ids come last.  Further columns are ignored.
    """
    drops = dropped_lines(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"),
        F.xxhash64(text).alias("th"),
        F.size(F.split(text, "\n")).alias("n_lines"),
    )
    none = F.array().cast("array<int>")
    out = thin.join(drops, ["did", "th"], "left").select("doc_id", "n_lines", F.coalesce("drops", none).alias("dropped"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the lines that repeat an earlier one.  Documents that lose all their lines go;
    n_chars is recomputed where lines were taken out.  Null and blank texts stay as they are; null ids come
    last, rows that agree in doc_id and text are one document, and further columns are kept."""
    drops = dropped_lines(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("_th", F.xxhash64(text))
    drops = drops.select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("drops").alias("_drops"))
    out = keyed.join(drops, ["_did", "_th"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains("_drops", i)), "\n")
    out = out.withColumn("text", F.when(F.col("_drops").isNull(), F.col("text")).otherwise(kept))
    out = out.filter("_drops is null or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_drops").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
