"""Table operators beyond plain SELECT: DML as rewrites, as-of and range joins, partitioners, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- DML as DataFrame rewrites
def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """target with rows appended by column name; columns that rows lacks become null."""
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def update(target: DataFrame, assignments: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Assign where the predicate is true (null counts as false); types stay those of the target."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    kinds = {f.name: f.dataType for f in target.schema}
    unknown = set(assignments) - set(kinds)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return target.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in assignments else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which the predicate is not true; without one, none (truncate)."""
    return target.limit(0) if where is None else target.filter(~F.coalesce(where, F.lit(False)))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace the target's rows of equal key; others are appended."""
    kept = target.join(rows.select(*keys).distinct(), keys, "left_anti").select(*target.columns)
    return kept.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def merge(target: DataFrame, source: DataFrame, keys: list[str], matched_update: dict[str, Column] | None = None, matched_delete: Column | None = None, insert_unmatched: bool = True) -> DataFrame:
    """MERGE: matched rows are updated or deleted, unmatched source rows inserted.

    Expressions use the aliases t and s.  One full outer join on the keys.  As the standard has it, a target
    row that several source rows match is an error, raised when the result is computed."""
    per_key = Window.partitionBy(*keys)
    source = source.withColumn("_n", F.count("*").over(per_key))
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    both = F.col("t._t").isNotNull() & F.col("s._s").isNotNull()
    j = t.join(s, on, "full")
    # the check is part of a filter that no optimisation can drop
    j = j.filter(F.when(both & (F.col("s._n") > 1), F.raise_error(F.lit("MERGE: several source rows match one target row")).cast("boolean")).otherwise(F.lit(True)))
    if matched_delete is not None:
        j = j.filter(~F.coalesce(both & matched_delete, F.lit(False)))
    if not insert_unmatched:
        j = j.filter(F.col("t._t").isNotNull())
    out = []
    for c in target.columns:
        own = F.col(f"t.{c}")
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        value = F.when(F.col("t._t").isNull(), new)
        if matched_update and c in matched_update:
            value = value.when(both, matched_update[c])
        out.append(value.otherwise(own).alias(c))
    return j.select(*out)


def as_of(versions: DataFrame, txn: int) -> DataFrame:
    """Rows visible to transaction `txn` of a table with xmin and xmax."""
    return versions.filter((F.col("xmin") <= txn) & (F.col("xmax").isNull() | (F.col("xmax") > txn))).drop("xmin", "xmax")


def with_sequence(df: DataFrame, name: str, order: list[str], start: int = 1, step: int = 1, ranges: int = 0) -> DataFrame:
    """Sequence values without gaps in `order`: rows are numbered within ranges, then shifted by the ranges' counts.

    The ranges are explicit: their bounds are approximate quantiles of the first column of `order`, so that
    counting and numbering agree however Spark deals the rows.  Rows equal in that column share a range; rows
    equal in all of `order` are numbered in any order.  Nulls come first.  `ranges` defaults to the shuffle partitions."""
    spark, first = df.sparkSession, order[0]
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[first].dataType
    key = F.col(first)
    if isinstance(kind, T.NumericType):
        at = key.cast("double")
    elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        at = key.cast("timestamp").cast("double")
    else:  # the first bytes of the text, as a number that grows with it
        at = F.conv(F.rpad(F.hex(F.substring(key.cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    bounds = df.agg(F.percentile_approx(at, [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = sorted({b for b in bounds if b == b})
    part = F.coalesce(F.aggregate(F.lit(bounds).cast("array<double>"), F.lit(0), lambda s, b: s + F.when(at > b, 1).otherwise(0)), F.lit(-1)) if len(bounds) <= 64 else F.coalesce(F.size(F.filter(F.lit(bounds), lambda b: at > b)), F.lit(-1))
    part = F.when(key.isNull(), -1).otherwise(part)
    rows = df.withColumn("_p", part)
    counts = {r._p: r["count"] for r in rows.groupBy("_p").count().collect()}  # a row per range
    if not counts:
        return df.withColumn(name, F.lit(None).cast("long"))
    total, base = 0, []
    for p in sorted(counts):
        base += [F.lit(p), F.lit(total)]
        total += counts[p]
    number = F.row_number().over(Window.partitionBy("_p").orderBy(*order)).cast("long") - 1
    return rows.withColumn(name, F.lit(start) + (number + F.element_at(F.create_map(*base), F.col("_p"))) * step).drop("_p")


# --- joins that have no operator of their own
def as_of_join(left: DataFrame, right: DataFrame, by: list[str], time: str, keep: list[str], prefix: str = "r_") -> DataFrame:
    """Each left row with the latest right row of equal key whose time is not later: one union and one
    window over key and time, no inequality join.  A null key matches nothing, nor does a null time."""
    absent = F.lit(False)
    for c in [*by, time]:
        absent = absent | F.col(c).isNull()
    right = right.filter(~absent)
    cols = [c for c in left.columns]
    a = left.select(F.struct(*cols).alias("_l"), *by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*keep)).schema[0].dataType).alias("_r"))
    b = right.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), *by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(*keep).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    out = out.withColumn("_r", F.when(~F.coalesce(F.expr(" or ".join(f"_l.`{c}` is null" for c in [*by, time])), F.lit(False)), F.col("_r")))
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(f"{prefix}{c}") for c in keep])


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= value < high by an equi-join on buckets of `width`, then the exact test.

    Points meet each distinct range once; then the rows that share a range stream past its points by sort-merge,
    on as many tasks as there are shuffle partitions, whatever the bytes.  A result may have as many rows as
    points times ranges: so it is formed last and not shuffled, neither side is held whole, and a row's points
    come one after another, in the same order for all rows of a range, which columnar files keep small."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # bounds as text: Spark normalizes floats that are join keys, and would shuffle once more for that
    keys = [F.col(low).cast("string").alias("_k0"), F.col(high).cast("string").alias("_k1")]
    each = ranges.select("*", *keys).repartition(n, "_k0", "_k1")
    bounds = ranges.select(F.col(low).alias("_lo"), F.col(high).alias("_hi"), *keys).distinct()
    bounds = bounds.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    near = points.withColumn("_b", F.floor(F.col(value) / width)).join(bounds, "_b")
    near = near.filter((F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi"))).select(*points.columns, "_k0", "_k1").repartition(n, "_k0", "_k1")
    return each.hint("merge").join(near, ["_k0", "_k1"]).select(*points.columns, *ranges.columns)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: int = 16, how: str = "inner", share: float = 0.01) -> DataFrame:
    """Join whose hot keys are dealt over `hot` tasks: rows of `big` with such a key take a salt, rows of `small`
    all salts; other keys are joined as they are.  Hot are keys with more than `share` of the rows of `big`, so
    that there are at most 1 / share of them.  Kinds: inner, left, left_semi and left_anti, in which no row of
    `small` stands for itself."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join: {how!r} would repeat rows of the small side")
    total = big.count()
    often = [r for r in big.groupBy(*keys).count().filter(F.col("count") > share * total).drop("count").collect() if None not in tuple(r)]
    is_hot = lambda: reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.col(k) == F.lit(r[k]) for k in keys]) for r in often], F.lit(False))
    salt = F.when(F.coalesce(is_hot(), F.lit(False)), F.pmod(F.monotonically_increasing_id(), F.lit(hot)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.coalesce(is_hot(), F.lit(False)), F.sequence(F.lit(0), F.lit(hot - 1))).otherwise(F.array(F.lit(0)))
    return big.withColumn("_salt", salt).join(small.withColumn("_salt", F.explode(every)), [*keys, "_salt"], how).drop("_salt")


# --- exchange
def partition(df: DataFrame, scheme: str, n: int = 0, columns: list[str] | None = None) -> DataFrame:
    """single, round_robin, hash or range partitioning."""
    if scheme == "single":
        return df.coalesce(1)
    if scheme == "round_robin":
        return df.repartition(n)
    if scheme in ("hash", "range") and columns:
        return df.repartition(n, *columns) if scheme == "hash" else df.repartitionByRange(n, *columns)
    raise ValueError(f"unknown scheme {scheme!r} or no columns")


def _range_of(column: str, bounds: list) -> Column:
    """The range i with bounds[i - 1] <= value < bounds[i]; nulls are in the first."""
    place = F.lit(0)
    for b in sorted(bounds):
        place = place + F.when(F.col(column) >= F.lit(b), 1).otherwise(0)
    return place.cast("int")


def parts_by_bounds(df: DataFrame, column: str, bounds: list, rows: int) -> list[int]:
    """For each range the number of partitions that leaves at most about `rows` rows to each; one count per range is collected."""
    n = {r._r: r["count"] for r in df.groupBy(_range_of(column, bounds).alias("_r")).count().collect()}
    return [max(1, -(-n.get(i, 0) // rows)) for i in range(len(bounds) + 1)]


def partition_by_bounds(df: DataFrame, column: str, bounds: list, parts: list[int] | None = None) -> DataFrame:
    """Range partitioning by given bounds: row partition i holds bounds[i - 1] <= value < bounds[i]; nulls go to the first.

    Given bounds may put most rows into one range.  With `parts`, range i is dealt in turn over parts[i]
    partitions, which follow those of the ranges before it."""
    place = _range_of(column, bounds)
    if parts is None:
        return df.repartitionById(len(bounds) + 1, place)
    at = lambda x: F.element_at(F.array(*map(F.lit, x)), place + 1)
    firsts = [sum(parts[:i]) for i in range(len(parts))]
    return df.repartitionById(sum(parts), (at(firsts) + F.pmod(F.monotonically_increasing_id(), at(parts))).cast("int"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group (Spark limits groups before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose foreign key has no parent (null keys are allowed)."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def analyze(df: DataFrame) -> DataFrame:
    """(column, n, nulls, distinct, low, high) of every column in one pass with sketches for distinct."""
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")) for c in df.columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def split_by_hash(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """A column `split` drawn from the key's hash: reruns and new rows leave old assignments alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8)
    u = F.conv(digits, 16, 10).cast("long") / F.lit(2**32)
    total, upto, out = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        upto += share / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))


def features(df: DataFrame, entity: str, names: list[str], ids: DataFrame | None = None) -> DataFrame:
    """A feature group's columns for the wanted entities."""
    out = df.select(entity, *names)
    return out if ids is None else out.join(ids.select(entity).distinct(), entity)
