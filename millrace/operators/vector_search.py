"""Vector search over a table: exact k-NN, filtered search, inverted lists, quantisers, layered graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def knn(df: DataFrame, vec_col: str, query: list[float], k: int, metric: str = "euclidean", id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest rows, by distance then id.  A filter runs before the ranking, so k matches are found
    if there are k.  One top-k per partition, no global sort."""
    q = F.lit([float(x) for x in query])
    rows = df if where is None else df.filter(where)
    return rows.select(id_col, V.distance(metric, F.col(vec_col), q).alias("distance")).orderBy("distance", id_col).limit(k)


def _near(v: Column):
    """struct(distance, index) of a centroid, for a transform over centroids."""
    return lambda c, i: F.struct(V.squared_euclidean(v, c).alias("d"), i.alias("i"))


class InvertedLists:
    """IVF: vectors are assigned to their nearest k-means centroid; a search probes the nearest lists only."""

    def __init__(self, df: DataFrame, vec_col: str, id_col: str = "vec_id", lists: int = 100, seed: int = 42, iterations: int = 25, sample: int = 100_000):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.id_col, self.vec_col = id_col, vec_col
        train = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
        total = train.count()
        if total > sample:  # centroids come from a bounded sample, every row is assigned
            train = train.sample(sample / total, seed)
        model = KMeans(k=max(2, min(lists, total)), seed=seed, maxIter=iterations, initMode="k-means||").fit(train)
        self.centroids = [c.tolist() for c in model.clusterCenters()]
        self.rows = df.withColumn("list_id", self.assign(F.col(vec_col)))

    def assign(self, v: Column) -> Column:
        cents = F.array(*[F.lit(c) for c in self.centroids])
        return F.array_min(F.transform(cents, _near(v))).i

    def search(self, query: list[float], k: int, probes: int = 10, metric: str = "euclidean") -> DataFrame:
        d = [float(((np.array(c) - np.array(query)) ** 2).sum()) for c in self.centroids]
        near = [int(i) for i in np.argsort(d)[:probes]]
        return knn(self.rows.filter(F.col("list_id").isin(near)), self.vec_col, query, k, metric, self.id_col)


class ScalarQuantizer:
    """Per-dimension minimum and maximum; components become 0 .. 255."""

    def __init__(self, df: DataFrame, vec_col: str):
        at = df.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x"))
        got = at.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()  # one row per dimension
        self.lo, self.hi = [r.lo for r in got], [r.hi for r in got]

    def encode(self, v: Column) -> Column:
        span = F.lit([max(h - low, 1e-12) for low, h in zip(self.lo, self.hi, strict=True)])
        scaled = F.zip_with(F.zip_with(v.cast("array<double>"), F.lit(self.lo), lambda x, a: x - a), span, lambda x, s: x / s * 255)
        return F.transform(scaled, lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))).cast("int"))

    def decode(self, codes: Column) -> Column:
        step = F.lit([(h - low) / 255 for low, h in zip(self.lo, self.hi, strict=True)])
        return F.zip_with(F.zip_with(codes, step, lambda c, s: c * s), F.lit(self.lo), lambda x, a: x + a)


class ProductQuantizer:
    """Centroids per slice of the dimensions, trained on about `sample` rows at most; distances to a query come from per-slice tables."""

    def __init__(self, df: DataFrame, vec_col: str, parts: int = 8, centroids: int = 256, iterations: int = 25, seed: int = 42, sample: int = 100_000):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        dim = len(df.select(vec_col).first()[0])
        if dim % parts:
            raise ValueError(f"{dim} dimensions do not split into {parts} parts")
        self.width, self.books = dim // parts, []
        total = df.count()
        train = (df.sample(sample / total, seed) if total > sample else df).select(F.col(vec_col).cast("array<double>").alias("v")).persist()
        for p in range(parts):
            part = train.select(array_to_vector(F.slice("v", p * self.width + 1, self.width)).alias("features"))
            model = KMeans(k=centroids, seed=seed, maxIter=iterations).fit(part)
            self.books.append([c.tolist() for c in model.clusterCenters()])
        train.unpersist()

    def encode(self, v: Column) -> Column:
        codes = []
        for p, book in enumerate(self.books):
            part = F.slice(v.cast("array<double>"), p * self.width + 1, self.width)
            codes.append(F.array_min(F.transform(F.array(*[F.lit(c) for c in book]), _near(part))).i)
        return F.array(*codes)

    def table(self, query: list[float]) -> list[list[float]]:
        q = np.array(query).reshape(len(self.books), self.width)
        return [((np.array(book) - q[p]) ** 2).sum(axis=1).tolist() for p, book in enumerate(self.books)]

    def distance(self, codes: Column, query: list[float]) -> Column:
        total = F.lit(0.0)
        for p, row in enumerate(self.table(query)):
            total = total + F.element_at(F.lit(row), F.element_at(codes, p + 1) + 1)
        return F.sqrt(total)


class BinaryQuantizer:
    """One bit per dimension, set above the dimension's median; Hamming distance on packed longs."""

    def __init__(self, df: DataFrame, vec_col: str):
        at = df.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x"))
        got = at.groupBy("i").agg(F.percentile("x", 0.5).alias("m")).orderBy("i").collect()
        self.median = [r.m for r in got]

    def encode(self, v: Column) -> Column:
        words = []
        for at in range(0, len(self.median), 63):
            bits = [F.when(F.element_at(v, i + 1) > self.median[i], F.lit(1 << (i - at)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(at, min(at + 63, len(self.median)))]
            word = bits[0]
            for b in bits[1:]:
                word = word.bitwiseOR(b)
            words.append(word)
        return F.array(*words)


def layered_graph_search(df: DataFrame, vec_col: str, queries: list[list[float]], k: int, id_col: str = "vec_id", m: int = 16, ef: int = 200, seed: int = 42) -> DataFrame:
    """HNSW per partition (levels by a geometric law, m links, 2m on the ground level), merged top k.

    (query, vec_id, distance); the graph lives in the task that builds it, its size is a partition's.
    """
    from .layered_graph import LayeredGraph

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches):
        import pandas as pd

        ids, vecs = [], []
        for b in batches:
            ids += b["id"].tolist()
            vecs += list(b["v"])
        if ids:
            g = LayeredGraph(np.array(vecs), m, ef, seed)
            for qi, q in enumerate(queries):
                got = g.search(np.array(q), k, max(k, ef // 2))
                yield pd.DataFrame({"query": qi, "vec_id": [ids[i] for _, i in got], "distance": [d for d, _ in got]})

    found = rows.mapInPandas(run, "query int, vec_id long, distance double")
    rank = F.expr("row_number() over (partition by query order by distance, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
