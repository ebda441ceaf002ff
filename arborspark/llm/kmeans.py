"""Centroid clustering by plain Lloyd rounds over integer vectors.

Vectors become integers, ``floor(scale * x)``, so every sum and distance is exact and a
rerun gives the same clusters whatever the partitioning. The first centroids are the
``k`` vectors with the smallest hash of their id. In each round the centroids are
broadcast (k vectors, whatever the table's size), ``mapInPandas`` computes the integer
squared differences to each centroid in NumPy and takes the lowest index of the
smallest sums; each partition hands on one row a cluster and component, these partial
sums merge through ``groupBy``, and a cluster's new centroid is the exact floor of
sum / count. No vector is ever shuffled: a round moves at most k * dims rows a
partition, and k * dims rows come to the driver.

Arithmetic is 64-bit where a bound on the batch shows that it fits, else in unbounded
integers.

Cases: vectors that are null, of another length, or hold null or non-finite components
take no part; with fewer than k vectors there are as many centroids; an empty
table gives no rows; ties of distance go to the smaller number; ties of the hash
(repeated ids) to the smaller vector; null ids are clustered like others but start no
centroid unless too few have an id; repeated rows each keep their row; a component
beyond 2**62 after scaling, or a distance beyond a long, is an error; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut

LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.transform(col(embedding), lambda c: c.cast("double"))
    fine = (F.size(col(embedding)) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = lambda c: F.when(F.abs(c * scale) < float(1 << 62), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large to be scaled"))).cast("long")
    return vectors.where(col(embedding).isNotNull() & fine).select(col(vec_id).alias("vec_id"), F.transform(x, whole).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in order of the hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of v; the smaller number of equals."""
    reach = max(abs(int(m)) for m in (v.min(), v.max())) + max(abs(int(m)) for m in (centroids.min(), centroids.max()))
    if v.shape[1] * reach**2 > LONG:
        v, centroids = v.astype(object), centroids.astype(object)
    far = np.empty((len(v), len(centroids)), v.dtype)
    for j, c in enumerate(centroids):
        gap = v - c
        far[:, j] = (gap * gap).sum(1)
    best = far.argmin(1)
    least = far[np.arange(len(v)), best]
    if v.dtype == object and int(least.max()) > LONG:
        raise OverflowError("a squared distance does not fit a long")
    return best, least.astype(np.int64)


def _partial_sums(centroids: Broadcast):
    """(cluster, dim, total, n) of a partition, one row a cluster and component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dims = centroids.value.shape
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["v"].to_numpy())
            best, _ = nearest(v, centroids.value)
            if len(v) * max(abs(int(v.min())), abs(int(v.max()))) > LONG:
                v = v.astype(object)
            for j in np.unique(best):
                own = v[best == j]
                sums[j] += own.sum(0).astype(object)
                counts[j] += len(own)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({
            "cluster": np.repeat(used, dims).astype(np.int32), "dim": np.tile(np.arange(dims), len(used)).astype(np.int32),
            "total": [Decimal(int(x)) for x in sums[used].ravel()], "n": np.repeat(counts[used], dims),
        })

    return run


def _assign(centroids: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best, least = nearest(np.stack(b["v"].to_numpy()), centroids.value)
                yield pd.DataFrame({"id": b["id"], "cluster": best.astype(np.int32), "distance": least})

    return run


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; those without vectors stay."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    parts = kept.select("v").mapInPandas(_partial_sums(shared), "cluster int, dim int, total decimal(38,0), n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k * dims rows at most
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, vec_id: str = "vec_id", embedding: str = "embedding", *, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>): each
    vector's cluster after ``rounds`` rounds and its squared distance, the sums of these
    over its cluster and over all, and its cluster's centroid."""
    kept = quantised(vectors, vec_id, embedding, dims, scale)
    kind = kept.schema["vec_id"].dataType
    spark = kept.sparkSession
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        numbers = [F.lit(0).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))]
        return kept.where("false").select("vec_id", *numbers, F.col("v").alias("centroid"))
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    shared = spark.sparkContext.broadcast(centroids)
    # ids travel as strings: pandas would turn longs with nulls into doubles
    assigned = kept.select(F.col("vec_id").cast("string").alias("id"), "v").mapInPandas(_assign(shared), "id string, cluster int, distance long")
    assigned = cut(assigned.select(F.col("id").cast(kind).alias("vec_id"), "cluster", "distance"))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    total = sum(sums.values())
    facts = spark.createDataFrame([(j, s, total, centroids[j].tolist()) for j, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
