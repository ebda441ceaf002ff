"""Exact top-k inner products by an impact-ordered score-at-a-time index.

Candidates are cut into shards of bounded size and queries into blocks of bounded
size; every block meets every shard once (a stated query set against all rows, in
blocks). A meeting's shard is read and indexed first, and then its queries pass by one
after another, so memory is bounded by the shard and an index serves a whole block.
In a shard, each dimension's postings
(vector, integer component) are ordered by magnitude and cut into segments of one
quantised impact (its power-of-two level). A query takes the segments of all its
dimensions by descending |query component| * segment bound and adds the exact
products to the accumulators. What is still unprocessed can change a score by
at most the sum over dimensions of |query component| * bound of the next segment;
processing stops only when that proves that at most ``RESCORE`` of the shard's
vectors can still reach the k-th best. These are rescored exactly.

The k best of each meeting are merged by a window over the query. Ties go to the
smaller id.

Cases: null vectors, vectors with null or non-finite components and rows without
id take no part; rows that repeat the query's id are its own; shorter vectors
count as padded with zeros; with fewer than k candidates all are returned; an
empty table gives an empty result; sums that could leave 64 bits are done in unbounded
integers, and a result beyond a long is an error; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, col

SHARD = 8192
QUERIES = 1 << 16
#: Share of a shard that may be left for exact rescoring.
RESCORE = 1 / 8


class Shard:
    """Impact-ordered index of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, dims = self.vectors.shape
        size = np.abs(self.vectors)
        level = np.zeros_like(size)
        level[size > 0] = np.log2(size[size > 0]).astype(np.int64) + 1
        self.segments: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # dimension, bound, vectors, impacts
        for d in range(dims):
            by = np.argsort(-level[:, d], kind="stable")
            cuts = np.flatnonzero(np.diff(level[by, d])) + 1
            for part in np.split(by, cuts):
                if len(part) and (bound := int(size[part, d].max())):
                    self.segments.append((d, bound, part, self.vectors[part, d]))
        self.dims = np.array([s[0] for s in self.segments], int)
        self.bounds = np.array([s[1] for s in self.segments], np.int64)
        # bound of the dimension's next segment once this one is done
        self.after = np.zeros(len(self.segments), np.int64)
        for i in range(len(self.segments) - 1):
            if self.dims[i] == self.dims[i + 1]:
                self.after[i] = self.bounds[i + 1]

    def search(self, own_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The (id, score) of the k best, best first; never the query's own id."""
        n = len(self.ids)
        acc = np.zeros(n, np.int64)
        weight = np.abs(q[self.dims]) if len(self.dims) else np.zeros(0, np.int64)
        order = np.argsort(-(weight * self.bounds), kind="stable")
        rest = self._rest(q)
        possible: np.ndarray | None = None
        a, b = np.searchsorted(self.ids, [own_id, own_id + 1])
        rivals = n - (b - a)
        check = 0.5 * rest
        for i in order:
            if not weight[i]:
                break
            d, bound, part, impacts = self.segments[i]
            acc[part] += q[d] * impacts
            rest -= int(weight[i]) * int(bound - self.after[i])
            if rest <= check and rivals > k:
                possible = self._possible(acc, rest, k, a, b)
                if len(possible) <= RESCORE * n:
                    break
                check = 0.8 * rest
        else:
            possible = None
        if possible is None:
            possible = self._possible(acc, rest, k, a, b)
        exact = self.vectors[possible] @ q
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return [(int(self.ids[possible[j]]), int(exact[j])) for j in best]

    def _rest(self, q: np.ndarray) -> int:
        first = np.ones(len(self.dims), bool)
        first[1:] = self.dims[1:] != self.dims[:-1]
        return int((np.abs(q[self.dims[first]]) * self.bounds[first]).sum()) if len(self.dims) else 0

    @staticmethod
    def _possible(acc: np.ndarray, rest: int, k: int, a: int, b: int) -> np.ndarray:
        """Vectors that can still be among the k best, ties included."""
        others = np.delete(acc, slice(a, b)) if b > a else acc
        floor = np.partition(others, len(others) - k)[len(others) - k] - rest if len(others) > k else None
        keep = acc + rest >= floor if floor is not None else np.ones(len(acc), bool)
        keep[a:b] = False
        return np.flatnonzero(keep)


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id long, v array<long>) of the rows that take part: floor(scale * x)."""
    x = F.transform(col(embedding), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    d = vectors.where(col(vec_id).isNotNull() & col(embedding).isNotNull() & fine)
    whole = lambda c: F.when(F.abs(c * scale) < float(1 << 62), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large to be scaled"))).cast("long")
    return d.select(col(vec_id).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", *, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries``."""
    c = quantised(vectors, vec_id, embedding, scale)
    q = quantised(queries, vec_id, embedding, scale).dropDuplicates(["vec_id"])
    shards, blocks = blocks_for(c.count(), SHARD), blocks_for(q.count(), QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    rows = c.select(spread(shards, 1).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "v").unionByName(
        q.select(every(shards).alias("shard"), spread(blocks, 2).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    )
    met = F.lit(blocks) * F.col("shard") + F.col("block")
    rows = rows.withColumn("met", met.cast("long")).select("met", "asks", "vec_id", "v")
    found = rows.repartition(shards * blocks, "met").sortWithinPartitions("met", "asks").mapInArrow(_meetings(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Meeting:
    """A shard that is read first, and the queries that pass by one after another."""

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.rows = k, [], []
        self.shard: Shard | None = None

    def add(self, vec_id: int, v: list[int]) -> None:
        self.ids.append(vec_id)
        self.rows.append(v)

    def ask(self, vec_id: int, v: list[int]) -> list[tuple[int, int, int]]:
        if not self.ids:
            return []
        if self.shard is None:
            self.dims = max(map(len, self.rows))
            m = np.array([x + [0] * (self.dims - len(x)) for x in self.rows], np.int64).reshape(len(self.rows), self.dims)
            self.rows, self.most = [], max(int(m.max(initial=0)), -int(m.min(initial=0)))
            self.shard = Shard(np.array(self.ids, np.int64), m)
        # components beyond the other side's length meet zeros
        q = np.array((v + [0] * self.dims)[: self.dims], np.int64)
        if self.dims * self.most * max(int(q.max(initial=0)), -int(q.min(initial=0))) >= 1 << 62:
            return self._unbounded(vec_id, q)
        return [(vec_id, *hit) for hit in self.shard.search(vec_id, q, self.k)]

    def _unbounded(self, vec_id: int, q: np.ndarray) -> list[tuple[int, int, int]]:
        """The same in unbounded integers, where sums may leave 64 bits; all are scored."""
        scores = self.shard.vectors.astype(object) @ q.astype(object)
        best = sorted((-int(s), int(i)) for s, i in zip(scores, self.shard.ids, strict=True) if i != vec_id)[: self.k]
        if any(abs(s) >= 1 << 63 for s, _ in best):
            raise OverflowError(f"a score of vector {vec_id} does not fit a long")
        return [(vec_id, i, -s) for s, i in best]


def _meetings(k: int):
    """Rows (met, asks, vec_id, v), sorted: a meeting's shard comes before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, meeting = None, Meeting(k)
        for b in batches:
            found = []
            for met, asks, i, v in zip(*[b.column(j).to_pylist() for j in range(4)], strict=True):
                if met != at:
                    at, meeting = met, Meeting(k)
                if asks:
                    found += meeting.ask(i, v)
                else:
                    meeting.add(i, v)
            yield _hits(found)

    return run


def _hits(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])
