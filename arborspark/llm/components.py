"""Connected components of a link table, by alternating large and small stars.

Each round sends every link's ends to the smallest neighbour (large star: the
larger neighbours; small star: the others), until nothing changes; the number of
rounds grows with the logarithm of the longest path. Every step is an aggregate
and a join on the node, so a hub's neighbours may be split over tasks; each round is
cut from its lineage by a reliable checkpoint, in partitions of about ``ROWS`` links.
A table that a count finds to hold at most ``FEW`` links is solved by one task's
union-find instead, with the same result: rounds over so few links are mostly overhead.

Cases: nodes without a link are their own component; a null rep is the component's only
if all are null; repeated links, links of a node with itself and links in both
directions do no harm; empty tables give an empty result; keys of links that
aren't nodes are ignored; further columns of nodes aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, cut


ROWS, LEAST, FEW = 50_000, 8, 100_000


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) -> every node but the roots under its component's smallest node."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    schema = None
    for b in batches:
        schema = b.schema
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if schema is not None:
        rows = [(x, root(x)) for x in list(parent) if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in (0, 1)], schema=schema)


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    if not large:
        both = both.where(F.col("y") < F.col("x"))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")) if large else both.groupBy("x").agg(F.min("y").alias("m"))
    least = cut(least.coalesce(parts))  # so the join is one of two tables, whose hubs can be split
    joined = both.join(least, "x")
    if large:
        moved = joined.where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(nodes: DataFrame, found: DataFrame, key: str = "fingerprint", rep: str = "rep", most: int = 60) -> DataFrame:
    """nodes (key, rep) and links (a, b) between keys -> (key, root, component_id):
    the component's smallest key and smallest rep."""
    edges = cut(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    n, before = edges.count(), None
    parts = max(LEAST, blocks_for(n, ROWS))
    if n <= FEW:
        edges = cut(edges.coalesce(1).mapInArrow(_at_once, edges.schema))
        most = 0
    for _ in range(most):
        edges = cut(_star(_star(edges, True, parts), False, parts).coalesce(parts))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if most:
            raise RuntimeError("components did not converge")
    # every node now hangs directly under its root
    rooted = nodes.join(edges.select(F.col("u").alias(key), F.col("v").alias("root")), key, "left")
    rooted = cut(rooted.select(key, rep, F.coalesce("root", key).alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min(rep).alias("component_id")))  # apart, so that the join can split large components
    return rooted.join(least, "root").select(key, "root", "component_id")
