"""Likelihoods of trees that exceed a task: messages as a table, a level at a time.

A tree is a table of nodes (node, parent, bl, taxon), rooted at an inner node; sites lie in
blocks. What a subtree says about its root is a row (node, block, vector, logs). Going up,
a level's rows meet their parents in one shuffle by (parent, block), at most a node's
children a group, and become the rows of the level above. Going down, each child gets
what the rest of the tree says at its parent. Every pass works on all blocks and all
nodes of a level at once; the driver sees the number of levels only. Depths come from
pointer doubling, so their number of jobs is the logarithm of the height.

Sites without a cell are gaps. Trees of great height take as many steps as levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions.likelihood import FLOOR, Message, joined, rescaled, tip
from arborspark.functions.models import Model
from arborspark.storage import once, written

from .blocks import BLOCK, _schema, by_row, flat
from .forest import along


def depths(nodes: DataFrame) -> DataFrame:
    """nodes (node, parent, bl, ...) plus depth (long) and dist (sum of lengths), both from
    the root."""
    inner = F.col("parent").isNotNull()
    return along(nodes, {"depth": F.when(inner, 1).otherwise(0).cast("long"), "dist": F.when(inner, F.col("bl")).otherwise(0.0)})


def tips(cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """(taxon, block, at array<int>, masks array<int>) of cells (taxon, site, mask): a
    taxon's sites in blocks of ``size`` neighbouring site numbers."""
    pair = F.struct(F.pmod("site", F.lit(size)).cast("int").alias("at"), "mask")
    d = cells.groupBy("taxon", F.floor(F.col("site") / size).alias("block")).agg(F.collect_list(pair).alias("c"))
    return d.select("taxon", "block", F.col("c.at").alias("at"), F.col("c.mask").alias("masks"))


def _message(kid: dict, k: int, size: int) -> Message:
    """A child's message: of a leaf from its masks, of an inner node as it was kept."""
    if kid["vector"] is not None:
        return np.array(kid["vector"]).reshape(k, -1), np.array(kid["logs"])
    masks = np.full(size, (1 << k + 1) - 1)
    if kid["at"] is not None:
        masks[kid["at"]] = kid["masks"]
    return tip(masks, k)


class Levels:
    """The messages of one tree over one alignment."""

    def __init__(self, nodes: DataFrame, cells: DataFrame, model: Model, size: int = BLOCK) -> None:
        self.model, self.size = model, size
        self.nodes = written(depths(nodes))
        self.leaves = written(tips(cells, size))
        self.height = self.nodes.agg(F.max("depth")).first()[0]
        self.first, self.last = self.leaves.agg(F.min("block"), F.max("block")).first()
        self.up: dict[int, DataFrame] = {}
        self.families: dict[int, DataFrame] = {}
        for level in range(self.height, 0, -1):
            self.up[level - 1] = self._raise(level)

    def _raise(self, level: int) -> DataFrame:
        """Messages of the inner nodes at depth level - 1, from their children."""
        here = self.nodes.where(F.col("depth") == level).select("node", "parent", "bl", "taxon")
        # a leaf has a row in every block, whether it has a cell there or not
        leaf = here.where("taxon is not null").withColumn("block", F.explode(F.sequence(F.lit(self.first), F.lit(self.last))))
        leaf = leaf.join(self.leaves, ["taxon", "block"], "left").select("node", "parent", "bl", "block", "at", "masks", F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("array<double>").alias("logs"))
        every = leaf
        if level in self.up:
            inner = self.up[level].join(here.select("node", "parent", "bl"), "node")
            every = leaf.unionByName(inner.select("node", "parent", "bl", "block", F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<int>").alias("masks"), "vector", "logs"))
        kids = F.array_sort(F.collect_list(F.struct("node", "bl", "at", "masks", "vector", "logs"))).alias("kids")
        self.families[level] = written(every.groupBy("parent", "block").agg(kids))

        model, size = self.model, self.size

        def work(r: dict) -> list[tuple]:
            x, log = joined(model, *((_message(kid, model.k, size), kid["bl"]) for kid in r["kids"]))
            return [(r["parent"], r["block"], flat(x), flat(log))]

        family = self.families[level]
        made = by_row(family, work, _schema(family, ["parent", "block"], "vector doubles, logs doubles"), [])
        return written(made.withColumnRenamed("parent", "node"))

    def loglik(self) -> DataFrame:
        """(loglik): one row, the sum over all sites at the root."""
        model = self.model

        def work(r: dict) -> list[tuple]:
            site = model.pi @ r["vector"].reshape(model.k, -1)
            return [(float((np.log(np.maximum(site, FLOOR)) + r["logs"]).sum()),)]

        top = self.up[0]
        return by_row(top, work, _schema(top, [], "part double"), ["vector", "logs"]).agg(F.sum("part").alias("loglik"))

    def edges(self) -> DataFrame:
        """(node, loglik): the likelihood as seen from the edge above every node but the root,
        by a pass from the root down; in exact arithmetic all are the same."""
        found, rest, lower = [], None, partial(_lower, self.model, self.size)
        for level in range(1, self.height + 1):
            d = self.families[level]
            if rest is None:
                d = d.withColumns({"vector": F.lit(None).cast("array<double>"), "logs": F.lit(None).cast("array<double>"), "bl": F.lit(None).cast("double")})
            else:
                d = d.join(rest, ["parent", "block"])
            down = written(by_row(d, lower, _schema(d, ["block"], "node long, part double, vector doubles, logs doubles"), []))
            found.append(down.groupBy("node").agg(F.sum("part").alias("loglik")))
            own = self.nodes.select("node", "bl")
            rest = down.join(own, "node").select(F.col("node").alias("parent"), "block", "vector", "logs", "bl")
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out


def _lower(model: Model, size: int, r: dict) -> list[tuple]:
    """What the rest of the tree says at each child's edge, and the likelihood there."""
    kids = r["kids"]
    carried = []
    for kid in kids:
        x, log = _message(kid, model.k, size)
        carried.append((model.p(kid["bl"]) @ x, log))
    above = None
    if r["vector"] is not None:
        above = model.p(r["bl"]) @ np.array(r["vector"]).reshape(model.k, -1), np.array(r["logs"])
    out = []
    for i, kid in enumerate(kids):
        x, log = np.ones((model.k, size)), np.zeros(size)
        for y, own in [c for j, c in enumerate(carried) if j != i] + ([above] if above else []):
            x, log = x * y, log + own
        x, log = rescaled(x, log)
        site = (model.pi[:, None] * x * carried[i][0]).sum(0)
        part = float((np.log(np.maximum(site, FLOOR)) + log + carried[i][1]).sum())
        out.append((r["block"], kid["node"], part, flat(x), flat(log)))
    return out


def score(nodes: DataFrame, cells: DataFrame, model: Model, size: int = BLOCK) -> DataFrame:
    """(loglik) of a tree (node, parent, bl, taxon) over cells (taxon, site, mask)."""
    return Levels(nodes, cells, model, size).loglik()


__all__: Sequence[str] = ["Levels", "depths", "score", "tips"]
