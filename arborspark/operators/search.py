"""Topology search: scored SPR moves and their best ones, over many trees at once."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions.likelihood import Scorer
from arborspark.functions.models import Model
from arborspark.functions.optimize import prune_and_place
from arborspark.functions.topology import Tree

from .likelihood import per_job

CANDIDATES = "pu int, pv int, near int, far int, distance int, ll double, pendant double, near_bl double, far_bl double"


def spr_scores(patterns: DataFrame, tree: Tree, taxa: list[str], model: Model, *, radius: int = 10, thorough: bool = False, eps: float = 1000.0, radius_min: int = 1, only: tuple[int, int] | None = None, keep: int | None = None, only_subtrees: set[tuple[int, int]] | None = None) -> DataFrame:
    """Every SPR move of a tree on each alignment, scored. NNI frames that two moves
    share appear once; ``only`` scores one target, ``only_subtrees`` these pruned subtrees
    (pu, pv). keep: the task holds only the best so many of its alignment, in a heap."""

    def job(_, masks: np.ndarray, weights: np.ndarray) -> list[tuple]:
        rows = dict(zip(taxa, masks, strict=True))
        seen: set[tuple[int, int]] = set()
        out = []
        for u, v in tree.spr_points():
            if only_subtrees is not None and (u, v) not in only_subtrees:
                continue
            for ll, x, y, d, t in prune_and_place(tree, lambda s: Scorer(s, rows, weights, model), u, v, radius=radius, thorough=thorough, eps=eps):
                if d < radius_min or (only and only != (x, y)) or (d == 1 and not only and (u, x) in seen and thorough):
                    continue
                seen.add((u, x)) if d == 1 else None
                _push(out, (ll, -u, -v, -x, -y), (u, v, x, y, d, ll, *t), keep)
        return [row for _, row in out]

    return per_job(patterns, CANDIDATES, job)


def _push(held: list, order: tuple, row: tuple, keep: int | None) -> None:
    """Adds a row to a heap of the ``keep`` greatest by ``order`` (None: all)."""
    if keep is None:
        held.append((order, row))
    elif len(held) < keep:
        heapq.heappush(held, (order, row))
    elif order > held[0][0]:
        heapq.heapreplace(held, (order, row))


def best_moves(scores: DataFrame, k: int) -> DataFrame:
    """The k best moves of each alignment."""
    order = Window.partitionBy("msa_id").orderBy(F.desc("ll"), "pu", "pv", "near", "far")
    return scores.where(F.col("status") == "ok").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
