"""Corpus validation: split a known tree, merge the halves again, and compare.

One job an alignment, all its work in one task; an error is that job's result.
"""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import DataFrame

from arborspark.functions import merging
from arborspark.functions.likelihood import Scorer
from arborspark.functions.models import Model
from arborspark.functions.topology import Tree, rf
from arborspark.sources import newick

from .likelihood import per_job

COLUMNS = (
    "n_taxa int, n_real_a int, n_real_b int, n_inherited int, interest_a string, interest_b string, merged_taxa int, taxa_ok boolean, loglik double, "
    "rf_true int, nrf_true double, n_common int, faith_a int, faith_b int, faithful boolean, ll_score double, ll_diff double, time_sec double"
)


def divide(tree: Tree, fa: float, fb: float, seed: int) -> tuple[set[str], set[str], set[str], set[str]]:
    """(real A, real B, inherited A, inherited B): the clade nearest to fa : fb in size is
    one side; the rest of the fractions is inherited, in proportion to the sides, so
    that each keeps two real leaves."""
    taxa, n = set(tree.names.values()), len(tree.names)
    want = fa / (fa + fb) * n
    a = set(min(tree.splits(), key=lambda s: (abs(len(s) - want), sorted(s))))
    b = taxa - a
    rng = random.Random(seed)
    out = max(0, round((1 - fa - fb) * n))
    first = round(out * len(a) / n)
    inherited = [set(rng.sample(sorted(x), min(k, max(0, len(x) - 2)))) for x, k in ((a, first), (b, out - first))]
    return a - inherited[0], b - inherited[1], *inherited


def validate(patterns: DataFrame, tree: Tree, taxa: list[str], model: Model, *, fa: float = 0.45, fb: float = 0.45, seed: int = 1, options: merging.Options = merging.Options()) -> DataFrame:
    """A row for each alignment: what was split, and how the merge compares with the
    known tree, with both sides, and with its own likelihood scored again."""

    def job(_, masks: np.ndarray, weights: np.ndarray) -> list[tuple]:
        began = time.perf_counter()
        rows = dict(zip(taxa, masks, strict=True))
        a, b, ia, ib = divide(tree, fa, fb, seed)
        oa, ob = min(b), min(a)
        everything = set(tree.names.values())
        sides = [tree.prune(everything - keep)[0] for keep in (a | ia | {oa}, b | ib | {ob})]
        text, ll = merging.merge(newick.write(sides[0]), newick.write(sides[1]), oa, ob, ia, ib, rows, weights, model, options)
        out = newick.parse(text)
        far, nfar, common = rf(out, tree)
        faith = [rf(out, s.prune([o])[0])[0] for s, o in zip(sides, (oa, ob), strict=True)]
        scored = out if options.full_blo != "off" or not ia | ib else out.prune(ia | ib)[0]
        again = Scorer(scored, rows, weights, model).score()
        took = time.perf_counter() - began
        return [(len(everything), len(a), len(b), len(ia | ib), oa, ob, len(out.names), out.leaves() == sorted(everything), ll, far, nfar, common, *faith, not any(faith), again, abs(ll - again), took)]

    return per_job(patterns, COLUMNS, job)
