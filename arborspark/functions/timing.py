"""Timing of likelihood evaluations: cold (all messages) and warm (again, from none)."""

from __future__ import annotations

import statistics
import time

from .likelihood import Scorer


def evaluate(make, warmup: int = 20, iterations: int = 200, tolerance: float = 1e-2) -> dict[str, float]:
    """cold_ms, and best, median and mean µs of evaluations after ``warmup`` ones.

    make: a Scorer; an evaluation that drifts from the first one's value is an error.
    """
    began = time.perf_counter()
    scorer: Scorer = make()
    first = scorer.score()
    out = {"cold_ms": (time.perf_counter() - began) * 1e3}
    took = []
    for i in range(warmup + iterations):
        scorer.kept.clear()
        began = time.perf_counter()
        now = scorer.score()
        if i >= warmup:
            took.append((time.perf_counter() - began) * 1e6)
        if abs(now - first) > tolerance:
            raise RuntimeError(f"the likelihood drifted from {first} to {now}")
    return out | {"best_us": min(took), "median_us": statistics.median(took), "mean_us": statistics.fmean(took), "loglik": first}
