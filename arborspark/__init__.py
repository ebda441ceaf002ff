"""Likelihood-based phylogenetic data processing on Spark."""

from arborspark.operators.merge import MergeResult, merge, merge_many, score

__all__ = ["MergeResult", "merge", "merge_many", "score"]
