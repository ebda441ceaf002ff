"""Likelihoods over alignment tables, on two axes.

Many small jobs: one group a job, scored whole in one task. One large alignment:
patterns are independent, so blocks of them are scored where they lie and only
sums meet. Both use Arrow batches and NumPy kernels; for four states and trees of
moderate size ``plans.portable.jc_ctes`` needs no Python at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions import models
from arborspark.functions.likelihood import Scorer
from arborspark.functions.models import Model
from arborspark.functions.topology import Tree

#: Patterns scored at once, which bounds a task's memory.
BLOCK = 4096


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """(taxa, patterns) of a list column with one entry a taxon."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).T if rows else np.zeros((0, 0), np.int64)


def score_sites(patterns: DataFrame, tree: Tree, taxa: list[str], model: Model) -> DataFrame:
    """(msa_id, pattern_id, weight, site_lnl) of one tree over any number of patterns.

    The tree and the model are a few kilobytes and travel with the function; patterns
    stay in their partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                m = matrix(b.column(3), b.num_rows)
                s = Scorer(tree, dict(zip(taxa, m, strict=True)), np.ones(b.num_rows), model)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s.sites())], ["msa_id", "pattern_id", "weight", "site_lnl"])

    d = patterns.select("msa_id", "pattern_id", "weight", "masks")
    kinds = dict(d.dtypes)
    return d.mapInArrow(run, f"msa_id {kinds['msa_id']}, pattern_id {kinds['pattern_id']}, weight {kinds['weight']}, site_lnl double")


def total(sites: DataFrame) -> DataFrame:
    """(msa_id, loglik): a weighted sum that combines on the map side."""
    return sites.groupBy("msa_id").agg(F.sum(F.col("weight") * F.col("site_lnl")).alias("loglik"))


def per_job(patterns: DataFrame, columns: str, job: Callable[[object, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """Runs ``job(msa_id, masks (taxa, patterns), weights)`` for each alignment; it returns
    rows without msa_id. An error becomes the job's ``error`` and fails no other."""
    kind = dict(patterns.dtypes)["msa_id"]
    names = [c.split()[0] for c in columns.split(",")]
    schema = f"msa_id {kind}, {columns}, status string, error string"

    def run(table: pa.Table) -> pa.Table:
        key = table.column("msa_id")[0].as_py()
        order = np.argsort(table.column("pattern_id").to_numpy(), kind="stable")
        masks = matrix(table.column("masks"), len(table))[:, order]
        try:
            rows = [(key, *r, "ok", None) for r in job(key, masks, table.column("weight").to_numpy()[order].astype(float))]
        except Exception as e:  # one item's error is a result
            rows = [(key, *[None] * len(names), "error", str(e)[:300])]
        fields = target
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    target = [(f.name, f.type) for f in arrow]
    return patterns.select("msa_id", "pattern_id", "weight", "masks").groupBy("msa_id").applyInArrow(run, schema)


def score_many(patterns: DataFrame, tree: Tree, taxa: list[str], model: str = "JTT", seq_type: str = "AA") -> DataFrame:
    """(msa_id, loglik, status, error): one tree scored on many alignments."""
    m = models.build(model, seq_type)
    return per_job(patterns, "loglik double", lambda _, masks, w: [(Scorer(tree, dict(zip(taxa, masks, strict=True)), w, m).score(),)])
