"""Subtree merges: one call, or many jobs side by side.

A merge job fits one task; what scales is the number of jobs, so ``merge_many`` is one
shuffle that brings each job's patterns together. For few jobs with many candidate
pairs ``sweep`` spreads the pairs instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import alphabet, models
from arborspark.functions.likelihood import Scorer
from arborspark.functions.merging import Options, Side, connect, merge as merge_local, prepare
from arborspark.functions.optimize import five_branches
from arborspark.sources import fasta, newick

from .likelihood import matrix


@dataclass(frozen=True)
class MergeResult:
    newick: str
    loglik: float

    def __repr__(self) -> str:
        return f"<MergeResult loglik={self.loglik:f}>"


@dataclass(frozen=True)
class Alignment:
    """An encoded alignment on the driver: masks by taxon over weighted patterns."""

    seq_type: str
    masks: dict[str, np.ndarray]
    weights: np.ndarray
    n_sites: int

    @classmethod
    def of(cls, msa: str | Mapping[str, str] | DataFrame, seq_type: str | None = None) -> Alignment:
        """From a FASTA path, a dict, or a DataFrame (taxon, seq)."""
        if isinstance(msa, str):
            seqs = fasta.read_local(msa)
        elif isinstance(msa, DataFrame):
            seqs = {r["taxon"]: r["seq"] for r in msa.select("taxon", "seq").toLocalIterator()}
        elif isinstance(msa, Mapping):
            seqs = dict(msa)
        else:
            raise TypeError("msa must be a FASTA path, a dict or a DataFrame")
        if len(seqs) < 3:
            raise ValueError("an alignment needs 3 taxa")
        sizes = {len(s) for s in seqs.values()}
        if sizes == {0} or len(sizes) != 1:
            raise ValueError("sequences are empty or of unequal length")
        kind = seq_type or alphabet.detect(seqs.values())
        rows = np.array([alphabet.encode(s, kind) for s in seqs.values()])
        pats, first, counts = np.unique(rows, axis=1, return_index=True, return_counts=True)
        order = np.argsort(first)
        return cls(kind, dict(zip(seqs, pats[:, order], strict=True)), counts[order].astype(float), rows.shape[1])


def union(a: Mapping[str, str], b: Mapping[str, str]) -> dict[str, str]:
    """Both alignments by name; a taxon with two different sequences is an error."""
    for t in a.keys() & b.keys():
        if a[t] != b[t]:
            raise ValueError(f"conflicting sequences for taxon {t}")
    return {**a, **b}


def score(tree: str, msa: str | Mapping[str, str] | DataFrame, model: str = "JTT") -> float:
    """Log-likelihood of a tree at its own branch lengths; nothing is optimised."""
    x = Alignment.of(msa)
    return Scorer(newick.parse(tree), x.masks, x.weights, models.build(model, x.seq_type)).score()


def merge(
    newick_a: str, newick_b: str, interest_a: str, interest_b: str, msa=None, msa_a=None, msa_b=None,
    inherited_a: Sequence[Sequence[str]] = (), inherited_b: Sequence[Sequence[str]] = (), model: str = "JTT",
    window: int = 14, connector_init: float = 0.1, full_blo: str = "off", eps_5blo: float = 1000.0, eps_fulltree: float = -1.0,
) -> MergeResult:
    """Joins two subtrees at the best connector and gives inherited clades back."""
    if msa is None:
        if msa_a is None or msa_b is None:
            raise ValueError("provide either msa=... or both msa_a=... and msa_b=...")
        msa = union(msa_a, msa_b)
    x = Alignment.of(msa)
    o = Options(window, connector_init, full_blo, eps_5blo, eps_fulltree)
    flat = [[t for clade in side for t in clade] for side in (inherited_a, inherited_b)]
    return MergeResult(*merge_local(newick_a, newick_b, interest_a, interest_b, *flat, x.masks, x.weights, models.build(model, x.seq_type), o))


JOBS = "msa_id, newick_a string, newick_b string, interest_a string, interest_b string, inherited_a array<string>, inherited_b array<string>"


def merge_many(jobs: DataFrame, patterns: DataFrame, model: str = "JTT", seq_type: str = "AA", options: Options = Options()) -> DataFrame:
    """(msa_id, newick, loglik, status, error): a row a job.

    jobs: (msa_id, newick_a, newick_b, interest_a, interest_b, inherited_a, inherited_b,
    taxa array<string>); patterns: (msa_id, pattern_id, weight, masks in the order of
    taxa). A job that fails gives its error and no other is touched.
    """
    m = models.build(model, seq_type)
    kind = dict(jobs.dtypes)["msa_id"]
    arrow_key = pa.int64() if kind in ("bigint", "int") else pa.string()

    def run(job: pa.Table, pats: pa.Table) -> pa.Table:
        rows = []
        for j in job.to_pylist():
            try:
                order = np.argsort(pats.column("pattern_id").to_numpy(), kind="stable")
                masks = matrix(pats.column("masks"), len(pats))[:, order]
                weights = pats.column("weight").to_numpy()[order].astype(float)
                tree, ll = merge_local(j["newick_a"], j["newick_b"], j["interest_a"], j["interest_b"], j["inherited_a"], j["inherited_b"], dict(zip(j["taxa"], masks, strict=True)), weights, m, options)
                rows.append((j["msa_id"], tree, ll, "ok", None))
            except Exception as e:  # one item's error is a result
                rows.append((j["msa_id"], None, None, "error", str(e)[:300]))
        kinds = (arrow_key, pa.string(), pa.float64(), pa.string(), pa.string())
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("msa_id", "newick", "loglik", "status", "error"), kinds, strict=True))})

    key = f"msa_id {'bigint' if kind in ('bigint', 'int') else 'string'}"
    p = patterns.select("msa_id", "pattern_id", "weight", "masks")
    return jobs.groupBy("msa_id").cogroup(p.groupBy("msa_id")).applyInArrow(run, f"{key}, newick string, loglik double, status string, error string")


def sweep(spark: SparkSession, a: Side, b: Side, x: Alignment, model: models.Model, options: Options = Options(), tasks: int = 64) -> DataFrame:
    """(au, av, bu, bv, place, ll, lengths): the candidate pairs of one merge (window x
    window, 196 as usual) spread over tasks; the boundary messages travel along."""
    ends = []
    for side in (a, b):
        s = Scorer(side.core, x.masks, x.weights, model)
        ends.append([((u, v), (s.message(u, v), s.message(v, u)), side.core.adj[u][v] / 2) for u, v in side.core.window(*side.anchor, options.window)])
    shared = spark.sparkContext.broadcast(ends)  # at most 2 * window pairs of messages
    pairs = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))]

    def run(batches):
        first, second = shared.value
        for batch in batches:
            rows = []
            for i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (ea, ma, ha), (eb, mb, hb) = first[i], second[j]
                ll, t = five_branches(model, x.weights, ma, mb, [options.connector, ha, ha, hb, hb], eps=options.eps_five)
                rows.append((*ea, *eb, i * len(second) + j, ll, t))
            kinds = [pa.int32()] * 5 + [pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["au", "av", "bu", "bv", "place", "ll", "lengths"])

    d = spark.createDataFrame(pairs, "i int, j int").repartition(min(tasks, len(pairs)))
    return d.mapInArrow(run, "au int, av int, bu int, bv int, place int, ll double, lengths array<double>")


def best(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest likelihood, the first of equals."""
    return candidates.orderBy(F.desc("ll"), "place").limit(1)


__all__ = ["Alignment", "MergeResult", "best", "connect", "merge", "merge_many", "prepare", "score", "sweep", "union"]
