"""Screens a corpus of alignments before trees are built and merged.

For each alignment: its size, distinct columns, parsimony-informative ones, the changes
that dropping the others would hide, its share of gaps, and the log-likelihood of a fixed
tree; alignments with too few informative columns are marked, so that a run over the
corpus can leave them out. The report is partitioned by shard, as a corpus is dealt to
runs; with ``shard`` only that shard is worked on, and only its partition is replaced.

    python -m jobs.alignment_report TABLES OUTPUT [--config FILE] [--set shard=3]

TABLES is a folder with lineitem.parquet: blocks of suppliers are the taxa of one
alignment, months the sites, and summed quantities the states. A rerun writes the same
rows again; an alignment without rows is in no report; rows without a supplier or a
date belong to no alignment.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import models
from arborspark.operators import alignment, likelihood
from arborspark.plans.portable import heap_tree
from arborspark.storage import once

from .common import command_line

log = logging.getLogger("alignment_report")


def alignments(lineitem: DataFrame, taxa: int, states: int) -> DataFrame:
    """(msa_id, site, masks): the columns of all alignments."""
    at = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    d = lineitem.where(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull())
    d = d.select(F.floor(F.col("l_suppkey") / taxa).alias("msa_id"), (F.col("l_suppkey") % taxa).cast("int").alias("ord"), at.alias("site"), "l_quantity")
    cells = d.groupBy("msa_id", "ord", "site").agg(F.pow(F.lit(2), F.coalesce(F.sum("l_quantity"), F.lit(0)).cast("long") % states).cast("int").alias("mask"))
    return alignment.from_pivot(cells, taxa, (1 << states + 1) - 1)


def report(cols: DataFrame, taxa: int, states: int, least_informative: int) -> DataFrame:
    """A row an alignment."""
    pats = once(alignment.patterns(cols))  # far fewer rows than columns, and read four times
    gap = (1 << states + 1) - 1
    gaps = F.sum(F.col("weight") * F.size(F.filter("masks", lambda m: m == gap)))
    sizes = alignment.summary(pats).select("msa_id", F.col("n_taxa").cast("long").alias("n_taxa"), "n_sites", "n_patterns")
    facts = pats.groupBy("msa_id").agg(F.count_if(alignment.informative(states)).alias("n_informative"), gaps.alias("n_gaps"))
    _, offset = alignment.only_informative(pats, states)
    names = [f"t{t}" for t in range(taxa)]
    scored = likelihood.total(likelihood.score_sites(pats, heap_tree(taxa), names, models.jukes_cantor(states)))
    out = sizes.join(facts, "msa_id").join(offset, "msa_id").join(scored, "msa_id")
    status = F.when(F.col("n_informative") >= least_informative, "ok").otherwise("uninformative")
    share = F.round(F.col("n_gaps") / (F.col("n_taxa") * F.col("n_sites")), 6)
    return out.select("msa_id", "n_taxa", "n_sites", "n_patterns", "n_informative", share.alias("gap_share"), "parsimony_offset", F.round("loglik", 6).alias("loglik"), status.alias("status"))


def run(spark: SparkSession, tables: str, output: str, *, taxa: int = 8, states: int = 4, shards: int = 4, shard: int | None = None, least_informative: int = 30) -> dict:
    """Writes the report to ``output``, partitioned by shard; returns what it read and wrote."""
    lineitem = spark.read.parquet(f"{tables}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_quantity")
    if shard is not None:
        lineitem = lineitem.where(F.pmod(F.floor(F.col("l_suppkey") / taxa), F.lit(shards)) == shard)
    out = report(alignments(lineitem, taxa, states), taxa, states, least_informative).withColumn("shard", F.pmod("msa_id", F.lit(shards)).cast("int"))
    mode = "static" if shard is None else "dynamic"
    out.repartition("shard").sortWithinPartitions("msa_id").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("shard").parquet(output)
    # counts come from the files' footers
    wrote = spark.read.schema(out.schema).parquet(output)
    if shard is not None:
        wrote = wrote.where(F.col("shard") == shard)
    done = {"read": lineitem.count(), "written": wrote.count(), "ok": wrote.where("status = 'ok'").count()}
    log.info("read %(read)d rows of lineitem, wrote %(written)d alignments, %(ok)d of them informative enough", done)
    return done


if __name__ == "__main__":
    command_line(__file__, __doc__, run, {"tables": "folder of the tables", "output": "folder of the report"})
