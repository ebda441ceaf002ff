"""Mixing sources to target weights by capped water-filling.

Every source gets the share of all words that its weight buys; a source whose
share would pass ``max_epochs`` times its own size is clamped there, and what
it can't use is shared out again by weight until no source is above its cap.
The fixed point of that loop is a water level ``x``: targets are
``min(cap, x * weight)``. Sorted by ``cap / weight`` the clamped sources are a
prefix, so one pass of prefix sums over the (small) table of sources finds
it exactly, with integer sums and one division.

Repetitions: a source with target/size = 2.4 is taken twice whole, and the rest
(0.4 of its words) comes from the documents that a seeded hash puts first. The
cut-off hash is found through a radix histogram (256 bins a level), so no source,
however large, is ever ordered in one task.

Cases: null text counts as no words and is taken 0 words; null sources form one
source, the last; of rows that agree in id and text any may be the ones taken once
more, as many as fit; an empty
table or a corpus without words takes nothing; extra columns are kept as they
are, and generated names step aside for clashing ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, cut, fresh, if_small

#: Radix levels of two hex digits each before the last bin is ordered exactly.
LEVELS = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Seeded hex key of a row; equal for rows that agree in id and text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def water_fill(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Targets of the sources: (source, source_size) -> + weight, target double."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    w = F.element_at(cycle, (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    d = sizes.select("source", "source_size", w.alias("weight")).withColumn("cap", F.col("source_size") * max_epochs)
    tight = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    # clamped while the level that the rest allows is at or above the cap
    d = d.withColumn("clamped", F.col("left_words") * F.col("weight") >= F.col("cap") * F.col("left_weight"))
    free = F.struct("left_weight", "left_words")
    d = d.withColumn("level", F.max(F.when(~F.col("clamped"), free)).over(everything))
    share = (F.col("level.left_words") * F.col("weight")).cast("double") / F.col("level.left_weight").cast("double")
    return d.select("source", "source_size", "weight", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _cut_offs(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source the largest key taken once more ('' for none).

    rows: (source, key, size); plan: (source, wanted double). Keys are taken in
    order while the middle of their words lies within what is wanted. The bin
    that holds the cut is searched again in finer bins, and only the last one
    is ordered in full.
    """
    at = if_small(plan.select("source", F.col("wanted").alias("w"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base")))
    keep = rows
    for level in range(1, LEVELS + 1):
        bins = keep.groupBy("source", F.substring("key", 1, 2 * level).alias("bin")).agg(F.sum("size").alias("words"))
        bins = bins.join(at, bins["source"].eqNullSafe(at["source"])).select(bins["source"], "bin", "words", "w", "base")
        order = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("upto", F.col("base") + F.sum("words").over(order))
        # the first bin whose end passes what is wanted holds the cut
        held = bins.where(F.col("upto").cast("double") > F.col("w")).groupBy("source").agg(
            F.min_by(F.struct(F.col("bin"), (F.col("upto") - F.col("words")).alias("base"), F.col("w")), "bin").alias("b")
        )
        at = if_small(cut(held.select("source", F.col("b.w").alias("w"), F.col("b.bin").alias("prefix"), F.col("b.base").alias("base"))))
        keep = keep.alias("k").join(at.alias("a"), F.col("k.source").eqNullSafe(F.col("a.source")) & F.col("k.key").startswith(F.col("a.prefix"))).select("k.*")
    last = keep.groupBy("source", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    last = last.join(at, last["source"].eqNullSafe(at["source"])).select(last["source"], "key", "words", "n", "size", "w", "base", "prefix")
    before = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("key")) - F.col("words")
    last = last.withColumn("room", 2 * (F.col("w") - before.cast("double")))
    # rows of one key are equal, so any of them may be the ones that fit
    fit = F.when(F.col("size") > 0, F.floor((F.col("room") + F.col("size")) / (2 * F.col("size")))).otherwise(F.when(F.col("room") >= 0, F.col("n")).otherwise(0))
    last = last.withColumn("fit", F.greatest(F.least(fit.cast("long"), F.col("n")), F.lit(0)))
    taken = F.when(F.col("fit") > 0, F.struct("key", "fit", "n"))
    cuts = last.groupBy("source").agg(F.max(taken).alias("c"), F.first("prefix").alias("prefix"))
    # nothing of the bin fits: everything below the bin is taken
    return cuts.select("source", F.coalesce("c.key", "prefix").alias("last_key"), F.when(F.col("c.fit") < F.col("c.n"), F.col("c.fit")).alias("fit"))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): narrow rows (doc_id, source, key, size) and, for each source,
    (source, source_size, weight, target, whole, last_key, fit); fit, where only some of
    the equal rows of last_key are taken once more: how many."""
    rows = cut(
        docs.select(
            col(doc_id).alias("doc_id"), col(source).alias("source"), sampling_key(col(doc_id), col(text), seed).alias("key"), n_words(col(text)).alias("size")
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut(water_fill(sizes, weights, max_epochs))
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    plan = plan.withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long"))
    plan = plan.withColumn("wanted", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    part = plan.where((F.col("wanted") > 0) & (F.col("whole") < max_epochs))
    cuts = _cut_offs(rows, part)
    plan = plan.join(cuts, plan["source"].eqNullSafe(cuts["source"]), "left").select(plan["*"], F.coalesce(cuts["last_key"], F.lit("")).alias("last_key"), cuts["fit"])
    return rows, if_small(cut(plan.drop("wanted")))


def _copies(rows: DataFrame, plan: DataFrame, key: str, source: str) -> tuple[DataFrame, Column]:
    """rows joined to their source's plan, and how often each is taken.

    Only where some of a key's equal rows fit and others don't are they numbered: by
    the partition they lie in and their place there, so equal rows stay spread.
    """
    names = dict(zip(plan.columns, fresh(rows, *plan.columns), strict=True))
    joined = rows.join(plan.select(*[F.col(c).alias(n) for c, n in names.items()]), col(source).eqNullSafe(col(names["source"])))
    whole, last, fit = (col(names[c]) for c in ("whole", "last_key", "fit"))
    (extra,) = fresh(joined, "extra")
    if plan.where("fit is not null").isEmpty():
        return joined.withColumn(extra, (col(key) <= last).cast("long")), whole + col(extra)
    split = fit.isNotNull() & (col(key) == last)
    plain = joined.where(~F.coalesce(split, F.lit(False))).withColumn(extra, (col(key) <= last).cast("long"))
    part, at, before = fresh(joined, "part", "at", "before")
    some = cut(joined.where(split).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    group = [col(names["source"]), col(key)]
    sizes = some.groupBy(*group, part).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(col(names["source"]).alias("s"), col(key).alias("k"), F.col(part).alias("p"), (F.sum("n").over(Window.partitionBy(*group).orderBy(part)) - F.col("n")).alias(before))
    number = F.row_number().over(Window.partitionBy(*group, part).orderBy(at))
    numbered = some.withColumn(at, number).join(sizes, col(names["source"]).eqNullSafe(F.col("s")) & (col(key) == F.col("k")) & (col(part) == F.col("p")))
    numbered = numbered.withColumn(extra, (col(before) + col(at) <= fit).cast("long"))
    return plain.unionByName(numbered.select(*plain.columns)), whole + col(extra)


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    rows, plan = plan_mix(docs, **options)
    joined, copies = _copies(rows, plan, "key", "source")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, seed: int = 42, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, same columns."""
    _, plan = plan_mix(docs, text, source, doc_id, seed=seed, **options)
    (key,) = fresh(docs, "key")
    out, copies = _copies(docs.withColumn(key, sampling_key(col(doc_id), col(text), seed)), plan.select("source", "whole", "last_key", "fit"), key, source)
    return out.withColumn(key, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[col(c) for c in docs.columns])
