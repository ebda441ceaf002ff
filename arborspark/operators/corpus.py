"""Corpus processing: shards, resume, combining results, summaries, cross-checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.storage import once, small


def placed(items: DataFrame, order: Sequence[Column]) -> DataFrame:
    """items with their ``place`` from 0 in a full order.

    Places come from a range partitioning by the order and the sizes of its partitions. The
    ranged rows are computed once and kept: planned twice, a range partitioning may choose
    other bounds.
    """
    ranged = items.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = once(ranged.withColumn("_at", F.monotonically_increasing_id()))  # partition, then place in it
    part = F.shiftright("_at", 33).alias("_p")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row a partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("place", place).drop("_p", "_at", "_before")


def shard(items: DataFrame, key: str, count: int, index: int | None = None) -> DataFrame:
    """items with their ``shard``: the i-th by key goes to shard i mod count (or only
    the items of one shard); of items with equal keys the order is free.

    No single task numbers all items (see ``placed``).
    """
    out = placed(items, [F.col(key)]).withColumn("shard", F.pmod("place", F.lit(count))).drop("place")
    return out if index is None else out.where(F.col("shard") == index)


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a row in the results, whatever that row's status."""
    return items.join(done.select(key), key, "left_anti")


def first_rows(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key. An aggregate on the smallest order key, so that
    map tasks already drop what can't win."""
    whole = F.struct(*rows.columns)
    best = rows.groupBy(key).agg(F.min_by(whole, F.struct(*order)).alias("_r"))
    return best.select(*[F.col("_r")[c].alias(c) for c in rows.columns])


def counts(rows: DataFrame, flags: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """How many rows there are, and for how many each flag holds."""
    each = [F.count_if(c).alias(n) for n, c in flags.items()]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *each)


def summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, min, max, p10 and p90 of a column, blanks skipped; percentiles
    interpolate between neighbours. A task counts a group's distinct values; ``quantiles``
    holds no group."""
    v = F.col(value)
    stats = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most")]
    return rows.groupBy(*by).agg(*stats, F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.9).alias("p90"))


def quantiles(rows: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, p, quantile): exact quantiles of a column, blanks skipped, neighbours interpolated.

    Values get their places in one range partitioning by group and value, and the values at
    the places around (n - 1) * p are looked up, so a group may be of any size.
    """
    d = placed(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")), [*map(F.col, by), F.col("v")])
    groups = d.groupBy(*by).agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    at = groups.select(*by, "start", "n", F.explode(F.array(*map(F.lit, ps))).alias("p")).withColumn("rank", (F.col("n") - 1) * F.col("p"))
    ends = F.array(F.struct(F.floor("rank").alias("k"), (F.floor("rank") + 1 - F.col("rank")).alias("share")), F.struct((F.floor("rank") + 1).alias("k"), (F.col("rank") - F.floor("rank")).alias("share")))
    wanted = once(at.select(*by, "p", "start", F.explode(ends).alias("e")).where("e.share > 0").select(*by, "p", (F.col("start") + F.col("e.k")).alias("place"), "e.share"))
    found = d.select("place", "v").join(small(wanted), "place")
    return found.groupBy(*by, "p").agg(F.sum(F.col("share") * F.col("v")).alias("quantile"))


def ratio(a: str, b: str) -> Column:
    """a / b, null where b is zero or missing."""
    return F.try_divide(F.col(a), F.col(b))


def top(rows: DataFrame, order: Sequence[Column], n: int = 20) -> DataFrame:
    """A report's first n rows in a full order."""
    return rows.orderBy(*order).limit(n)


def cross_check(rows: DataFrame, ll: str, again: str, external: str | None = None, near: float = 1e-4, far: float = 0.1) -> DataFrame:
    """rows plus ll_diff and agree (within ``near`` of a second scoring, and within
    ``far`` of an external one where there is one)."""
    d = F.abs(F.col(ll) - F.col(again))
    ok = d < near
    if external:
        ok = ok & (F.col(external).isNull() | (F.abs(F.col(ll) - F.col(external)) < far))
    return rows.withColumn("ll_diff", d).withColumn("agree", F.coalesce(ok, F.lit(False)))


def round_half_even(x: float) -> int:
    return round(x)


def choose_split(splits: DataFrame, taxa: DataFrame, fa: float = 0.45, fb: float = 0.45, seed: int = 0) -> DataFrame:
    """(taxon, side, inherited) of one tree: the split nearest to fa : fb divides the taxa,
    and of each side a seeded draw is inherited, leaving two real taxa or more.

    splits: (members array<string>); taxa: (taxon).
    """
    n = taxa.count()
    want = fa / (fa + fb) * n
    one = splits.where(F.size("members").between(2, n - 2)).agg(F.min_by("members", F.struct(F.abs(F.size("members") - want), F.concat_ws(",", F.array_sort("members")))).alias("members"))
    sided = taxa.crossJoin(F.broadcast(one)).select("taxon", F.when(F.array_contains("members", F.col("taxon")), "A").otherwise("B").alias("side"), F.size("members").alias("na"))
    out = max(0, round_half_even((1 - fa - fb) * n))
    first = F.least(F.round(out * F.col("na") / n).cast("int"), F.greatest(F.col("na") - 2, F.lit(0)))
    second = F.least(F.lit(out) - F.round(out * F.col("na") / n).cast("int"), F.greatest(F.lit(n) - F.col("na") - 2, F.lit(0)))
    draw = F.row_number().over(Window.partitionBy("side").orderBy(F.xxhash64("taxon", F.lit(seed)), "taxon"))
    return sided.select("taxon", "side", (draw <= F.when(F.col("side") == "A", first).otherwise(second)).alias("inherited"))
