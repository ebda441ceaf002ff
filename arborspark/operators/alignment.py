"""Operators on alignments: encoding, patterns, filters, slices, unions.

An alignment is a table of columns (msa_id, site, masks) with one mask a taxon, in
the order of the taxa. Patterns are its distinct columns (msa_id, pattern_id,
weight, first_site, masks): everything downstream is a weighted sum over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborspark.functions import alphabet
from arborspark.storage import once

from .corpus import placed


def types(seqs: DataFrame) -> DataFrame:
    """(msa_id, seq_type): AA if any sequence holds a letter that only proteins have."""
    return seqs.groupBy("msa_id").agg(F.when(F.bool_or(alphabet.looks_protein(F.col("seq"))), "AA").otherwise("DNA").alias("seq_type"))


def columns(seqs: DataFrame, seq_type: str) -> DataFrame:
    """(msa_id, site, masks) of sequences (msa_id, taxon, ord, seq)."""
    cells = seqs.select("msa_id", "ord", F.posexplode(alphabet.masks(F.col("seq"), seq_type)).alias("site", "mask"))
    return from_cells(cells)


def from_cells(cells: DataFrame) -> DataFrame:
    """(msa_id, site, masks) of (msa_id, ord, site, mask), one row a taxon and site."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "mask")))
    return cells.groupBy("msa_id", "site").agg(F.transform(listed, lambda s: s["mask"]).alias("masks"))


def from_pivot(cells: DataFrame, taxa: int, gap: int) -> DataFrame:
    """Like ``from_cells`` for taxa numbered 0 to taxa - 1; absent cells are gaps.

    Each taxon is one conditional aggregate, so nothing is collected into lists and the
    aggregation combines on the map side.
    """
    each = [F.max(F.when(F.col("ord") == t, F.col("mask"))) for t in range(taxa)]
    return cells.groupBy("msa_id", "site").agg(F.array(*[F.coalesce(e, F.lit(gap)) for e in each]).alias("masks"))


def patterns(cols: DataFrame) -> DataFrame:
    """(msa_id, pattern_id, weight, first_site, masks): equal columns collapse, numbered
    by their first occurrence."""
    p = cols.groupBy("msa_id", "masks").agg(F.count(F.lit(1)).alias("weight"), F.min("site").alias("first_site"))
    number = F.row_number().over(Window.partitionBy("msa_id").orderBy("first_site")) - 1
    return p.select("msa_id", number.alias("pattern_id"), "weight", "first_site", "masks")


def wide_patterns(cells: DataFrame, gap: int) -> tuple[DataFrame, DataFrame]:
    """(patterns (msa_id, pattern_id, weight, first_site), their cells (msa_id, pattern_id, ord,
    mask)) of cells (msa_id, ord, site, mask), for alignments of any number of taxa: no row
    holds a column, and no task sorts an alignment.

    A column is known by 128 bits, the exclusive or of its cells' hashes, which add up over
    tasks that see parts of it. Each taxon then says whether all columns of equal bits
    agree on it; if some don't, that is an error. Gaps are cells like absent ones. Numbers
    are places in a range partitioning, counted from the alignment's first.
    """
    solid = cells.where(F.col("mask") != gap)
    bits = [F.bit_xor(F.xxhash64("ord", "mask", F.lit(i))).alias(f"h{i}") for i in (0, 1)]
    # a column of gaps alone has cells too, and its bits are 0
    every = cells.select("msa_id", "site").distinct()
    known = once(every.join(solid.groupBy("msa_id", "site").agg(*bits), ["msa_id", "site"], "left").na.fill(0, ["h0", "h1"]))
    pats = known.groupBy("msa_id", "h0", "h1").agg(F.count(F.lit(1)).alias("weight"), F.min("site").alias("first_site"))
    numbered = placed(pats, [F.col("msa_id"), F.col("first_site")])
    starts = numbered.groupBy("msa_id").agg(F.min("place").alias("start"))
    numbered = once(numbered.join(starts, "msa_id").withColumn("pattern_id", F.col("place") - F.col("start")))
    of = known.join(numbered.select("msa_id", "h0", "h1", "pattern_id", "weight"), ["msa_id", "h0", "h1"])
    same = solid.join(of, ["msa_id", "site"]).groupBy("msa_id", "pattern_id", "ord").agg(F.min("mask").alias("mask"), F.max("mask").alias("other"), F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"))
    agree = (F.col("mask") == F.col("other")) & (F.col("n") == F.col("weight"))
    mask = F.when(agree, F.col("mask")).otherwise(F.raise_error(F.lit("two columns of one alignment have equal hashes")).cast("int"))
    return numbered.select("msa_id", "pattern_id", "weight", "first_site"), same.select("msa_id", "pattern_id", "ord", mask.alias("mask"))


def determined(pats: DataFrame, k: int) -> DataFrame:
    """Opt-in: without columns in which every taxon allows every state."""
    return pats.where(F.exists("masks", lambda m: m.bitwiseAND(F.lit((1 << k) - 1)) != (1 << k) - 1))


def _unambiguous(k: int) -> Column:
    """array<int> of the column's masks that allow exactly one state."""
    return F.filter(F.transform("masks", lambda m: m.bitwiseAND(F.lit((1 << k) - 1))), lambda m: F.bit_count(m) == 1)


def informative(k: int) -> Column:
    """Whether at least two states occur unambiguously in at least two taxa each;
    columns without any unambiguous taxon count as informative."""
    sure = _unambiguous(k)
    twice = [F.when(F.size(F.filter(sure, _equals(1 << s))) >= 2, 1).otherwise(0) for s in range(k)]
    return (F.size(sure) == 0) | (sum(twice[1:], twice[0]) >= 2)


def _equals(value: int):
    return lambda m: m == value


def fitch_cost(k: int) -> Column:
    """Changes that a left fold over the taxa needs: where the next taxon shares no
    state with what has been seen, sets are united and one change is counted."""
    full = (1 << k) - 1
    start = F.struct(F.lit(full).alias("s"), F.lit(0).alias("n"))

    def step(a: Column, m: Column) -> Column:
        own = F.when(m.bitwiseAND(F.lit(full)) == 0, full).otherwise(m.bitwiseAND(F.lit(full)))
        both = a["s"].bitwiseAND(own)
        return F.struct(F.when(both == 0, a["s"].bitwiseOR(own)).otherwise(both).alias("s"), (a["n"] + F.when(both == 0, 1).otherwise(0)).alias("n"))

    return F.aggregate("masks", start, step)["n"]


def only_informative(pats: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(informative patterns, (msa_id, parsimony_offset) of what was dropped)."""
    d = pats.withColumn("keep", informative(k))
    offset = d.groupBy("msa_id").agg(F.sum(F.when(F.col("keep"), 0).otherwise(F.col("weight") * fitch_cost(k))).alias("parsimony_offset"))
    return d.where("keep").drop("keep"), offset


def sliced_by_names(pats: DataFrame, taxa: list[str], names: list[str]) -> DataFrame:
    """The patterns of the named taxa, in the order given. taxa: names of the rows."""
    unknown = [n for n in names if n not in taxa]
    if unknown:
        raise ValueError(f"unknown taxon: {unknown[0]}")
    return sliced(pats, [taxa.index(n) for n in names])


def from_raw(seqs: DataFrame, seq_type: str | None = None, *, parsimony: bool = False) -> tuple[DataFrame, DataFrame]:
    """(patterns, (msa_id, seq_type, parsimony_offset)) of raw sequences (msa_id, taxon,
    ord, seq), checked, of many alignments at once.

    Each alignment's type is found unless ``seq_type`` names one; with ``parsimony`` only
    informative patterns stay and the offset counts the changes of those dropped (else 0).
    """
    kinds = types(seqs) if seq_type is None else seqs.select("msa_id").distinct().withColumn("seq_type", F.lit(seq_type))
    typed = seqs.join(kinds, "msa_id")
    pats, offsets = [], []
    for kind in ("DNA", "AA") if seq_type is None else (seq_type,):
        p = patterns(columns(typed.where(F.col("seq_type") == kind), kind))
        if parsimony:
            p, offset = only_informative(p, alphabet.states(kind))
            offsets.append(offset)
        pats.append(p)
    out = pats[0] if len(pats) == 1 else pats[0].unionByName(pats[1])
    if not parsimony:
        return out, kinds.withColumn("parsimony_offset", F.lit(0).cast("long"))
    offset = offsets[0] if len(offsets) == 1 else offsets[0].unionByName(offsets[1])
    return out, kinds.join(offset, "msa_id", "left").select("msa_id", "seq_type", F.coalesce("parsimony_offset", F.lit(0)).cast("long").alias("parsimony_offset"))


def sliced(pats: DataFrame, rows: list[int]) -> DataFrame:
    """The patterns of some taxa, in the order given; columns and weights as they were."""
    return pats.withColumn("masks", F.array(*[F.element_at("masks", r + 1) for r in rows]))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sequences of both tables, each taxon once, a's before b's new ones; taxa whose
    sequences differ raise an error."""
    both = a.select("msa_id", "taxon", F.struct(F.lit(0).alias("side"), "ord").alias("at"), "seq").unionByName(b.select("msa_id", "taxon", F.struct(F.lit(1).alias("side"), "ord").alias("at"), "seq"))
    d = both.groupBy("msa_id", "taxon").agg(F.min("at").alias("at"), F.min("seq").alias("seq"), F.max("seq").alias("other"))
    clash = F.raise_error(F.concat(F.lit("conflicting sequences for taxon "), "taxon")).cast("string")
    d = d.withColumn("seq", F.when(F.col("seq") == F.col("other"), F.col("seq")).otherwise(clash))
    number = F.row_number().over(Window.partitionBy("msa_id").orderBy("at")) - 1
    return d.select("msa_id", "taxon", number.cast("long").alias("ord"), "seq")


def summary(pats: DataFrame) -> DataFrame:
    """(msa_id, n_taxa, n_sites, n_patterns) of patterns."""
    return pats.groupBy("msa_id").agg(F.max(F.size("masks")).alias("n_taxa"), F.sum("weight").alias("n_sites"), F.count(F.lit(1)).alias("n_patterns"))
