"""Keeps character matrices of languages, and what tree they speak for, up to date.

Comparative work on languages and manuscripts builds its alignments from texts: taxa are
languages, characters are words, and a character's state is how common the word is in the
language. Each source of documents is one alignment of four languages. For each of
the three unrooted trees of four taxa the job writes the log-likelihood of the source's
alignment, and marks the best one.

    python -m jobs.language_quartets DOCUMENTS STATE OUTPUT [--config FILE]

Incremental: a file stream over DOCUMENTS (Parquet files, or a folder of them that grows)
takes only files that have arrived since the last run (its checkpoint lies in
STATE/checkpoint). A batch of texts becomes counts of documents by source, language and
word, in a folder of its own under STATE/counts, which a repeated batch replaces; texts
are never read again. The report is made anew from the counts, so a run that stopped
between the two is mended by the next.

Words are runs of letters and non-ASCII characters after lower-casing A-Z; a word counts
once a document. States: in no document, in one, in 2 to ``often`` - 1, in more. Texts that
are null or have another language count for nothing; sources without any counted
word are in no report; a null source is a source.
"""

from __future__ import annotations

import logging
import string
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import models
from arborspark.functions.topology import Tree
from arborspark.operators import alignment, likelihood
from arborspark.storage import once

from .common import command_line

log = logging.getLogger("language_quartets")
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The taxon that the first one pairs with, by number of the tree.
TREES = (1, 2, 3)
COUNTS = "source string, lang string, word string, n long, batch long"


def quartet(taxa: Sequence[str], mate: int, bl: float) -> tuple[Tree, str]:
    """The tree on which the first taxon and taxon ``mate`` are neighbours, and its split."""
    pair, rest = [0, mate], [i for i in (1, 2, 3) if i != mate]
    tree = Tree(names={10 + i: t for i, t in enumerate(taxa)})
    for node, own in ((0, pair), (1, rest)):
        for i in own:
            tree.connect(node, 10 + i, bl)
    tree.connect(0, 1, bl)
    return tree, "|".join(",".join(taxa[i] for i in own) for own in (pair, rest))


def words(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.filter(F.split(low, APART, -1), lambda w: w != ""))


def counts(docs: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """(source, lang, word, n): in how many documents a word occurs. Partial sums on the
    map side keep common words and large sources spread."""
    d = docs.where(F.col("lang").isin(list(taxa))).select("source", "lang", F.explode(words(F.col("text"))).alias("word"))
    return d.groupBy("source", "lang", "word").agg(F.count(F.lit(1)).alias("n"))


def matrices(totals: DataFrame, taxa: Sequence[str], often: int) -> DataFrame:
    """(msa_id, site, masks): the characters (words) of each source's alignment."""
    mask = F.when(F.col("n") == 1, 1 << 1).when(F.col("n") < often, 1 << 2).otherwise(1 << 3)
    place = F.array_position(F.array(*map(F.lit, taxa)), F.col("lang")) - 1
    cells = totals.select(F.col("source").alias("msa_id"), place.alias("ord"), F.col("word").alias("site"), mask.alias("mask"))
    return alignment.from_pivot(cells, len(taxa), 1)  # absent: state 0


def report(totals: DataFrame, taxa: Sequence[str], often: int, bl: float) -> DataFrame:
    """A row for each source and tree: (source, tree, split, n_words, n_patterns,
    n_informative, loglik, best)."""
    pats = once(alignment.patterns(matrices(totals, taxa, often)))  # 4 ** 4 a source at most
    facts = pats.groupBy("msa_id").agg(F.sum("weight").alias("n_words"), F.count(F.lit(1)).alias("n_patterns"), F.sum(F.when(alignment.informative(4), F.col("weight")).otherwise(0)).alias("n_informative"))
    rows = None
    for number, mate in enumerate(TREES, 1):
        tree, split = quartet(taxa, mate, bl)
        ll = likelihood.total(likelihood.score_sites(pats, tree, list(taxa), models.jukes_cantor(4)))
        one = ll.select("msa_id", F.lit(number).alias("tree"), F.lit(split).alias("split"), F.round("loglik", 6).alias("loglik"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("msa_id").agg(F.max_by("tree", F.struct("loglik", -F.col("tree"))).alias("winner"))
    out = rows.alias("r").join(best.alias("b"), F.col("r.msa_id").eqNullSafe(F.col("b.msa_id"))).join(facts.alias("f"), F.col("r.msa_id").eqNullSafe(F.col("f.msa_id")))
    return out.select(F.col("r.msa_id").alias("source"), "tree", "split", "n_words", "n_patterns", "n_informative", "loglik", (F.col("tree") == F.col("winner")).alias("best"))


def either(path: str) -> str:
    """The path as a pattern: a file stream takes a pattern that names a single file, but
    not the file itself. Patterns stay as they are."""
    head, slash, name = path.rstrip("/").rpartition("/")
    return path if any(c in path for c in "*?[{") else f"{head}{slash}{{{name}}}"


def take(spark: SparkSession, documents: str, state: str, taxa: Sequence[str], files: int) -> dict:
    """Counts what has arrived: one folder of counts a batch."""
    done = {"read": 0, "counted": 0, "batches": 0}

    def batch(docs: DataFrame, number: int) -> None:
        own = f"{state}/counts/batch={number}"
        counts(docs, taxa).write.mode("overwrite").parquet(own)
        # counts come from the files' footers
        read, wrote = docs.count(), docs.sparkSession.read.schema(COUNTS).parquet(own).count()
        done["read"] += read
        done["counted"] += wrote
        done["batches"] += 1
        log.info("batch %d: read %d documents, wrote %d counts", number, read, wrote)

    schema = "doc_id long, text string, lang string, source string"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(either(documents))
    arriving.select("text", "lang", "source").writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return done


def run(spark: SparkSession, documents: str, state: str, output: str, *, taxa: Sequence[str] = ("de", "en", "es", "fr"), often: int = 10, branch: float = 0.2, files: int = 100) -> dict:
    """Takes what is new and writes the report, partitioned by source; returns what it read
    and wrote."""
    if len(set(taxa)) != 4:
        raise ValueError("four different languages are needed")
    done = take(spark, documents, state, taxa, files)
    try:
        every = spark.read.schema(COUNTS).parquet(f"{state}/counts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        every = spark.createDataFrame([], COUNTS)  # nothing has ever arrived
    totals = every.groupBy("source", "lang", "word").agg(F.sum("n").alias("n"))
    out = report(totals, taxa, often, branch)
    out.repartition("source").sortWithinPartitions("tree").write.mode("overwrite").partitionBy("source").parquet(output)
    done["written"] = spark.read.schema(out.schema).parquet(output).count()
    log.info("read %(read)d new documents in %(batches)d batches, wrote %(counted)d counts and %(written)d rows of the report", done)
    return done


if __name__ == "__main__":
    command_line(__file__, __doc__, run, {"documents": "Parquet files, or a folder of them", "state": "folder of counts and checkpoint", "output": "folder of the report"})
