"""Incremental corpora: each run processes the alignments that have arrived since.

Available-now triggers over a folder of FASTA files are the streaming form of resuming a
corpus run: the checkpoint remembers which files are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from arborspark.sources import fasta


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (msa_id, taxon, ord, seq) from a folder; a file is one alignment.

    ord is the place of the record in its file; records are cut where ``fasta.read`` cuts."""
    whole = spark.readStream.option("maxFilesPerTrigger", per_batch).text(path, wholetext=True)
    records = whole.select(F.col("_metadata.file_path").alias("msa_id"), F.posexplode(F.split("value", r"(?:^|\n)>")).alias("at", "value"))
    return fasta.parsed(records.select("msa_id", F.col("at").cast("long").alias("ord"), "value"))


def process(spark: SparkSession, path: str, checkpoint: str, output: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs ``work`` on what has arrived and appends its rows to a Parquet table."""

    def batch(seqs: DataFrame, _: int) -> None:
        work(seqs).write.mode("append").parquet(output)

    return arriving(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
