"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, tokenising.

Each stage reads what its predecessor kept, as Parquet, and its decisions take effect.

Cases, in every stage: an empty table stays empty; null ids, sources and languages and extra
columns stay as they are, whatever their names; very long texts are worked on whole; rows that
agree in id and text are alike. What a stage does with null and empty texts, ties and repeated
rows is in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm import langid, lines, mixing, simhash, tokenize
from arborspark.llm.queries import MODEL
from arborspark.storage import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in one of the learned languages: those without a letter go, and those
    that cost every language's model more than storing the bytes as they are. Null and empty
    texts go; of languages with equal cost the first by code point is taken; repeated rows
    stay or go together."""
    out = langid.identify(docs)
    pred, _, rate = out.columns[-3:]
    return out.where((F.col(pred) != langid.UND) & (F.col(rate) <= 8)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; documents of which nothing is left go. n_chars, where there is
    such a column, follows the text. Null and empty texts lose nothing and stay; of equal lines the
    one with the smallest doc_id stays; rows that agree in id and text are one document."""
    out = lines.dedup(docs, short=True)
    dropped = out.columns[-1]
    left = out.where((F.size(dropped) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id (nulls
    last). Texts without words are copies of each other; of repeated rows one stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target wants. Null sources are one source,
    the last; null and empty texts have no words; of equal rows any are taken once more."""
    return mixing.mix(docs, weights=(1, 2, 3), max_epochs=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text. Null texts have null
    ids (n_ids null), empty ones none; repeated rows are encoded alike."""
    out = tokenize.encode(docs.select("doc_id", "lang", "source", "text"), MODEL, verified="round_trip")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
#: SQL can't express compression models, fingerprints or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written to the
    shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
