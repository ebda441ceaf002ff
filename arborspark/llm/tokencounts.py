"""Token counts through a cache of digests.

A text's count depends on its content and on the tokenizer alone, so counts are stored
under (tokenizer version, digest of the normalised content): a Parquet table,
partitioned by version, that grows by appends. A run

1. takes each row's digest and size in bytes; only these move, never the text,
2. joins the distinct digests to the cache; the rest are the misses,
3. brings one text of each distinct miss together (equal texts combine on the map
   side, so a text that a third of the rows share moves once a task), encodes it and
   appends the new counts to the cache,
4. joins the rows to the counts. Digests that many rows share are joined through a
   broadcast of at most ``HOT`` rows, so none of them makes a hot task.

Content is normalised by ``normalise``, which must not change a count. The default turns
null into the empty text and leaves all else: a byte-level tokenizer counts
different bytes differently. The version digests the tokenizer's file and the library's
version. The file is read on the driver and broadcast (its size is the vocabulary's).

Long texts are encoded in parts of about ``PART`` characters where the tokenizer splits
at white space anyway; the counts add up to the whole's. A run of characters without
such a place stays whole.

Cases: null counts as the empty text, with 0 tokens; special strings in a text count
as the library counts them by default; repeated rows and equal texts count alike and
are encoded once; an empty table appends nothing; runs that append at the same time
may store a count twice, which changes nothing; extra columns stay.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL, col, cut, fresh

#: Digests joined by broadcast at most: those of more than 1/HOT of all rows.
HOT = 10_000
PART = 1 << 15
#: Texts, and their characters, that are encoded at once.
ROWS, CHARS = 256, 1 << 20
CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("version", T.StringType())])
#: Places where byte-level pre-tokenisation always ends a word: before white space that
#: follows a letter or digit, and between an ideograph, kana or syllable and a mark.
PLACES = re.compile(r"(?<=\w)(?=[ \t\r\n])|(?<=[一-龥ぁ-ゖァ-ヺ가-힣])(?=[。，、！？；：])")


def version_of(tokenizer: bytes) -> str:
    """Digest of a tokenizer file and of the library that reads it."""
    import tokenizers

    return hashlib.sha256(tokenizer + tokenizers.__version__.encode()).hexdigest()[:32]


def splits_at_spaces(tokenizer: bytes) -> bool:
    """Whether texts may be encoded in parts: byte-level words, no normaliser, no
    template around a text, and no added token that takes part of its surroundings."""
    j = json.loads(tokenizer)
    words, added = j.get("pre_tokenizer") or {}, j.get("added_tokens") or []
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    return plain and not j.get("normalizer") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or PLACES.search(a["content"]) or a["content"] != a["content"].strip() for a in added)


def parts(text: str, most: int = PART) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at PLACES."""
    at = 0
    while len(text) - at > most and (place := PLACES.search(text, at + most)):
        yield text[at : place.start()]
        at = place.start()
    yield text[at:]


_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(raw: bytes, version: str) -> tuple:
    """(tokenizer, whether it splits at spaces); one a Python worker."""
    if version not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(raw.decode())
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[version] = t, splits_at_spaces(raw)
    return _TOKENIZERS[version]


def _counts(raw: bytes, version: str, texts: Sequence[str]) -> list[int]:
    """Tokens of each text, without added special tokens."""
    t, divisible = _tokenizer(raw, version)
    out = [0] * len(texts)
    own, held, size = [], [], 0

    def flush() -> None:
        nonlocal size
        for i, e in zip(own, t.encode_batch_fast(held, add_special_tokens=False), strict=True):
            out[i] += len(e)
        own.clear()
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for p in parts(text) if divisible else (text,):
            if held and (len(held) >= ROWS or size + len(p) > CHARS):
                flush()
            own.append(i)
            held.append(p)
            size += len(p)
    flush()
    return out


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of a version, each digest once; none if there is no cache yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def whole(text: Column) -> Column:
    """The default normalisation: null is the empty text."""
    return F.coalesce(text, F.lit(""))


def fill(docs: DataFrame, text: str, digests: DataFrame, tokenizer: bytes, cache: str, normalise: Callable[[Column], Column] = whole) -> None:
    """Encodes one text of each of ``digests`` that the cache lacks, and appends the counts."""
    spark, version = docs.sparkSession, version_of(tokenizer)
    missing = cut(digests.select("digest").join(cached(spark, cache, version), "digest", "left_anti"))
    shared = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                s = b.slice(at, ROWS)
                n = _counts(shared.value, version, s.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([s.column(0).cast(pa.binary()), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    content = normalise(col(text))
    texts = docs.select(digest_of(content).alias("digest"), content.alias("text"))
    few = missing.limit(SMALL + 1).count() <= SMALL
    if few:  # only the misses' texts move
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    if not few:  # equal texts combine before they move, then meet the misses where they are
        distinct = distinct.join(missing, "digest", "left_semi")
    new = distinct.mapInArrow(run, "digest binary, n_tokens long").withColumn("version", F.lit(version))
    new.write.mode("append").partitionBy("version").parquet(cache)


def digest_of(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, text: str = "text", *, keep: Sequence[str] | None = None, normalise: Callable[[Column], Column] = whole) -> DataFrame:
    """The ``keep`` columns of docs (all, if None) plus n_bytes and n_tokens (long).

    cache: folder of the cache, where driver and executors can read and write; it is
    made if there is none."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        tokenizer = f.read()
    kept = docs.columns if keep is None else list(keep)
    digest, n_bytes, n_tokens, hot, other = fresh(docs, "digest", "n_bytes", "n_tokens", "hot_tokens", "counted")
    content = normalise(col(text))
    rows = docs.select(*[col(c) for c in kept], F.octet_length(whole(col(text))).cast("long").alias(n_bytes), digest_of(content).alias(digest))
    if text not in kept:  # narrow: texts are read and digested once
        rows = cut(rows)
    times = cut(rows.select(col(digest).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    fill(docs, text, times, tokenizer, cache, normalise)

    found = cut(times.join(cached(spark, cache, version_of(tokenizer)), "digest"))
    many = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] / HOT
    often = F.col("n") > F.greatest(F.lit(many), F.lit(1000))  # so at most HOT digests
    top = F.broadcast(found.where(often).select(F.col("digest").alias(hot + "_of"), F.col("n_tokens").alias(hot)))
    rest = found.where(~often).select(F.col("digest").alias(other), F.col("n_tokens").alias(n_tokens))
    marked = rows.join(top, F.col(digest) == F.col(hot + "_of"), "left").drop(hot + "_of")
    common = marked.where(F.col(hot).isNotNull()).select(*[col(c) for c in kept], n_bytes, F.col(hot).alias(n_tokens))
    single = marked.where(F.col(hot).isNull()).join(rest, F.col(digest) == F.col(other)).select(*[col(c) for c in kept], n_bytes, n_tokens)
    return common.union(single)


__all__ = ["cached", "count_tokens", "fill", "version_of"]
