"""Language identification by prediction by partial matching (PPM).

Per language a variable-order tree of byte contexts (orders 0 to ``ORDER``) is
counted on training texts and then frozen. A byte is coded in its longest known
context; with method C's escape probability d/(n+d) (d distinct bytes, n counts)
it falls back to the next shorter one, down to the uniform code over 256 bytes.
A text's code length is the exact sum over all its bytes, and the language with
the shortest code wins.

Frozen statistics make the code length a function of the last ORDER+1 bytes, so
scoring is table look-ups: the costs of every known (context, byte) under all
languages sit in one row of a matrix, found through a hash index; bytes that no
language knows in that context take the escape costs and are looked up one order
shorter. Texts are scored whole, in blocks of bounded size, in Arrow batches.

Training data is a bounded sample: the ``per_language`` documents of each language
with the smallest hash of doc_id (256 unless told otherwise, and at most ``max_bytes``
in all); all texts are scored.

Cases: null texts and texts without a letter are ``und`` with score 0; without any
labelled document every text is ``und``; equal code lengths go to the first
language by code point; repeated rows are scored alike and count once in the sample;
null ids, nulls in other columns and extra columns do no harm.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut, fresh, if_small

ORDER = 4
BLOCK = 1 << 20
#: Bytes of a language's training texts.
MAX_BYTES = 1 << 26
LETTER = re.compile(r"[^\W\d_]")
UND = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)  # golden-ratio multiplier


@dataclass(frozen=True)
class Index:
    """Exact look-up of sorted uint64 keys through one direct-address table."""

    keys: np.ndarray
    slot: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray) -> Index:
        bits = max(10, math.ceil(math.log2(len(keys) + 1)) + 2)
        shift = np.uint64(64 - bits)
        home = ((keys * _MIX) >> shift).astype(np.int64)
        slot = np.zeros((1 << bits) + 64, np.int32)  # entry + 1; the run after a home is bounded by the pad
        for i, h in enumerate(home.tolist()):
            while slot[h]:
                h += 1
                if h == len(slot):
                    slot = np.concatenate([slot, np.zeros(len(slot), np.int32)])
            slot[h] = i + 1
        return cls(keys, np.append(slot, np.int32(0)), shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for an unknown one."""
        at = ((keys * _MIX) >> self.shift).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        entry = self.slot[at] - 1
        hit = self.keys[entry] == keys
        hit &= entry >= 0
        out[hit] = entry[hit]
        left = np.flatnonzero(~hit & (entry >= 0))
        while len(left):
            at[left] += 1
            entry = self.slot[at[left]] - 1
            hit = (entry >= 0) & (self.keys[entry] == keys[left])
            out[left[hit]] = entry[hit]
            left = left[~hit & (entry >= 0)]
        return out


@dataclass(frozen=True)
class Model:
    """Frozen costs in bits. level k: (context of k bytes + byte) -> cost of a
    language's own path from order k on; escapes[k]: context of k bytes -> cost of
    leaving it. Rows hold one column a language."""

    languages: tuple[str, ...]
    known: tuple[tuple[Index, np.ndarray], ...]
    escapes: tuple[tuple[Index, np.ndarray], ...]

    def bits(self, data: bytes) -> np.ndarray:
        """Exact code length of ``data`` under each language."""
        total = np.zeros(len(self.languages))
        for start in range(0, len(data), BLOCK):
            lead = max(0, start - ORDER)
            part = np.frombuffer(data, np.uint8, min(len(data), start + BLOCK) - lead, lead).astype(np.uint64)
            total += self._block(part, start - lead)
        return total

    def _block(self, b: np.ndarray, skip: int) -> np.ndarray:
        n = len(b)
        total = np.zeros(len(self.languages))
        # a byte that starts the text has shorter contexts: it begins at its own order
        first = min(ORDER, n) if not skip else ORDER
        starts = [(np.array([i]), i) for i in range(first)] if not skip else []
        if n > first:
            starts.append((np.arange(max(first, skip), n), ORDER))
        for at, order in starts:
            for k in range(order, -1, -1):
                context = np.zeros(len(at), np.uint64)
                for j in range(k, 0, -1):
                    context = (context << np.uint64(8)) | b[at - j]
                index, cost = self.known[k]
                found = index.find((context << np.uint64(8)) | b[at])
                hit = found >= 0
                total += cost[found[hit]].sum(0)
                at, context = at[~hit], context[~hit]
                if not len(at):
                    break
                index, cost = self.escapes[k]
                found = index.find(context)
                found = found[found >= 0]
                if len(found):
                    total += cost[found].sum(0)
            else:
                total += 8.0 * len(at)
        return total


def _grams(data: bytes, k: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(b) <= k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(b) - k, np.uint64)
    for j in range(k + 1):
        out = (out << np.uint64(8)) | b[j : len(b) - k + j]
    return out


def train(samples: dict[str, Sequence[str]]) -> Model:
    """Counts the contexts of each language's texts and freezes the costs."""
    languages = tuple(sorted(samples))
    texts = [[t.encode() for t in samples[x]] for x in languages]
    known: list[tuple[Index, np.ndarray]] = []
    escapes: list[tuple[Index, np.ndarray]] = []
    lower: tuple[Index, np.ndarray] | None = None
    for k in range(ORDER + 1):
        counts = [np.unique(np.concatenate([_grams(t, k) for t in ts] or [np.zeros(0, np.uint64)]), return_counts=True) for ts in texts]
        keys = np.unique(np.concatenate([c[0] for c in counts] or [np.zeros(0, np.uint64)]))
        contexts = np.unique(keys >> np.uint64(8))
        cost, leave = np.zeros((len(keys), len(languages))), np.zeros((len(contexts), len(languages)))
        fall = _shorter(keys, k, lower, escapes, len(languages))
        for x, (seen, times) in enumerate(counts):
            own, at, distinct = np.unique(seen >> np.uint64(8), return_inverse=True, return_counts=True)
            whole = np.bincount(at, weights=times, minlength=len(own)) + distinct
            escape = np.log2(whole / distinct) if len(own) else np.zeros(0)
            leave[np.searchsorted(contexts, own), x] = escape
            cost[:, x] = fall[:, x] + leave[np.searchsorted(contexts, keys >> np.uint64(8)), x]
            cost[np.searchsorted(keys, seen), x] = np.log2(whole[at] / times) if len(seen) else 0
        known.append((Index.of(keys), cost))
        escapes.append((Index.of(contexts), leave))
        lower = known[-1]
    return Model(languages, tuple(known), tuple(escapes))


def _shorter(keys: np.ndarray, k: int, lower: tuple[Index, np.ndarray] | None, escapes: list, n: int) -> np.ndarray:
    """Costs of the keys' bytes from order k-1 on."""
    if lower is None:
        return np.full((len(keys), n), 8.0)
    shorter = keys & np.uint64((1 << 8 * k) - 1)
    return lower[1][lower[0].find(shorter)]  # a known string's ending is known


def _bucket(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def sample(docs: DataFrame, text: str, lang: str, doc_id: str, per_language: int, max_bytes: int = MAX_BYTES) -> dict[str, list[str]]:
    """The bounded training sample: at most ``per_language`` texts a language, one an id, in
    order of the id's hash, as long as they come to at most ``max_bytes`` (but at least one)."""
    labelled = docs.where(_bucket(col(doc_id)) != 2).where(col(lang).isNotNull() & col(text).isNotNull())
    d = labelled.select(col(lang).alias("lang"), F.xxhash64(col(doc_id)).alias("h"), col(doc_id).alias("i"), F.octet_length(col(text)).alias("size"), F.xxhash64(col(text)).alias("t"))
    # the share of each language's ids that holds twice as many as wanted and some more, so
    # that few rows are ranked, whatever the language's share of the corpus
    n = d.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    low = F.lit(-float(1 << 63)) + F.lit(float(1 << 64)) * F.least(F.lit(1.0), (2 * per_language + 64) / F.col("n"))
    d = d.join(if_small(n), "lang").where(F.col("h").cast("double") <= low)
    d = d.groupBy("lang", "h", "i").agg(F.min(F.struct("size", "t")).alias("one"))  # an id's rows count once
    in_order = Window.partitionBy("lang").orderBy("h", "i")
    d = d.withColumns({"r": F.row_number().over(in_order), "upto": F.sum("one.size").over(in_order)})
    d = d.where((F.col("r") <= per_language) & ((F.col("upto") <= max_bytes) | (F.col("r") == 1)))
    chosen = if_small(cut(d.select(F.col("lang").alias("l"), "i", F.col("one.t").alias("t"))))  # at most per_language rows a language
    same = (col(lang) == F.col("l")) & (col(doc_id) == F.col("i")) & (F.xxhash64(col(text)) == F.col("t"))
    texts = labelled.select(col(lang), col(doc_id), col(text)).join(chosen, same).groupBy("l", "i").agg(F.min(col(text)).alias("text"))
    out: dict[str, list[str]] = {}
    for r in texts.select("l", "text").toLocalIterator():
        out.setdefault(r["l"], []).append(r["text"])
    return {k: sorted(v) for k, v in out.items()}


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", *, per_language: int = 256, max_bytes: int = MAX_BYTES, model: Model | None = None) -> DataFrame:
    """docs plus lang_pred string, score double (posterior under equal priors at the
    per-byte rate, 0 to 1) and code_bits double (bits a byte under the winner)."""
    model = model or train(sample(docs, text, lang, doc_id, per_language, max_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    names = fresh(docs, "lang_pred", "score", "code_bits")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])
    text_at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [predict(m, t) for t in b.column(text_at).to_pylist()]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def predict(model: Model, text: str | None) -> tuple[str, float, float]:
    if not model.languages or not text or not LETTER.search(text):
        return UND, 0.0, 0.0
    data = text.encode()
    bits = model.bits(data)
    best = int(bits.argmin())
    rate = (bits - bits[best]) / len(data)
    # the evidence of a long text is tempered to that of 64 bytes
    post = np.exp2(-rate * min(len(data), 64))
    return model.languages[best], float(1 / post.sum()), float(bits[best] / len(data))
