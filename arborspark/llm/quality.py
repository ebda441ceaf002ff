"""Quality rules combined by weak supervision.

Every rule looks at the measures of one document and votes good (1), bad (-1) or
abstains (0). Nothing is filtered by all-must-pass: expectation-maximisation over
the vote patterns of the whole corpus estimates how often each rule votes, right
or wrong, in good documents and in each kind of bad ones (votes are independent
within a class), and a document's posterior probability of being good decides.
Bad documents come in kinds that different rules notice, so one class for all of
them would let the rules that are silent about a kind outvote the one that isn't.

The E- and M-steps need only the count of each vote pattern. There are at most
3 ** len(RULES) patterns (729), whatever the corpus, so the counts are aggregated
by Spark, the iteration runs on the driver over that bounded table, and the
posteriors go back as a literal map. Document texts are read once and never move.

Cases: null and empty texts have no words, fail the base rule and aren't kept;
very long texts are measured in one pass over their words; an empty table
gives an empty result; repeated rows are judged alike; extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut, fresh

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_marks")
WINDOW = 8


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return (0, 0, _count(data, SYMBOLS), 0, 0, 0, 0, 0, 0)
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    joined = b"".join(words)
    chars = len(joined) - _count(joined, CONTINUATION)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = sum(map(bytes.isupper, words))
    return (n, chars, _count(data, SYMBOLS), dup, repeated(np.fromiter(map(ids.__getitem__, words), np.int64, n)), lines, upper, len(ids), _count(joined, MARKS))


CONTINUATION = bytes(range(0x80, 0xC0))
MARKS = b".,;:!?"


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of 8 that occur twice or more. ids: a number a word.

    Equal windows are found by rank doubling: ranks of pairs, of fours, of eights.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, span = ids, 1
    while span < window:
        pair = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        span *= 2
        if len(count) == len(rank):
            return 0  # shorter windows are all different, so longer ones are
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(count[rank] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with the MEASURES as long columns (names step aside
    for clashes: see ``fresh``)."""
    d = docs.select(*[col(c) for c in (docs.columns if keep is None else keep)], col(text).alias("\0text"))
    names = fresh(d, *MEASURES)
    schema = T.StructType([*d.schema.fields[:-1], *[T.StructField(n, T.LongType(), False) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], *names])

    return d.mapInArrow(run, schema)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(m: dict[str, Column]) -> dict[str, Column]:
    """name -> vote column (-1, 0, 1). m: measure name -> column."""
    n = F.greatest(m["n_words"], F.lit(1))
    length, symbols, repeats = m["word_chars"] / n, m["n_symbols"] / n, m["n_repeat_words"] / n
    lines = F.greatest(m["n_lines"], F.lit(1))
    return {
        "word_length": _vote((length >= 3) & (length <= 9), (length < 2) | (length > 14)),
        "symbols": _vote(symbols <= 0.02, symbols > 0.1),
        "lines": _vote(m["n_dup_lines"] == 0, (m["n_dup_lines"] / lines) > 0.5),
        "repeats": _vote(repeats <= 0.05, repeats > 0.3),
        "upper": _vote(m["n_upper"] / n <= 0.15, m["n_upper"] / n > 0.5),
        # distinct words by the root of all, as their share falls with the text's length
        "variety": _vote(m["n_distinct"] / F.sqrt(n) >= 2, (m["n_words"] >= 30) & (m["n_distinct"] / F.sqrt(n) < 1.3)),
    }


def em(votes: np.ndarray, counts: np.ndarray, *, steps: int = 200, smooth: float = 1.0, slip: float = 0.01, anchor: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of 'good' for each vote pattern, P(vote | class) and class weights.

    votes: (patterns, rules) of -1, 0, 1; counts: documents of each. Class 0 is good;
    class 1 + j is the kind of bad documents that rule j speaks of. A kind starts
    from the votes that go along with a bad vote of its rule, the good class from
    documents without any bad vote and a share ``slip`` of wrong ones; then each
    rule's accuracy in each class, and the classes' weights, are estimated. A kind's own
    rule notices it with probability ``anchor`` at least, or it would drift away.
    """
    p, r = votes.shape
    if not p:
        return np.zeros(0), np.zeros((1 + r, r, 2)), np.zeros(1 + r)
    one = np.stack([votes == -1, votes == 1], axis=2).astype(float)  # patterns, rules, vote; abstaining says nothing
    bad = votes == -1
    start = np.column_stack([~bad.any(1), *bad.T]).astype(float) * counts[:, None]  # patterns, classes
    rate = (one * counts[:, None, None]).sum(0) + smooth
    rate /= rate.sum(1, keepdims=True)
    lik = np.einsum("pc,prv->crv", start, one) + smooth * rate
    lik /= lik.sum(2, keepdims=True)
    lik[0] = (1 - slip) * lik[0] + slip * np.array([1.0, 0])
    weight = start.sum(0) + smooth
    weight /= weight.sum()
    post = np.zeros((p, 1 + r))
    for _ in range(steps):
        logs = np.einsum("prv,crv->pc", one, np.log(np.maximum(lik, 1e-300))) + np.log(weight)
        new = np.exp(logs - logs.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done, post = np.abs(new - post).max() < 1e-9, new
        share = post * counts[:, None]
        lik = np.einsum("pc,prv->crv", share, one) + smooth * rate
        lik /= lik.sum(2, keepdims=True)
        for j in range(r):  # a kind stays one that its rule notices more often than not
            if (seen := lik[1 + j, j, 0]) < anchor:
                lik[1 + j, j] = anchor, 1 - anchor
        weight = share.sum(0) + 1e-6
        weight /= weight.sum()
        if done:
            break
    return post[:, 0], lik, weight


def judge(docs: DataFrame, text: str = "text", *, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with measures, base_failed, quality (posterior
    probability) and kept. The measured rows are computed once and kept: leave the
    text out of ``keep`` where it isn't needed."""
    m = cut(measured(docs, text, keep))
    names = dict(zip(MEASURES, m.columns[-len(MEASURES) :], strict=True))
    votes = rules({k: col(v) for k, v in names.items()})
    base = (col(names["n_words"]) < 20) | (100 * col(names["n_repeat_words"]) > 30 * col(names["n_words"]))
    pattern = F.concat_ws(",", *[v.cast("string") for v in votes.values()])
    found = m.groupBy(pattern.alias("p")).count().collect()  # at most 3 ** len(votes) rows
    table = np.array([[int(x) for x in r["p"].split(",")] for r in found], int).reshape(-1, len(votes))
    post, _, _ = em(table, np.array([r["count"] for r in found], float))
    score = F.lit(0.0)
    if found:
        known = F.create_map(*[F.lit(x) for r, p in zip(found, post, strict=True) for x in (r["p"], float(p))])
        score = F.coalesce(F.element_at(known, pattern), F.lit(0.0))
    failed, quality, kept = fresh(m, "base_failed", "quality", "kept")
    out = m.withColumn(failed, base).withColumn(quality, score)
    return out.withColumn(kept, ~col(failed) & (col(quality) >= threshold))


assert math.log2(WINDOW).is_integer()
