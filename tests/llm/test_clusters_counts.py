"""Centroid clustering against exact Python integers, and counts against the library."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborspark.llm import kmeans, tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, k, rounds, dims, scale, seed="1"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for r in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), (_, x) in zip(kept, at, strict=True) if x == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    inertia = {j: sum(d for d, x in at if x == j) for j in range(len(centroids))}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), centroids[j]) for (i, _), (d, j) in zip(kept, at, strict=True)), key=repr)


def found(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in df.collect()), key=repr)


def vectors(seed, n=120, dims=4):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, 7]), [rng.gauss(rng.choice([-2, 0, 3]), 0.3) for _ in range(dims)]) for i in range(n)]
    rows += rows[:9]  # repeated rows
    rows += [(1000, None), (1001, []), (1002, [0.5] * (dims - 1)), (1003, [0.5, None, 0.1, 0.2]), (1004, [float("nan")] * dims), (1005, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [0.25] * dims), (None, [-0.75] * dims), (1006, [1e7, -1e7, 0.0, 3.0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,rounds", [(0, 5, 3), (1, 16, 3), (2, 1, 0), (3, 500, 2)])
def test_clusters(spark, seed, k, rounds):
    rows = vectors(seed)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"V": F.lit("x"), "Cluster": F.lit(None).cast("string")}).repartition(7)
    assert found(kmeans.lloyd(d, k, rounds, dims=4)) == brute(rows, k, rounds, 4, 64)


def test_clusters_with_ties_and_empty_ones(spark):
    # equal starts: the first takes all and the others stay where they are
    rows = [(i, [1.0, 1.0]) for i in range(6)] + [(i, [1.0 + i, 0.0]) for i in range(6, 9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(kmeans.lloyd(d, 6, 3, dims=2, scale=1)) == brute(rows, 6, 3, 2, 1)
    assert kmeans.lloyd(d.limit(0), 6, 3, dims=2).count() == 0
    assert kmeans.lloyd(d, 6, 3, dims=3).count() == 0


def test_distances_beyond_64_bits():
    v, c = np.array([[1 << 40, 0], [3, 4]], np.int64), np.array([[0, 0]], np.int64)
    with pytest.raises(OverflowError):
        kmeans.nearest(v, c)
    at, d = kmeans.nearest(np.array([[1 << 31, 5]], np.int64), np.array([[-1, 5], [0, 5]], np.int64))
    assert at.tolist() == [1] and d.tolist() == [1 << 62]


def test_no_vector_is_shuffled(spark):
    d = spark.createDataFrame(vectors(0), "vec_id long, embedding array<double>")
    kept = kmeans.quantised(d, "vec_id", "embedding", 4, 64)
    shared = spark.sparkContext.broadcast(kmeans.first_centroids(kept, 3, "1"))
    sums = kept.select("v").mapInPandas(kmeans._partial_sums(shared), "cluster int, dim int, total decimal(38,0), n long")
    assert sums.count() <= kept.rdd.getNumPartitions() * 3 * 4


TEXTS = [
    None, "", " ", "word", "a <|endoftext|> b<|endoftext|>", "Ünïcödé 漢字。かな、😀\r\n\t tabs  and   spaces ", "a\x00b", "x" * 5000, "don't we'll they've", "word", "word",
    "<|endoftext|", "漢字" * 3000, " ".join(f"word{i} it's {i}," for i in range(20_000)), "\n".join("line   " + "字。" * (i % 7) for i in range(9_000)),
]


TOKENIZER = Tokenizer.from_file(PATH)


def library(texts):
    return [len(TOKENIZER.encode(x or "", add_special_tokens=False)) for x in texts]


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, x, "k", "k") for i, x in enumerate(texts)], "doc_id long, text string, Digest string, N_TOKENS string")


def counted(spark, texts, cache, **options):
    rows = tokencounts.count_tokens(table(spark, texts), PATH, cache, **options).collect()
    return [(r[-2], r[-1]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def stored(spark, cache):
    return spark.read.parquet(cache).count()


@pytest.mark.parametrize("small,hot", [(50_000, 10_000), (0, 10_000), (0, 3)])
def test_counts_match_the_library(spark, tmp_path, monkeypatch, small, hot):
    monkeypatch.setattr(tokencounts, "SMALL", small)
    texts = TEXTS + ["many of these"] * (2_000 if hot == 3 else 5)
    want = [(len((t or "").encode()), n) for t, n in zip(texts, library(texts), strict=True)]
    monkeypatch.setattr(tokencounts, "HOT", hot)
    cache = str(tmp_path / "cache")
    assert counted(spark, texts, cache, keep=["doc_id"]) == want
    assert stored(spark, cache) == len({t or "" for t in texts})
    assert counted(spark, texts, cache) == want  # with all columns, and from the cache alone
    assert stored(spark, cache) == len({t or "" for t in texts})


def test_only_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    counted(spark, ["one text", "another", "one text"], cache)
    assert stored(spark, cache) == 2
    # a stored count is believed: what is stored is what a second run returns
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long")).write.partitionBy("version").parquet(str(tmp_path / "marked"))
    got = counted(spark, ["one text", "a third text"], str(tmp_path / "marked"))
    assert [n for _, n in got] == [77, *library(["a third text"])]
    assert stored(spark, str(tmp_path / "marked")) == 3
    # another version of the tokenizer has counts of its own
    other = tmp_path / "other.json"
    other.write_bytes(open(PATH, "rb").read() + b"\n")
    rows = tokencounts.count_tokens(table(spark, ["one text"]), str(other), str(tmp_path / "marked")).collect()
    assert rows[0][-1] == library(["one text"])[0] and stored(spark, str(tmp_path / "marked")) == 4


def test_counts_of_an_empty_table_and_repeated_rows(spark, tmp_path):
    cache = str(tmp_path / "cache")
    assert tokencounts.count_tokens(table(spark, []), PATH, cache).count() == 0
    d = table(spark, ["same row"])
    d = d.union(d).union(d)
    out = tokencounts.count_tokens(d, PATH, cache)
    assert out.columns[:4] == d.columns and out.count() == 3 and {r["Digest"] for r in out.collect()} == {"k"}
    assert stored(spark, cache) == 1


def test_long_texts_are_cut_without_a_change(monkeypatch):
    raw = open(PATH, "rb").read()
    assert tokencounts.splits_at_spaces(raw) and not tokencounts.splits_at_spaces(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    rng, want = random.Random(4), []
    alphabet = ["a", "b'", "'s", " ", "  ", "\n", "\t", "1", "_", "字", "。", "か", "、", "é", ".", "!", "<|endoftext|>", " ", "​", "😀", "\x1c", "²"]
    texts = ["".join(rng.choices(alphabet, k=400)) for _ in range(300)]
    want = library(texts)
    for most in (1, 7, 50):
        assert [sum(library(tokencounts.parts(t, most))) for t in texts] == want
        assert all("".join(tokencounts.parts(t, most)) == t for t in texts)
