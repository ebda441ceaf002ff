"""Long runs, rows repeated many times, and values at the ends of their range."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from arborspark.llm import langid, licenses, lines, mixing, tokenize, topk
from arborspark.llm.queries import MODEL

from .test_brute_force import language_cost

RUNS = {
    "nines": "9" * 100_000,
    "digits": "".join(random.Random(1).choices("0123456789", k=100_000)),
    "han": "".join(random.Random(2).choices("漢字的一是不了人我在有他這中大來上國", k=100_000)),
    "emoji": "😀🎉" * 50_000,
    "marks": "-=~" * 33_000,
    "hex": "".join(random.Random(3).choices("0123456789abcdef", k=100_000)),
    "cyrillic": "".join(random.Random(4).choices("абвгдежзиклмнопрст", k=100_000)),
    "letters": "".join(random.Random(5).choices("abcdefghij", k=100_000)),
    "spaces": " " * 100_000,
}


def test_op5_long_runs_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    d = spark.createDataFrame(list(RUNS.items()), "name string, text string").repartition(4)
    for r in tokenize.encode(d, MODEL, verified="fine").collect():
        assert r["ids"] == sp.encode(r["text"]) and r["fine"], r["name"]


def test_op5_memo_stays_small():
    e = tokenize.Encoder(tokenize.Vocabulary.load(MODEL))
    names = ("digits", "han", "marks", "emoji", "hex")
    for name in names:
        e.encode(RUNS[name])
    # linear in the texts, and no long unit is kept
    assert sum(map(len, e.memo)) <= sum(len(RUNS[n]) for n in names) and max(map(len, e.memo)) <= tokenize.KEPT


def test_op7_repeated_rows_still_teach(spark):
    en, fr = "the house and the garden with the old tree", "la maison et le jardin avec un vieux arbre"
    rows = [(i % 4, en if i % 4 < 2 else fr, "en" if i % 4 < 2 else "fr") for i in range(5_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    d = d.union(spark.createDataFrame([(90 + i, t, x) for i, (t, x) in enumerate(((en, "en"), (fr, "fr"))) for _ in range(3)], d.schema))
    got = {r["text"]: r["lang_pred"] for r in langid.identify(d).collect()}
    assert set(got.values()) <= {"en", "fr"} and got[en] == "en"


def test_op7_sample_is_bounded(spark):
    rows = [(i % 40, f"text number {i} of many", "en") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = {r[0] for r in d.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id").distinct().collect()}
    assert len(langid.sample(d, "text", "lang", "doc_id", 256)["en"]) == len(ids)
    assert len(langid.sample(d, "text", "lang", "doc_id", 5)["en"]) == 5
    assert len(langid.sample(d, "text", "lang", "doc_id", 256, max_bytes=60)["en"]) == 2
    assert len(langid.sample(d, "text", "lang", "doc_id", 256, max_bytes=1)["en"]) == 1


def test_op7_predictions_by_brute_force(spark):
    """The language whose model, counted anew in dictionaries, needs the fewest bits."""
    rng = random.Random(3)
    words = {"aa": ["tip", "tap", "top", "pit"], "bb": ["sol", "las", "oso", "lo"], "cc": ["mum", "nun", "tip", "sol"]}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randrange(1, 12))), x) for i, x in enumerate(rng.choices(list(words), k=90))] + [(90, None, "aa"), (91, "12 !?", "bb"), (92, "zz qq", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits = language_cost(sample := langid.sample(d, "text", "lang", "doc_id", 256))
    for r in langid.identify(d).collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data = r["text"].encode()
        cost = {x: bits(x, data) for x in sorted(sample)}
        best = min(cost.values())
        assert cost[r["lang_pred"]] == pytest.approx(best)
        assert r["score"] == pytest.approx(1 / sum(2 ** ((best - c) / len(data) * min(len(data), 64)) for c in cost.values()))


@pytest.mark.parametrize("others", [0, 40])
def test_op4_equal_rows_come_near_the_target(spark, others):
    rows = [(1, "four words of text", "a")] * 100 + [(2 + i, "two words" * (i % 5), "a") for i in range(others)] + [(1000 + i, "one " * 50, "b") for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix_sizes(d).collect()
    assert len(out) == len(rows)
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    mixed = mixing.mix(d).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in mixed} == {s: sum(r["taken"] for r in out if r["source"] == s) for s in "ab"}


def test_op6_sums_beyond_64_bits(spark):
    rows = [(0, [4e7, 1e9]), (1, [1e9, 1e9]), (2, [1.0, -1.0]), (3, [1e9, -1e9])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(d, d.where("vec_id = 0"), k=2).collect()
    small = d.where("vec_id <> 1")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(small, d.where("vec_id = 2"), k=2).orderBy("rank").collect()]
    assert got == [(3, 256 * 256 * 2 * 10**9), (0, 256 * 256 * (4 * 10**7 - 10**9))]


def test_op8_exact_repeats_of_short_lines(spark):
    d = spark.createDataFrame([(1, "ab\n\n- \nab\nxyz"), (2, "ab\n\n- \n7")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup(d, short=True).collect()}
    assert got == {1: "ab\n\n- \nxyz", 2: "\n- \n7"}


def test_op9_very_long_texts_of_notices(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software)\n"
    d = spark.createDataFrame([(n, notice * n) for n in (1, 2, 4000)], "doc_id long, text string")
    got = {r["doc_id"]: r["blocks"] for r in licenses.scan(d).collect()}
    # a window from each notice's first line, and one from each second line on
    assert [len(got[n]) for n in (1, 2, 4000)] == [1, 3, 7999] and {b["label"] for b in got[4000]} == {"mit"}
