"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborspark.llm import langid, licenses, lines, mixing, pii, quality, simhash, suffixes, tokenize, topk
from arborspark.llm.queries import MODEL

from .helpers import COPY, LONG, ROWS, edge, empty, extras_kept

OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "keep_one": lambda d: simhash.keep_one(d),
    "quality": lambda d: quality.judge(d),
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "mix_sizes": lambda d: mixing.mix_sizes(d),
    "mix": lambda d: mixing.mix(d),
    "tokenize": lambda d: tokenize.decode(tokenize.encode(d, MODEL, verified="fine"), MODEL, tokenize_ids(d)),
    "langid": lambda d: langid.identify(d),
    "lines": lambda d: lines.dedup(d),
    "licenses": lambda d: licenses.scan(d),
    "pii": lambda d: pii.find(d),
    "redact": lambda d: pii.redact(d),
}
ROWWISE = {"quality", "tokenize", "langid", "lines", "licenses", "pii", "redact", "suffixes", "mix_sizes", "simhash"}


def tokenize_ids(d):
    return "_ids" if "ids" in d.columns else "ids"


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    d = edge(spark)
    out = OPERATORS[name](d)
    if name in ROWWISE:
        assert out.count() == len(ROWS)
    else:
        assert out.columns == d.columns
    if name not in ("simhash", "mix_sizes", "suffixes"):
        extras_kept(out)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    d = edge(spark).select("doc_id", "text", "lang", "source", "n_chars")
    assert stage(spark, d.limit(0), "").count() == 0
    out = stage(spark, d, "")
    assert out.count() > 0
    if name != "encode":
        assert out.columns == d.columns and out.dtypes == d.dtypes


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_simhash_cases(spark):
    got = by_id(simhash.near_duplicates(edge(spark), shingle=4))
    assert got[1]["fingerprint"] == bytes(8) and {got[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert got[4]["component_id"] == got[5]["component_id"] == 4
    kept = simhash.keep_one(edge(spark)).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(4) == 1 and 5 not in ids and 7 in ids and ids.count(1) == 1


def test_quality_cases(spark):
    got = by_id(quality.judge(edge(spark)).withColumnRenamed("_base_failed", "failed"))
    assert got[1]["failed"] and got[2]["failed"] and not got[4]["failed"]
    assert quality.measure(None) == quality.measure("")
    m = dict(zip(quality.MEASURES, quality.measure(LONG), strict=True))
    assert m["n_words"] == 60_000 and m["n_repeat_words"] > 50_000


def test_suffix_cases(spark):
    got = {}
    for r in suffixes.remove_repeats(edge(spark)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["n_bytes"] == 0 and got[4][0]["spans"] == []
    assert [bytes(r["kept"]) for r in got[5]] == [b"", b""]  # rows with one id don't remove each other's bytes
    assert 0 < len(got[6][0]["kept"]) < len(COPY) and len(got[7]) == 1


def test_mixing_cases(spark):
    d = edge(spark)
    rows = mixing.mix_sizes(d).collect()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sizes(d.repartition(7)).collect()), key=str)
    twice = [r["taken"] for r in rows if r["doc_id"] == 5]
    assert twice[0] == twice[1]
    copies = {(r["doc_id"], r["copies"]) for r in rows}
    drawn = mixing.mix(d).groupBy("doc_id").count().collect()
    expected = {}
    for r in rows:
        expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + r["copies"]
    assert {r["doc_id"]: r["count"] for r in drawn} == {k: v for k, v in expected.items() if v} and copies


def test_tokenize_cases(spark):
    out = by_id(tokenize.encode(edge(spark), MODEL, out="tokens", verified="fine"))
    assert out[1]["tokens"] is None and out[2]["tokens"] == [] and all(r["fine"] for r in out.values())


def test_langid_cases(spark):
    out = langid.identify(edge(spark))
    got = by_id(out)
    pred = out.columns[-3]
    assert got[1][pred] == got[2][pred] == got[3][pred] == "und" and got[7][pred] in ("en", "fr", "de")
    assert all(0 <= r[out.columns[-2]] <= 1 for r in got.values())
    assert {r[pred] for r in langid.identify(edge(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_line_cases(spark):
    out = lines.dedup(edge(spark), dropped="gone")
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["text"] is None and got[2][0]["text"] == "" and got[4][0]["gone"] == []
    assert all(r["text"] == "" and r["gone"] == [0] for r in got[5])
    assert got[8][0]["gone"] == [1] and got[7][0]["gone"] == []


def test_license_cases(spark):
    rows = [(1, "Released under the MIT License."), (2, "mit\nlicense MIT-LICENSE mit  License"), (3, None), (4, "Licensed under CC BY-NC 4.0."), (5, "the license of mit"), (6, "APACHE   LICENSE, mit license gnu general public license")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [p["label"] for p in got[1]["phrases"]] == ["mit"] and [b["label"] for b in got[1]["blocks"]] == ["mit"]
    assert [(p["label"], p["word"]) for p in got[2]["phrases"]] == [("mit", 0), ("mit", 2), ("mit", 4)]
    assert got[3]["n_words"] == 0 and got[5]["phrases"] == [] == got[5]["blocks"]
    assert {b["label"] for b in got[4]["blocks"]} == {"cc-by-nc"} and [p["label"] for p in got[4]["phrases"]] == ["cc-by"]
    assert [(p["label"], p["word"]) for p in got[6]["phrases"]] == [("apache", 0), ("mit", 2), ("gpl", 4)]


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    isc = "x\nPermission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    far = bsd.replace("\n", " filler" * 40 + "\n")
    short = "Released under\nthe MIT License.\n\nReleased under the MIT License.\nthe MIT license"
    rows = list(enumerate([mit, bsd, isc, gpl, far, short, "a\n" + bsd.replace("\n", " ") + "\nand in"]))
    got = {i: [(b["label"], b["block"]) for b in r["blocks"]] for i, r in by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).items()}
    assert got == {0: [("mit", 0)], 1: [("bsd", 0)], 2: [("isc", 1)], 3: [("gpl", 0)], 4: [], 5: [("mit", 3), ("mit", 0)], 6: [("bsd", 1)]}


def test_pii_cases(spark):
    rows = [
        (1, "mail é😀 a.b@c.de, x@y 10.0.0.256 1.2.3.4 +1 (202) 555-0100, 4111 1111 1111 1111, 4111111111111112"),
        (2, "account GB82 WEST 1234 5698 7654 32 and GB83WEST12345698765432 password=abcdef123456"),
        (3, None), (4, "a" * 200_000 + "@"), (5, "9" * 100_000), (6, "a@" + "b." * 20_000 + "c" + " 1" * 20_000), (7, "a@b.c_d@e.f"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: [(s["kind"], s["start"], s["end"]) for s in r["pii"]] for i, r in by_id(pii.find(d)).items()}
    text = rows[0][1]
    assert [(k, text[a:b]) for k, a, b in got[1]] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (202) 555-0100")]
    assert [k for k, _, _ in got[2]] == ["iban", "secret"] and got[3] == [] and got[4] == [] and got[5] == []
    assert [k for k, _, _ in got[6]] == ["email"] and [x[1:] for x in got[7]] == [(0, 5), (5, 11)]
    assert "[email]" in by_id(pii.redact(d))[1]["text"] and "a.b@c.de" not in by_id(pii.redact(d))[1]["text"]


def test_top_k_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, nan]), (5, [1.0, None]), (None, [9.0, 9.0]), (6, []), (7, [-1.0]), (50, [0.5, 0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("met", F.lit(2))
    got = topk.top_k(d, d.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 50), (50, 0), (50, 1), (50, 2)]
    assert topk.top_k(d.limit(0), d).count() == 0 and topk.top_k(d, d.limit(0)).count() == 0
    few = topk.top_k(d.where("vec_id in (0, 7)"), d.where("vec_id = 0"), k=5).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in few] == [(1, 7, -256 * 256)]
