"""The jobs: their rows against SQL, reruns, and runs over an input that grows."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import alignment_report, language_quartets, queries

from .conftest import SF_DIR

ROOT = Path(queries.__file__).parent.parent


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql(name, compare):
    compare(queries.QUERIES[name], queries.SQL[name])


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_report_by_shards_equals_the_whole(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    done = alignment_report.run(spark, SF_DIR, whole, taxa=4, shards=2)
    assert done["read"] == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count() and done["written"] == spark.read.parquet(whole).count()
    assert f"wrote {done['written']} alignments" in caplog.text
    for shard in (0, 1):
        alignment_report.run(spark, SF_DIR, parts, taxa=4, shards=2, shard=shard)
    want = rows(spark.read.parquet(whole), "msa_id")
    assert want and rows(spark.read.parquet(parts), "msa_id") == want
    # a shard's rerun replaces that shard and touches no other
    first = files(parts)
    alignment_report.run(spark, SF_DIR, parts, taxa=4, shards=2, shard=1)
    again = files(parts)
    assert rows(spark.read.parquet(parts), "msa_id") == want
    keep = lambda x: {k: v for k, v in x.items() if k.startswith("shard=0")}
    assert keep(first) == keep(again) and first != again
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_report_of_odd_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_quantity").schema
    day = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").first()["l_shipdate"]
    spark.createDataFrame([(None, day, 1.0), (1, None, 1.0), (1, day, None), (2, day, 3.0)], schema).write.parquet(str(tmp_path / "t/lineitem.parquet"))
    assert alignment_report.run(spark, str(tmp_path / "t"), str(tmp_path / "out"))["written"] == 1
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (row["n_sites"], row["n_informative"], row["status"], row["gap_share"]) == (1, 0, "uninformative", 0.75)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "e/lineitem.parquet"))
    assert alignment_report.run(spark, str(tmp_path / "e"), str(tmp_path / "none"))["written"] == 0


DOCS = "doc_id long, text string, lang string, source string"


def test_growing_documents_are_read_once(spark, tmp_path):
    docs, state, out = (str(tmp_path / n) for n in ("docs", "state", "report"))
    every = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    half = every.where("doc_id % 2 = 0")
    half.repartition(3).write.parquet(docs)
    first = language_quartets.run(spark, docs, state, out, files=2)
    assert first["read"] == half.count() and first["batches"] == 2
    one = rows(spark.read.parquet(out), "source", "tree")
    # nothing new: the same report, and no document is read
    again = language_quartets.run(spark, docs, state, out)
    assert (again["read"], again["batches"], again["written"]) == (0, 0, first["written"])
    assert rows(spark.read.parquet(out), "source", "tree") == one
    # the other half arrives
    rest = every.where("doc_id % 2 = 1")
    rest.coalesce(1).write.mode("append").parquet(docs)
    assert language_quartets.run(spark, docs, state, out)["read"] == rest.count()
    two = rows(spark.read.parquet(out), "source", "tree")
    fresh = str(tmp_path / "fresh")
    every.write.parquet(f"{fresh}/docs")
    language_quartets.run(spark, f"{fresh}/docs", f"{fresh}/state", f"{fresh}/report")
    assert two != one and rows(spark.read.parquet(f"{fresh}/report"), "source", "tree") == two


def test_a_run_that_stopped_is_mended(spark, tmp_path, monkeypatch):
    docs, state, out = (str(tmp_path / n) for n in ("docs", "state", "report"))
    spark.createDataFrame([(1, "one two", "de", "s"), (2, "one one", "en", "s"), (3, "three", "es", "s"), (4, "three two", "fr", "s")], DOCS).coalesce(1).write.parquet(docs)
    broken = language_quartets.report
    monkeypatch.setattr(language_quartets, "report", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        language_quartets.run(spark, docs, state, out)
    monkeypatch.setattr(language_quartets, "report", broken)
    # the batch is counted; were it taken again it would replace its own folder
    assert language_quartets.run(spark, docs, state, out)["read"] == 0
    got = rows(spark.read.parquet(out).select("tree", "split", "n_words", "n_patterns", "n_informative", "best"), "tree")
    assert got == [(1, "de,en|es,fr", 3, 3, 3, True), (2, "de,es|en,fr", 3, 3, 3, False), (3, "de,fr|en,es", 3, 3, 3, False)]


def test_documents_that_count_for_nothing(spark, tmp_path):
    docs = str(tmp_path / "docs")
    odd = [(1, None, "de", "s"), (2, "", "de", "s"), (3, " 12 ", "en", "t"), (4, "word", None, "t"), (5, "word", "it", "t"), (None, "Wort WORT wort", "de", None), (6, "x" * 300_000, "de", "u")]
    spark.createDataFrame(odd, DOCS).withColumn("word", language_quartets.F.lit("clash")).write.parquet(docs)
    done = language_quartets.run(spark, docs, str(tmp_path / "state"), str(tmp_path / "report"))
    got = rows(spark.read.parquet(str(tmp_path / "report")).select("source", "tree", "n_words"), "source", "tree")
    assert done["read"] == 7 and got == [(None, i, 1) for i in (1, 2, 3)] + [("u", i, 1) for i in (1, 2, 3)]
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "empty"))
    assert language_quartets.run(spark, str(tmp_path / "empty"), str(tmp_path / "s2"), str(tmp_path / "r2"))["written"] == 0
    with pytest.raises(ValueError, match="four"):
        language_quartets.run(spark, docs, str(tmp_path / "s3"), str(tmp_path / "r3"), taxa=["de", "en"])


def test_command_lines(spark, tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"shards": 3}))
    run = [sys.executable, "-m", "jobs.alignment_report", SF_DIR, str(tmp_path / "out"), "--config", str(config), "--set", "shard=1"]
    made = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ)
    assert made.returncode == 0, made.stderr[-2000:]
    assert "read" in made.stderr and "wrote" in made.stderr
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} <= {"shard=1"}
