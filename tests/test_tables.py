"""Alignment tables, sources, corpus steps and incremental runs."""

import random

import pytest
from pyspark.sql import functions as F

from arborspark.functions import merging, models
from arborspark.operators import alignment, corpus, likelihood, merge, search
from arborspark.plans import portable
from arborspark.sources import fasta, newick
from arborspark.streaming import ingest

from .test_kernels import hosts, random_tree

SEQS = {"t1": "ACGTAA", "t2": "ACGTAC", "t3": "AC-TAG", "t4": "GCGTNN"}


def test_fasta_files(spark, tmp_path):
    seqs = fasta.from_dict(spark, SEQS, "m")
    fasta.write(seqs, str(tmp_path / "out"))
    back = fasta.read(spark, str(tmp_path / "out"))
    assert {(r["taxon"], r["seq"]) for r in back.collect()} == set(SEQS.items())
    assert fasta.checked(fasta.read(spark, str(tmp_path / "out"))).count() >= 4


@pytest.mark.parametrize("bad", [{"a": "AC", "b": "AC"}, {"a": "AC", "b": "A", "c": "AC"}, {"a": "", "b": "", "c": ""}])
def test_bad_alignments_are_named(spark, bad):
    with pytest.raises(Exception, match="m1"):
        fasta.checked(fasta.from_dict(spark, bad, "m1")).collect()


def test_patterns_filters_and_unions(spark):
    seqs = fasta.from_dict(spark, SEQS, "m")
    assert alignment.types(seqs).first()["seq_type"] == "DNA"
    p = alignment.patterns(alignment.columns(seqs, "DNA"))
    assert p.agg(F.sum("weight")).first()[0] == 6
    assert alignment.summary(p).first()["n_taxa"] == 4
    kept, offset = alignment.only_informative(p, 4)
    assert kept.count() + 1 <= p.count() + 1 and offset.first()["parsimony_offset"] >= 1
    assert alignment.sliced(p, [2, 0]).where("pattern_id = 0").first()["masks"] == [1, 1]
    assert alignment.determined(p, 4).count() == p.count()
    both = alignment.union(seqs, fasta.from_dict(spark, {"t9": "AAAAAA", "t1": SEQS["t1"]}, "m"))
    assert [r["taxon"] for r in both.orderBy("ord").collect()] == ["t1", "t2", "t3", "t4", "t9"]
    with pytest.raises(Exception, match="conflicting"):
        alignment.union(seqs, fasta.from_dict(spark, {"t1": "TTTTTT"}, "m")).collect()


def test_empty_alignment_table(spark):
    empty = fasta.from_dict(spark, SEQS, "m").limit(0)
    assert alignment.patterns(alignment.columns(empty, "DNA")).count() == 0


def test_one_bad_job_fails_alone(spark):
    names = [f"s{i}" for i in range(10)]
    seqs = {n: "ACGTTGCAAC"[i:] + "ACGTTGCAAC"[:i] for i, n in enumerate(names)}
    cols = alignment.columns(fasta.from_dict(spark, seqs, "good").unionByName(fasta.from_dict(spark, seqs, "bad")), "DNA")
    pats = alignment.patterns(cols)
    side_a, side_b = "(((s8:.25,s0:.15):.12,(s1:.3,s2:.22):.17):.08,s3:.11,s4:.45);", "(((s5:.14,s6:.26):.19,(s9:.33,s7:.21):.13):.09,s4:.16,s0:.38);"

    rows = [("good", side_a, side_b, "s4", "s0", ["s8"], ["s9"], names), ("bad", "((", side_b, "s4", "s0", [], [], names)]
    jobs = spark.createDataFrame(rows, "msa_id string, newick_a string, newick_b string, interest_a string, interest_b string, inherited_a array<string>, inherited_b array<string>, taxa array<string>")
    got = {r["msa_id"]: r for r in merge.merge_many(jobs, pats, "JC", "DNA").collect()}
    assert got["good"]["status"] == "ok" and got["bad"]["status"] == "error" and got["bad"]["error"]
    alone = merge.merge(side_a, side_b, "s4", "s0", msa=seqs, inherited_a=[["s8"]], inherited_b=[["s9"]], model="JC")
    assert got["good"]["newick"] == alone.newick and got["good"]["loglik"] == pytest.approx(alone.loglik, abs=1e-8)
    x, m = merge.Alignment.of(seqs, "DNA"), models.jukes_cantor(4)
    sides = merging.prepare(side_a, "s4", ["s8"]), merging.prepare(side_b, "s0", ["s9"])
    best = merge.best(merge.sweep(spark, *sides, x, m)).first()
    assert best["ll"] == pytest.approx(alone.loglik, abs=1e-8)


def test_block_and_job_scores_agree(spark):
    seqs = {f"t{i}": "ACGTTGCAACGT"[i:] + "ACGTTGCAACGT"[:i] for i in range(8)}
    pats = alignment.patterns(alignment.columns(fasta.from_dict(spark, seqs, "m"), "DNA"))
    tree, taxa = portable.heap_tree(), [f"t{i}" for i in range(8)]
    a = likelihood.total(likelihood.score_sites(pats, tree, taxa, models.jukes_cantor(4))).first()["loglik"]
    b = likelihood.score_many(pats, tree, taxa, "JC", "DNA").first()["loglik"]
    assert a == pytest.approx(b, abs=1e-9)
    scores = search.spr_scores(pats, tree, taxa, models.jukes_cantor(4), radius=2, thorough=True)
    assert search.best_moves(scores, 3).count() == 3


def test_corpus_steps(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0), ("b", 3, None), ("c", 4, 3.0)], "k string, o int, v double")
    assert sorted((r["k"], r["o"]) for r in corpus.first_rows(rows, "k", ["o"]).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    s = corpus.summary(rows, "v").first()
    assert (s["n"], s["mean"], s["median"], s["p10"]) == (3, 3.0, 3.0, pytest.approx(1.4))
    assert sorted(r["shard"] for r in corpus.shard(rows, "o", 3).collect()) == [0, 0, 1, 2]
    assert corpus.shard(rows, "o", 3, 1).count() == 1
    assert [r["k"] for r in corpus.remaining(rows.select("k").distinct(), rows.where("k <> 'b'"), "k").collect()] == ["b"]
    taxa = spark.createDataFrame([(f"t{i}",) for i in range(10)], "taxon string")
    splits = spark.createDataFrame([(["t0", "t1"],), (["t0", "t1", "t2", "t3", "t4"],)], "members array<string>")
    got = corpus.choose_split(splits, taxa).collect()
    assert sum(r["side"] == "A" for r in got) == 5 and sum(r["inherited"] for r in got) == 1


def test_incremental_runs_skip_what_is_done(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()

    def add(name):
        (tmp_path / "in" / name).write_text(">a\nAC\n>b x\nAC\n>c\nAG\n")

    def go():
        ingest.process(spark, src, mark, out, lambda s: s.groupBy("msa_id").agg(F.count("taxon").alias("n"))).awaitTermination()
        return spark.read.parquet(out)

    add("one.fas")
    assert [r["n"] for r in go().collect()] == [3]
    add("two.fas")
    assert sorted(r["n"] for r in go().collect()) == [3, 3]


def test_stream_and_batch_read_the_same_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fas").write_text(">t1 len>5\nACGT\nAC\n>t2 >x>\r\nGG GT\r\nTT\n>\nCC\n>t3\n>t4 last")
    want = {(r["taxon"], r["seq"]) for r in fasta.read(spark, str(tmp_path / "in")).collect()}
    out = str(tmp_path / "out")
    ingest.process(spark, str(tmp_path / "in"), str(tmp_path / "mark"), out, lambda s: s.select("taxon", "seq")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want == {("t1", "ACGTAC"), ("t2", "GGGTTT"), ("t3", ""), ("t4", "")}


def test_counters(spark):
    from arborspark.operators import metrics

    rows = spark.createDataFrame([("ok", 0), ("error", 4), ("ok", 31), ("ok", None)], "status string, v int")
    seen, o = metrics.observed(rows)
    seen.collect()
    assert o.get == {"n": 4, "ok": 3, "errors": 1}
    assert sorted(map(tuple, metrics.histogram(rows, "v").collect())) == [(0, 1), (3, 1), (30, 1)]


def test_appended_results(spark, tmp_path):
    from arborspark.sources import results

    rows = spark.createDataFrame([("m1", 1.5)], "msa string, loglik double")
    for _ in range(2):
        results.append(rows, str(tmp_path / "out"), {"model": "JC"})
    assert results.read_results(spark, str(tmp_path / "out")).count() == 2
    assert spark.read.text(str(tmp_path / "out.config")).count() == 2


def test_results_and_logs(spark, tmp_path):
    for i, n in enumerate(("b.csv", "a.csv")):
        (tmp_path / n).write_text(f"msa,loglik\nm1,{i}\n")
    rows = fasta.read_results(spark, str(tmp_path / "*.csv"))
    assert corpus.first_rows(rows, "msa", ["shard", "line"]).first()["loglik"] == "1"
    one = spark.createDataFrame([("x\nFinal LogLikelihood: -12.5\n",), ("nothing",)], "log string")
    assert [r[0] for r in one.select(fasta.final_likelihood(F.col("log"))).collect()] == [-12.5, None]


def test_tables_of_trees(spark):
    from arborspark.operators import trees

    tree = random_tree(list("klmnwxy"), random.Random(5))
    text, kept = newick.write(tree), set("lmnxy")
    rows = [(1, text, ["k", "w"], "l"), (2, "((a,b),(c,d));", ["a"], "b"), (3, "((", [], "x")]
    d = spark.createDataFrame(rows, "id int, newick string, remove array<string>, leaf string")
    assert {r["id"]: r["error"] is None for r in trees.problems(d, ["id"]).collect()} == {1: True, 2: True, 3: False}
    got = {r["id"]: r for r in trees.pruned(d, ["id"]).collect()}
    assert got[3]["error"] and got[1]["anchors"].keys() == {"k", "w"}
    assert all(frozenset(got[1]["anchors"][x]) in hosts(tree, x, kept) for x in "kw")
    assert trees.edges(d.where("id = 1"), ["id"]).count() == 11
    assert trees.windows(d.where("id < 3"), ["id"], n=3).groupBy("id").count().where("count = 3").count() == 2
    assert trees.neighbours(d.where("id = 1"), ["id"]).count() == 8
    assert trees.neighbours(d.where("id = 1"), ["id"], radius=2).count() > 8
    clades = [r["clade"] for r in trees.clades(d.where("id = 1"), ["id"], "remove").collect()]
    assert sorted(x for c in clades for x in c) == ["k", "w"]
    pairs = d.where("id = 1").select("id", F.col("newick").alias("newick_a"), F.col("newick").alias("newick_b"))
    assert trees.distances(pairs, ["id"]).first()["rf"] == 0
    assert trees.splits(d.where("id = 1"), ["id"], "remove").count() == 0


def test_shards_keep_wide_rows(spark):
    """Rows of a kilobyte, of which adaptive execution merges other partitions than of keys."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        d = spark.range(40_000).select(((F.col("id") * 7919) % 40_000).alias("key"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("payload"))
        got = corpus.shard(d, "key", 7)
        assert got.count() == 40_000 and got.where("length(payload) <> 1024").isEmpty()
        assert got.where("shard <> key % 7").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_raw_alignments(spark, tmp_path):
    (tmp_path / "a.fas").write_text(">x with > inside\nACGT\nAC\n>y\nAAGTAC\n>z\nACGTAA\n")
    (tmp_path / "b.fas").write_text(">x\r\nEELL\r\n>z\r\nEELK\r\n>y\r\nQELL\r\n")
    seqs = fasta.checked(fasta.read(spark, str(tmp_path / "*.fas")))
    assert {r["taxon"] for r in seqs.collect()} == {"x", "y", "z"} and seqs.count() == 6
    pats, kinds = alignment.from_raw(seqs)
    assert sorted(r["seq_type"] for r in kinds.collect()) == ["AA", "DNA"]
    assert sorted(r["n"] for r in pats.groupBy("msa_id").agg(F.sum("weight").alias("n")).collect()) == [4, 6]
    few, kinds = alignment.from_raw(seqs, parsimony=True)
    assert few.count() == 0 and sorted(r["parsimony_offset"] for r in kinds.collect()) == [2, 2]
    named = fasta.ordered(seqs, ["z", "y", "x"])
    assert {(r["taxon"], r["ord"]) for r in named.collect()} == {("z", 0), ("y", 1), ("x", 2)}
    for taxa in (["z", "y"], ["z", "y", "x", "w"]):
        with pytest.raises(Exception, match="taxon not in the order|taxa missing"):
            fasta.ordered(seqs, taxa).collect()
    part = alignment.sliced_by_names(pats, ["x", "y", "z"], ["z", "x"])
    assert part.where("size(masks) <> 2").isEmpty()
    with pytest.raises(ValueError, match="unknown taxon: w"):
        alignment.sliced_by_names(pats, ["x"], ["w"])


def test_best_moves_stay_in_a_heap(spark):
    from arborspark.functions import models
    from arborspark.operators import search
    from arborspark.plans import portable as P

    d = spark.createDataFrame([(1, i, 1, i, [1 << (i * t // 3) % 4 for t in range(8)]) for i in range(20)], "msa_id long, pattern_id long, weight long, first_site long, masks array<int>")
    args = (d, P.heap_tree(), [f"t{t}" for t in range(8)], models.jukes_cantor(4))
    rows = lambda x: [tuple(r)[:-1] for r in search.best_moves(x, 4).orderBy("place").collect()]
    assert rows(search.spr_scores(*args, keep=4)) == rows(search.spr_scores(*args))
    some = args[1].spr_points()[0]
    assert {(r["pu"], r["pv"]) for r in search.spr_scores(*args, only_subtrees={some}).collect()} == {some}


def test_wide_alignments(spark):
    """As many taxa as need several tasks, with gaps as cells and as none, and columns of gaps."""
    rng, taxa = random.Random(4), 500
    kinds = [[rng.choice([1, 2, 4, 8, 31]) for _ in range(taxa)] for _ in range(6)] + [[31] * taxa]
    order = [rng.randrange(7) for _ in range(40)]
    rows = [(1, t, s, kinds[k][t]) for s, k in enumerate(order) for t in range(taxa) if kinds[k][t] != 31 or t % 2 or k == 6] + [(2, 0, 7, 1)]
    pats, cells = alignment.wide_patterns(spark.createDataFrame(rows, "msa_id long, ord int, site long, mask int").repartition(6), 31)
    first = {k: order.index(k) for k in set(order)}
    want = [(first[k], order.count(k)) for k in sorted(first, key=first.get)]
    assert [(r["first_site"], r["weight"]) for r in pats.where("msa_id = 1").orderBy("pattern_id").collect()] == want
    assert [r["pattern_id"] for r in pats.orderBy("msa_id", "pattern_id").collect()] == [*range(len(want)), 0]
    got = {(r["pattern_id"], r["ord"]): r["mask"] for r in cells.where("msa_id = 1").collect()}
    assert got == {(i, t): kinds[order[f]][t] for i, (f, _) in enumerate(want) for t in range(taxa) if kinds[order[f]][t] != 31}


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, rng.gauss(0, 5), 1.0, 2.0])) for g in ("a", "b", None) for _ in range(60)] + [("one", 4.0), ("none", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = [0.0, 0.1, 0.37, 0.5, 1.0]
    got = {(r["g"], r["p"]): r["quantile"] for r in corpus.quantiles(d, "v", ps, ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        for p in ps:
            k = (len(own) - 1) * p
            low = int(k)
            want = own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (k - low)
            assert got.pop((g, p)) == pytest.approx(want)
    assert not got
    assert corpus.quantiles(d, "v", [0.5]).first()["quantile"] == pytest.approx(d.selectExpr("percentile(v, 0.5) p").first()["p"])
    assert corpus.quantiles(d.where("false"), "v", [0.5]).count() == 0
