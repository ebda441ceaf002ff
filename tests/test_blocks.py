"""Sums over blocks and messages by level, against the kernels that see an alignment whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.functions import curves, models
from arborspark.functions.likelihood import Scorer
from arborspark.functions.merging import Options, connect, prepare
from arborspark.functions.optimize import MOST, newton, newton_many
from arborspark.operators import blocks, levels
from arborspark.sources.newick import write

from .test_kernels import naive, random_tree


def alignment(names, k, n, seed, states=None):
    """Columns that change little along the names, so that lengths are finite; some gaps."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c, column = rng.randrange(k), []
        for _ in names:
            c = rng.randrange(k) if rng.random() < 0.25 else c
            column.append((1 << k + 1) - 1 if rng.random() < 0.05 else 1 << c)
        rows.append(column)
    return rows


@pytest.mark.parametrize("model", [models.jukes_cantor(4), models.jtt(), models.gtr([1, 2, 0.5, 0.7, 3, 1], [0.3, 0.2, 0.2, 0.3])])
def test_newton_over_blocks(spark, model):
    names = [f"t{i}" for i in range(7)]
    tree = random_tree(names, random.Random(1))
    data = {j: alignment(names, model.k, 90, j) for j in range(3)}
    d = spark.createDataFrame([(j, i, c) for j, rows in data.items() for i, c in enumerate(rows)], "msa_id long, site int, masks array<int>")
    u, v, _ = tree.edges()[3]
    parts = blocks.blocks(d, 8)
    assert parts.groupBy("msa_id").count().where("count < 5").isEmpty() and parts.agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))).first()[0] == 270
    tables = blocks.sumtables(parts, tree, names, model, u, v)
    got = {r["msa_id"]: r for r in blocks.newton(tables, parts.select("msa_id", F.lit(3.0).alias("t")).distinct(), model).collect()}
    for j, rows in data.items():
        s = Scorer(tree, dict(zip(names, np.array(rows).T, strict=True)), np.ones(len(rows)), model)
        want, fine = newton(model, s.weights, s.message(u, v), s.message(v, u), 0.1)
        assert fine and got[j]["fine"] and got[j]["t"] == pytest.approx(want, abs=1e-4)
        at = spark.createDataFrame([(j, [float(np.log(got[j]["t"]))])], "msa_id long, points array<double>")
        row = blocks.evaluated(tables, at, model, ["msa_id"]).first()
        moved = tree.copy()
        moved.connect(u, v, got[j]["t"])
        assert row["loglik"][0] == pytest.approx(Scorer(moved, s_masks(names, rows), s.weights, model).score(), abs=1e-8)


def s_masks(names, rows):
    return dict(zip(names, np.array(rows).T, strict=True))


def test_branches_without_an_optimum(spark):
    """Equal ends want no length, unlike ones all of it, and gaps don't care."""
    names = [f"t{i}" for i in range(4)]
    tree = random_tree(names, random.Random(2))
    leaf = tree.leaf("t0")
    (at,) = tree.adj[leaf]
    gap = (1 << 5) - 1
    data = {0: [[1, 1, 1, 1]] * 9, 1: [[gap] * 4] * 3, 2: [[1, 2, 2, 2], [2, 1, 1, 1], [4, 8, 8, 8]] * 4}
    d = spark.createDataFrame([(j, i, c) for j, rows in data.items() for i, c in enumerate(rows)], "msa_id long, site int, masks array<int>")
    tables = blocks.sumtables(blocks.blocks(d, 2), tree, names, models.jukes_cantor(4), leaf, at)
    got = {r["msa_id"]: r["t"] for r in blocks.newton(tables, d.select("msa_id", F.lit(0.5).alias("t")).distinct(), models.jukes_cantor(4)).collect()}
    assert got[0] < 1e-5 and got[2] > 10 and got[2] <= MOST * 1.0001 and set(got) == {0, 1, 2}


@pytest.mark.parametrize("eps,window", [(1000.0, 4), (0.5, 2)])
def test_sweep_finds_the_kernels_pair(spark, eps, window):
    rng, model, rows, data = random.Random(7), models.jukes_cantor(4), [], {}
    names = [f"s{i}" for i in range(12)]
    for j in range(2):
        a, b = (write(random_tree([*own, guest], rng)) for own, guest in ((names[:6], names[6 + j]), (names[6:], names[j])))
        rows.append((j, a, b, names[6 + j], names[j], [names[1 + j]], [], names))
        data[j] = alignment(names, 4, 60, j)
    jobs = spark.createDataFrame(rows, "msa_id long, newick_a string, newick_b string, interest_a string, interest_b string, inherited_a array<string>, inherited_b array<string>, taxa array<string>")
    d = spark.createDataFrame([(j, i, c) for j, x in data.items() for i, c in enumerate(x)], "msa_id long, site int, masks array<int>")
    o = Options(window=window, eps_five=eps)
    best = {r["msa_id"]: r for r in blocks.winners(blocks.sweep(blocks.boundary_messages(jobs, blocks.blocks(d, 16), model, o), model, o)).collect()}
    for j, x in data.items():
        sides = [prepare(rows[j][1 + i], rows[j][3 + i], rows[j][5 + i]) for i in (0, 1)]
        ll, at, bt, _ = connect(*sides, s_masks(names, x), np.ones(len(x)), model, o)
        ends = [s.core.window(*s.anchor, o.window) for s in sides]
        assert best[j]["n_pairs"] == window**2 and best[j]["ll"] == pytest.approx(ll, abs=max(2e-4, min(eps, 1) * 2))
        assert (ends[0][best[j]["a"]], ends[1][best[j]["b"]]) == (at, bt)


def table(spark, tree):
    """(node, parent, bl, taxon), rooted at an inner node."""
    root = min(x for x in tree.adj if x not in tree.names)
    rows = [(u, p, tree.adj[u][p] if p is not None else None, tree.names.get(u)) for u, p in tree.postorder(root)]
    return spark.createDataFrame(rows, "node long, parent long, bl double, taxon string")


def caterpillar(n):
    from arborspark.functions.topology import Tree

    t = Tree(names={i: f"t{i}" for i in range(n)})
    for i in range(1, n - 1):
        t.connect(i, n + i, 0.1)
        if i > 1:
            t.connect(n + i, n + i - 1, 0.05)
    t.connect(0, n + 1, 0.2)
    t.connect(n - 1, 2 * n - 2, 0.3)
    return t


@pytest.mark.parametrize("shape,model", [("random", models.jtt()), ("caterpillar", models.jukes_cantor(4))])
def test_levels_score_as_the_kernel(spark, shape, model):
    names = [f"t{i}" for i in range(9)]
    tree = random_tree(names, random.Random(3)) if shape == "random" else caterpillar(9)
    rows = alignment(names, model.k, 50, 5)
    full = (1 << model.k + 1) - 1
    cells = [(n, 3 * i, m) for i, c in enumerate(rows) for n, m in zip(names, c, strict=True) if m != full and n != "t4"]  # a taxon without a cell
    for c in rows:
        c[4] = full
    d = spark.createDataFrame(cells, "taxon string, site long, mask int")
    t = levels.Levels(table(spark, tree), d, model, 16)
    want = Scorer(tree, s_masks(names, rows), np.ones(50), model).score()
    assert want == pytest.approx(naive(tree, s_masks(names, rows), np.ones(50), model))
    assert t.loglik().first()["loglik"] == pytest.approx(want, abs=1e-9)
    edges = t.edges().collect()
    assert len(edges) == 15 and all(r["loglik"] == pytest.approx(want, abs=1e-8) for r in edges)
    assert levels.score(table(spark, tree), d, model, 1000).first()["loglik"] == pytest.approx(want, abs=1e-9)


def test_levels_rescale_deep_trees(spark):
    n = 64
    tree = random_tree([f"t{i}" for i in range(n)], random.Random(4))
    rows = alignment([f"t{i}" for i in range(n)], 20, 6, 2)
    d = spark.createDataFrame([(f"t{j}", i, m) for i, c in enumerate(rows) for j, m in enumerate(c)], "taxon string, site long, mask int")
    want = Scorer(tree, {f"t{j}": np.array([c[j] for c in rows]) for j in range(n)}, np.ones(6), models.jtt()).score()
    assert levels.score(table(spark, tree), d, models.jtt(), 4).first()["loglik"] == pytest.approx(want, abs=1e-8)


def test_depths_take_a_logarithm_of_rounds(spark):
    tree = caterpillar(3000)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("depths", "depths")
    got = levels.depths(table(spark, tree)).agg(F.max("depth"), F.count(F.lit(1))).first()
    jobs = len(tracker.getJobIdsForGroup("depths"))
    spark.sparkContext.setJobGroup("", "")
    assert tuple(got) == (2998, 5998) and jobs < 120


def test_sweep_ends_in_the_optimum_of_the_kernel(spark, tmp_path):
    """Suppliers 340 to 349 as job 134: lengths found on another path than the kernel's end
    3e-5 below its likelihood."""
    from arborspark import queries

    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_suppkey between 340 and 349")
    lines.withColumn("l_suppkey", F.col("l_suppkey") + 1000).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in queries.merge_blocks(spark, str(tmp_path)).select("msa_id", "n_pairs", "agree").collect()] == [(134, 9, True)]


def side_jobs(spark, window=3):
    """Messages of two merges of four taxa a side."""
    rng, names, rows, data = random.Random(9), [f"s{i}" for i in range(8)], [], []
    for j in range(2):
        a, b = (write(random_tree([*own, guest], rng)) for own, guest in ((names[:4], names[4 + j]), (names[4:], names[j])))
        rows.append((j, a, b, names[4 + j], names[j], [], [], names))
        data += [(j, i, c) for i, c in enumerate(alignment(names, 4, 40, j))]
    jobs = spark.createDataFrame(rows, "msa_id long, newick_a string, newick_b string, interest_a string, interest_b string, inherited_a array<string>, inherited_b array<string>, taxa array<string>")
    d = spark.createDataFrame(data, "msa_id long, site int, masks array<int>")
    m = models.jukes_cantor(4)
    return m, blocks.boundary_messages(jobs, blocks.blocks(d, 8), m, Options(window=window))


def test_sweep_takes_few_jobs(spark):
    """A branch takes one reading of the messages, not one for each of its steps."""
    model, messages = side_jobs(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sweep", "sweep")
    got = blocks.sweep(messages, model, Options(window=3)).count()
    jobs = len(tracker.getJobIdsForGroup("sweep"))
    spark.sparkContext.setJobGroup("", "")
    assert got == 18 and jobs < 80


def test_steps_without_a_trusted_curve(spark):
    """Where no curve is trusted, the steps take a reading each and end in the same place."""
    model, messages = side_jobs(spark, 2)
    pairs = [(j, a, b, [0.1, 0.3, 0.02, 1.0, 0.2], float("nan")) for j in range(2) for a in range(2) for b in range(2)]
    live = spark.createDataFrame(pairs, "msa_id long, a int, b int, t array<double>, ll double")
    one, other = ({tuple(r[:3]): r for r in blocks._moved(messages, live, True, model, 3, share).collect()} for share in (curves.SHARE, -1.0))
    assert len(one) == 8 and one.keys() == other.keys()
    for key, r in one.items():
        assert r["t"] == pytest.approx(other[key]["t"], abs=1e-6) and r["ll"] == pytest.approx(other[key]["ll"], abs=1e-9)
        assert [x for i, x in enumerate(r["t"]) if i != 3] == [0.1, 0.3, 0.02, 0.2] and r["t"][3] != 1.0


@pytest.mark.parametrize("model", [models.jukes_cantor(4), models.jtt(), models.gtr([1, 2, 0.5, 0.7, 3, 1], [0.3, 0.2, 0.2, 0.3])])
def test_curves_take_the_kernels_steps(model):
    """From starts of all sizes, on branches with several optima and with none."""
    rng = np.random.default_rng(3)
    n, many = 9, 400
    a, b = (np.eye(model.k)[rng.integers(0, model.k, (many, n))].transpose(0, 2, 1) for _ in "ab")
    b = np.where((rng.random((many, n)) < rng.random((many, 1)))[:, None, :], a, b)
    b[::2] = model.p(0.02) @ b[::2]
    b[:5] = 1.0  # gaps
    weights, t = rng.integers(1, 5, n).astype(float), np.exp(rng.uniform(np.log(1e-7), np.log(200), many))
    want, _ = newton_many(model, weights, a, b, t)
    s = blocks.sumtable(model, a, b)
    halves = [curves.values(model, s[:, :, i], weights[i]) for i in (slice(0, 4), slice(4, n))]
    got, sure = curves.best(model, sum(halves), t)
    assert sure[5:].all() and got[5:] == pytest.approx(want[5:], rel=1e-5)
    like = lambda x: np.log((np.exp(np.outer(x, model.rates))[:, None, :] @ s)[:, 0]) @ weights
    assert like(got) == pytest.approx(like(want), abs=1e-9)
