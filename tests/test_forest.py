"""Tables of trees against the kernels' walks."""

import random

import pytest
from pyspark.sql import functions as F

from arborspark.functions.topology import rf
from arborspark.operators import forest

from .test_blocks import caterpillar, table
from .test_kernels import behind, lengths_by_side, random_tree


def edges_by_side(rows, names, kept):
    """Length of each split of a pruned edge table, by the side without the smallest name."""
    from arborspark.functions.topology import Tree

    t = Tree(names={u: n for u, n in names.items() if n in kept})
    for r in rows:
        t.connect(r["u"], r["v"], r["bl"])
    assert len(rows) == 2 * len(kept) - 3 and not t.problems()
    return lengths_by_side(t, kept)


@pytest.mark.parametrize("seed", range(4))
def test_pruned(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i:02d}" for i in range(14)]
    tree = random_tree(names, rng)
    gone = rng.sample(names, (1, 4, 8, 10)[seed])
    kept = set(names) - set(gone)
    rows = forest.pruned(table(spark, tree), ~F.col("taxon").isin(gone)).collect()
    got, want = edges_by_side(rows, tree.names, kept), lengths_by_side(tree, kept)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_ladder_of_many_leaves(spark):
    n = 3000
    d = table(spark, caterpillar(n))
    spark.sparkContext.setJobGroup("ladder", "ladder")
    out = forest.pruned(d, F.substring("taxon", 2, 9).cast("int") % 3 != 0).agg(F.count(F.lit(1)), F.round(F.sum("bl"), 6)).first()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ladder"))
    spark.sparkContext.setJobGroup("", "")
    assert out[0] == 2 * (n * 2 // 3) - 3 and jobs < 400
    few = forest.pruned(d, F.col("taxon").isin("t0", "t1500", "t2999")).collect()
    assert len(few) == 3 and sum(r["bl"] for r in few) == pytest.approx(0.2 + 0.1 + 0.3 + 2997 * 0.05)


def test_sums_below(spark):
    tree = random_tree([f"t{i}" for i in range(20)], random.Random(9))
    d = table(spark, tree)
    root = d.where("parent is null").first()["node"]
    parent = {r["node"]: r["parent"] for r in d.collect()}
    got = forest.below(d.withColumn("one", F.when(F.col("taxon").isNotNull(), 1).otherwise(0).cast("long")), ["one"]).collect()
    assert {r["node"]: r["one"] for r in got} == {u: 20 if u == root else len(behind(tree, u, parent[u])) for u in tree.adj}


def test_distances_of_many_trees(spark):
    rng, names = random.Random(2), [f"t{i}" for i in range(11)]
    trees = {i: random_tree(names, rng) for i in range(5)} | {5: random_tree(names, random.Random(2))}
    d = None
    for i, t in trees.items():
        one = table(spark, t).withColumn("tree", F.lit(i))
        d = one if d is None else d.unionByName(one)
    got = {r["tree"]: r["rf"] for r in forest.rf(d, F.col("tree") == 0).collect()}
    assert got == {i: rf(t, trees[0])[0] for i, t in trees.items()} and got[0] == got[5] == 0
    sizes = sorted(r["size"] for r in forest.splits(d.where("tree = 1").drop("tree")).collect())
    assert sizes == sorted(min(len(x), 11 - len(x)) for x in map(set, trees[1].splits()))
    tiny = d.where("tree = 0").where("false").unionByName(table(spark, random_tree(["a", "b", "c"], rng)).withColumn("tree", F.lit(0)))
    assert [(r["tree"], r["rf"]) for r in forest.rf(tiny, F.col("tree") == 0).collect()] == [(0, 0)]


@pytest.mark.parametrize("shape", ["random", "ladder"])
def test_windows_of_many_anchors(spark, shape):
    tree = random_tree([f"t{i}" for i in range(25)], random.Random(6)) if shape == "random" else caterpillar(25)
    edges = spark.createDataFrame([(u, v) for u, v, _ in tree.edges()], "u long, v long")
    anchors = [(i, u, v) for i, (u, v, _) in enumerate(tree.edges())] + [(99, *tree.edges()[0][:2]), (99, *tree.edges()[-1][:2])]
    got = {}
    for r in forest.windows(edges, spark.createDataFrame(anchors, "job long, u long, v long"), ["job"], 14).collect():
        got.setdefault(r["job"], []).append(r)

    def far(seeds):
        depth, at = {}, [(u, v, 0) for u, v in seeds] + [(v, u, 0) for u, v in seeds]
        while at:
            u, v, k = at.pop(0)
            if depth.get(frozenset((u, v)), k) >= k:
                depth[frozenset((u, v))] = k
                at += [(v, w, k + 1) for w in tree.adj[v] if w != u and depth.get(frozenset((v, w)), k + 2) > k + 1]
        return depth

    for job in {a[0] for a in anchors}:
        depth = far([a[1:] for a in anchors if a[0] == job])
        want = sorted((k, *sorted(e)) for e, k in depth.items())[:14]
        assert [(r["depth"], r["u"], r["v"]) for r in sorted(got[job], key=lambda r: r["place"])] == want


def test_divided(spark):
    tree = random_tree([f"t{i:02d}" for i in range(21)], random.Random(12))
    nodes = table(spark, tree)
    got = forest.divided(nodes, 0.3, 0.4, 5).collect()
    a = {r["taxon"] for r in got if r["side"] == "A"}
    sides = [s if s in tree.splits() else frozenset(set(tree.names.values()) - s) for s in [frozenset(a)]]
    assert len(got) == 21 and sides[0] in tree.splits()
    assert sum(r["inherited"] for r in got) == 6 and all(sum(not r["inherited"] for r in got if r["side"] == s) >= 2 for s in "AB")
    assert got == forest.divided(nodes, 0.3, 0.4, 5).collect() and got != forest.divided(nodes, 0.3, 0.4, 6).collect()
    with pytest.raises(ValueError, match="four"):
        forest.divided(table(spark, random_tree(["a", "b", "c"], random.Random(1))))
