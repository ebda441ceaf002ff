"""The SQL of ``plans.portable`` against walks over the same tree, written apart from it."""

from collections import Counter

import numpy as np
import pytest

from arborspark import queries
from arborspark.functions import models
from arborspark.functions.likelihood import Scorer
from arborspark.functions.topology import Tree
from arborspark.operators import likelihood
from arborspark.plans import portable as P

from .conftest import SF_DIR
from .test_kernels import behind, hosts


@pytest.fixture(scope="module")
def n(spark):
    return spark.read.parquet(f"{SF_DIR}/supplier.parquet").count()


@pytest.fixture(scope="module")
def tree(n):
    """Built from the sentence that describes it: leaf s is node n + s, a node's parent its
    half, the root gone."""
    t = Tree(names={n + s: s for s in range(n)})
    for i in range(4, 2 * n):
        t.connect(i, i // 2, 0.05 + i % 7 * 0.03)
    t.connect(2, 3, 0.05 + 2 * 0.03 + 0.05 + 3 * 0.03)
    return t


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: [tuple(r) for r in queries.QUERIES[name](spark, SF_DIR).collect()]


@pytest.mark.parametrize("name", ["tree_distance", "tree_anchor", "tree_anchor_split", "clade_detect", "splits", "choose_split", "edge_window", "edge_window_pairs", "tree_validate", "tree_path_edge"])
def test_no_limit_of_rows_in_a_recursion(spark, compare, name):
    """Spark ends a recursion with an error at a million rows, which 60,000 suppliers exceed;
    here at fifteen."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "15")
    try:
        compare(queries.QUERIES[name], queries.SQL[name])
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def path(t, a, b):
    """Nodes on the way, by trying every way."""
    at = [(a, [a])]
    while at:
        u, way = at.pop()
        if u == b:
            return way
        at += [(v, [*way, v]) for v in t.adj[u] if v not in way]


def test_nodes(rows, tree, n):
    assert Counter(rows("tree_degree")) == Counter((u, len(v)) for u, v in tree.adj.items())
    assert rows("tree_validate") == [(2 * n - 2, 2 * n - 3, 0, 0, 2 * n - 2)]


def test_distances_and_first_edges(rows, tree, n):
    for taxon, hops, dist in rows("tree_distance"):
        way = path(tree, n, n + taxon)
        assert hops == len(way) - 1 and dist == pytest.approx(sum(tree.adj[u][v] for u, v in zip(way, way[1:], strict=False)), abs=1e-6)
    assert len(rows("tree_distance")) == n
    got = rows("tree_path_edge")
    assert len(got) == 2 * n - 3 and all(first == path(tree, 2, to)[1] and start == 2 for start, to, first in got)


def test_anchors_of_removed_leaves(rows, tree, n):
    kept = {s for s in range(n) if s % 3}
    for taxon, size, members in rows("tree_anchor_split"):
        side = frozenset(map(int, members.split(",")))
        assert len(side) == size and side in hosts(tree, taxon, kept) and 2 * size <= len(kept)
    anchors = dict(rows("tree_anchor"))
    assert set(anchors) == {s for s in range(n) if s % 3 == 0}
    for taxon, low in anchors.items():  # the lower node of the edge it hung from, or the root edge's
        assert frozenset(behind(tree, low, low // 2 if low > 3 else 5 - low) & kept) in hosts(tree, taxon, kept)


def test_clades_and_splits(rows, tree, n):
    lost = {s for s in range(n) if s % 3 == 0}
    got = sorted(sorted(map(int, members.split(","))) for _, _, members in rows("clade_detect"))
    assert got == sorted(sorted(c) for c in tree.clades_of(lost))
    two = Tree(names={n + (3 * s + 1) % n: s for s in range(n)}, adj=tree.adj)
    want = {(k, frozenset(side)) for k, t in ((1, tree), (2, two)) for side in (x if 0 not in x else set(range(n)) - x for x in t.splits())}
    found = {(k, frozenset(map(int, m.split(",")))) for k, _, m in rows("splits")}
    assert found == want and all(size == len(m.split(",")) for _, size, m in rows("splits"))
    assert rows("rf_distance")[0][0] == len({s for k, s in want if k == 1} ^ {s for k, s in want if k == 2})
    ((size, members),) = rows("choose_split")
    off = {side: abs(len(side) - n / 2) for k, side in want if k == 1}
    assert off[frozenset(map(int, members.split(",")))] == min(off.values()) and size == len(members.split(","))


def test_windows_and_moves(rows, tree, n):
    def far(u, v):
        return min(len(path(tree, a, b)) - 1 for a in (2, 3) for b in (u, v)) + 1 if (u, v) != (2, 3) else 0

    edges = sorted((far(min(u, v), max(u, v)), min(u, v), max(u, v)) for u, v, _ in tree.edges())[:14]
    got = sorted(rows("edge_window"), key=lambda r: r[3])
    assert [(r[2], r[0], r[1]) for r in got] == edges and [r[3] for r in got] == list(range(1, len(edges) + 1))
    pairs = sorted(rows("edge_window_pairs"), key=lambda r: r[4])
    assert [r[:4] for r in pairs] == [(*a[1:], *b[1:]) for a in edges for b in edges]
    inner = {(min(u, v), max(u, v)) for u, v, _ in tree.edges() if u not in tree.names and v not in tree.names}
    nni = rows("nni_neighbors")
    assert {(u, v) for u, v, _, _ in nni} == inner and len(nni) == 2 * len(inner)
    assert all(a in tree.adj[u] and a != v and b in tree.adj[v] and b != u for u, v, a, b in nni)
    points = {(u, v) for u in tree.adj for v in tree.adj[u] if any(w != v and w not in tree.names for w in tree.adj[u])}
    assert set(rows("spr_prune_points")) == points
    want = {(u, v, x, y) for u, v in points for x in tree.adj for y in tree.adj[x] if _ahead(tree, u, v, x, y)}
    assert {r[:4] for r in rows("spr_candidates")} == want
    moved = tree.copy()
    (a, b) = (x for x in moved.adj[2] if x != 4)
    joined = moved.disconnect(2, a) + moved.disconnect(2, b)
    moved.connect(a, b, joined)
    u, v = (2 * n - 1) // 2, 2 * n - 1
    half = moved.disconnect(u, v) / 2
    moved.connect(2, u, half)
    moved.connect(2, v, half)
    assert {(u, v): bl for u, v, bl in rows("spr_apply")} == {(u, v): pytest.approx(x, abs=1e-6) for u, v, x in moved.edges()}


def _ahead(tree, u, v, x, y):
    """Whether the step from x to y leads away from u, not over v, 1 to 10 edges after the first."""
    way = path(tree, u, y)
    return len(way) >= 3 and way[-2] == x and way[1] != v and len(way) - 2 <= 10


def test_likelihoods(spark, rows):
    pats = queries.patterns(spark, SF_DIR).collect()
    tree = P.heap_tree()
    for msa, n_sites, n_patterns, ll in rows("score_jc"):
        own = [r for r in pats if r["msa_id"] == msa]
        masks = dict(zip(queries.TAXA, np.array([r["masks"] for r in own]).T, strict=True))
        s = Scorer(tree, masks, np.array([r["weight"] for r in own], float), models.jukes_cantor(4))
        assert ll == pytest.approx(s.score(), abs=1e-5) and n_patterns == len(own) and n_sites == sum(r["weight"] for r in own)
    sites = likelihood.score_sites(queries.patterns(spark, SF_DIR), tree, queries.TAXA, models.jukes_cantor(4)).collect()
    assert sorted(round(r[3], 5) for r in rows("site_loglik")) == pytest.approx(sorted(round(r["site_lnl"], 5) for r in sites), abs=2e-5)


@pytest.mark.parametrize("n", [6, 9])
def test_distance_where_places_hold_several_taxa(spark, tmp_path, n):
    """Three divides the number of suppliers, so (3t + 1) mod n takes each of its values three times."""
    import duckdb

    spark.read.parquet(f"{SF_DIR}/supplier.parquet").where(f"s_suppkey < {n}").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.sql(f"select rf, nrf, taxa from ({queries.SQL['rf_distance']})").fetchall()
    assert [tuple(r) for r in queries.QUERIES["rf_distance"](spark, str(tmp_path)).select("rf", "nrf", "taxa").collect()] == want
