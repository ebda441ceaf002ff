"""Trees, likelihoods, optimisers and merges: cases with known results, and fuzzing."""

import random

import numpy as np
import pytest

from arborspark import merge, score
from arborspark.functions import alphabet, merging, models
from arborspark.functions.likelihood import Scorer, joined, tip
from arborspark.functions.optimize import all_branches, commit, five_branches, five_branches_many, prune_and_place
from arborspark.functions.topology import Tree, assemble, rf
from arborspark.operators.merge import Alignment, union
from arborspark.sources.newick import parse, write


def random_tree(names, rng):
    t, nodes, new = Tree(), list(range(len(names))), len(names)
    for i, n in enumerate(names):
        t.names[i], t.adj[i] = n, {}
    while len(nodes) > 3:
        for x in (nodes.pop(rng.randrange(len(nodes))), nodes.pop(rng.randrange(len(nodes)))):
            t.connect(x, new, rng.uniform(0.02, 0.4))
        nodes.append(new)
        new += 1
    for x in nodes:
        t.connect(x, new, rng.uniform(0.02, 0.4))
    return t


def behind(t, v, u):
    """Names on v's side of the edge u-v, by walking there."""
    return ({t.names[v]} if v in t.names else set()).union(*(behind(t, w, v) for w in t.adj[v] if w != u))


def lengths_by_side(t, kept):
    """Length of what divides the kept names alike, by the side without the smallest one."""
    out, least = {}, min(kept)
    for u, v, bl in t.edges():
        side = frozenset(behind(t, v, u) & kept)
        side = side if least not in side else frozenset(kept - side)
        if side:
            out[side] = out.get(side, 0) + bl
    return out


def hosts(t, name, kept):
    """The sides of kept names at the place where a removed leaf hung."""
    at, came = t.leaf(name), None
    while True:
        ways = [w for w in t.adj[at] if w != came and behind(t, w, at) & kept]
        if len(ways) == 2:
            return [frozenset(behind(t, w, at) & kept) for w in ways]
        (came, at) = (at, ways[0])


def anchors_are_hosts(t, gone, pruned, anchors):
    kept = set(t.names.values()) - set(gone)
    for name in gone:
        u, v = anchors[name]
        assert {frozenset(behind(pruned, v, u)), frozenset(behind(pruned, u, v))} == set(hosts(t, name, kept))


@pytest.mark.parametrize("seed", range(12))
def test_prune_keeps_lengths_and_anchors(seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(rng.randrange(5, 24))]
    t = random_tree(names, rng)
    gone = rng.sample(names, rng.randrange(1, len(names) - 2))
    kept = set(names) - set(gone)
    want = lengths_by_side(t, kept)
    pruned, anchors = t.copy().prune(gone)
    assert not pruned.problems() and len(pruned.edges()) == 2 * len(kept) - 3
    got = lengths_by_side(pruned, kept)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    anchors_are_hosts(t, gone, pruned, anchors)


@pytest.mark.parametrize("clade", [{"n1"}, {"n3", "n4"}, {"m2", "m3", "m4"}])
def test_detach_and_regraft(clade):
    t = parse("((m1:0.21,(m2:0.13,(m3:0.17,m4:0.19):0.23):0.29):0.31,n1:0.37,(n2:0.41,(n3:0.43,n4:0.47):0.53):0.59);")
    before = write(t)
    part = t.detach(clade)
    assert not clade & set(t.leaves())
    t.regraft(part)
    assert write(t) == before and not t.problems()


UNEVEN = "(z1:0.2,z2:0.3,(z3:0.25,((z4:0.1,z5:0.15):0.35,((z6:0.4,z7:0.12):0.22,(z8:0.18,z9:0.28):0.32):0.14):0.24):0.16);"


def test_windows():
    t = parse(UNEVEN)
    u, v, _ = t.edges()[4]
    assert len(t.window(u, v, 99)) == 15
    assert {frozenset(e) for e in t.window(u, v, 5)} <= {frozenset(e) for e in t.window(u, v, 14)}
    assert len(t.window(u, v, 5)) == 5


@pytest.mark.parametrize("bad", ["", "(a,b);", "((a,b),(c,d)", "(a,b,a);", "((a,b,c),d,e);", "(a:x,b,c);"])
def test_bad_newick(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_newick_forms():
    assert len(parse("((a,b)90:0.1,(c,d)x:0.2);").edges()) == 5  # a rooted tree loses its root
    assert parse("(a,'b c',d);").leaves() == ["a", "b c", "d"]
    assert parse(write(parse(UNEVEN))).splits() == parse(UNEVEN).splits()
    with pytest.raises(ValueError, match="Unknown taxon"):
        parse("(a,b,c);", taxa=["a", "b"])


def test_moves():
    t = parse(UNEVEN)
    assert all(not t.nni(u, v, k).problems() and rf(t, t.nni(u, v, k))[0] == 2 for u, v, _ in t.edges() if not t.is_leaf(u) and not t.is_leaf(v) for k in (0, 1))
    for u, v in t.spr_points()[:4]:
        for x, y, d in t.spr_targets(u, v, 3):
            moved = t.spr(u, v, x, y)
            assert not moved.problems() and moved.leaves() == t.leaves() and d >= 1
    again = assemble(t.edges(), t.names)
    assert again.splits() == t.splits() and [again.names[i] for i in range(9)] == t.leaves()


def test_models():
    for m in (models.jtt(), models.jukes_cantor(4), models.jukes_cantor(20), models.gtr([1, 2, 3, 4, 5, 6], [0.1, 0.2, 0.3, 0.4])):
        assert np.allclose(m.p(0.2) @ m.p(0.3), m.p(0.5)) and np.allclose(m.p(0.7).sum(1), 1)
        assert np.allclose(m.pi @ m.p(1.0), m.pi)
        one, two = m.derivatives(0.4)
        assert np.allclose(one, (m.p(0.4 + 1e-6) - m.p(0.4 - 1e-6)) / 2e-6, atol=1e-6)
        assert np.allclose(two, (m.derivatives(0.4 + 1e-6)[0] - m.derivatives(0.4 - 1e-6)[0]) / 2e-6, atol=1e-5)
    for k in (4, 20):
        t = 0.37
        same = (1 + (k - 1) * np.exp(-k * t / (k - 1))) / k
        assert np.allclose(np.diag(models.jukes_cantor(k).p(t)), same)
    with pytest.raises(ValueError):
        models.build("JTT", "DNA")
    with pytest.raises(ValueError):
        models.build("nope", "DNA")


def naive(t, masks, weights, m):
    """Likelihood by recursion from every possible root pattern by pattern."""
    out = 0.0
    leaf = t.leaf(min(t.names.values()))
    (root,) = t.adj[leaf]

    def down(u, p, i):
        if u in t.names:
            s = [(masks[t.names[u]][i] >> k) & 1 for k in range(m.k)]
            return np.array(s if any(s) else [1] * m.k, float)
        x = np.ones(m.k)
        for v in t.adj[u]:
            if v != p:
                x = x * (m.p(t.adj[u][v]) @ down(v, u, i))
        return x

    for i, w in enumerate(weights):
        out += w * np.log(m.pi @ down(root, None, i))
    return out


def test_likelihood_identities():
    rng = random.Random(3)
    names = [f"t{i}" for i in range(9)]
    t, m = random_tree(names, rng), models.gtr([1, 2, 3, 4, 5, 6], [0.1, 0.2, 0.3, 0.4])
    masks = {n: np.array([rng.randrange(1, 32) for _ in range(20)]) for n in names}
    w = np.array([rng.randrange(1, 4) for _ in range(20)])
    ll = Scorer(t, masks, w, m).score()
    assert ll == pytest.approx(naive(t, masks, w, m), abs=1e-9)
    for u, v, _ in t.edges():  # any edge can be the root
        s = Scorer(t, masks, w, m)
        from arborspark.functions.likelihood import across

        assert across(m, s.weights, s.message(u, v), s.message(v, u), t.adj[u][v]) == pytest.approx(ll, abs=1e-9)
    gap = {**masks, "t4": np.full(20, 31)}
    assert Scorer(t, gap, w, m).score() == pytest.approx(Scorer(t.prune(["t4"])[0], masks, w, m).score(), abs=1e-9)
    everywhere = {n: np.append(x, 31) for n, x in masks.items()}
    assert Scorer(t, everywhere, np.append(w, 5), m).score() == pytest.approx(ll, abs=1e-9)


def test_no_underflow_on_large_trees():
    rng = random.Random(5)
    names = [f"t{i:04d}" for i in range(1200)]
    t, m = random_tree(names, rng), models.jukes_cantor(20)
    masks = {n: np.array([1 << rng.randrange(20) for _ in range(3)]) for n in names}
    assert np.isfinite(Scorer(t, masks, np.ones(3), m).score()) and Scorer(t, masks, np.ones(3), m).score() > -3 * 1200 * 6


def test_optimisers():
    rng = random.Random(11)
    names = [f"t{i}" for i in range(8)]
    t, m = random_tree(names, rng), models.jukes_cantor(4)
    masks = {n: np.array([1 << rng.randrange(4) for _ in range(50)]) for n in names}
    w = np.ones(50)
    before = Scorer(t, masks, w, m).score()
    got = {}
    for mode in ("fast", "thorough", "fixed", "triplet", "lbfgsb"):
        s = Scorer(t.copy(), masks, w, m)
        got[mode] = all_branches(s, mode)
        assert got[mode] >= before and got[mode] == pytest.approx(Scorer(s.tree, masks, w, m).score(), abs=1e-8)
    assert got["thorough"] == got["lbfgsb"] and got["thorough"] >= got["fast"] - 1e-6
    with pytest.raises(ValueError):
        all_branches(Scorer(t.copy(), masks, w, m), "quick")


def test_five_branches_score_as_reported():
    rng = random.Random(2)
    m, w = models.jtt(), np.ones(40)
    tips = [tip(np.array([1 << rng.randrange(20) for _ in range(40)]), 20) for _ in range(4)]
    ll, t = five_branches(m, w, tips[:2], tips[2:], [0.1, 0.05, 0.05, 0.05, 0.05], eps=1e-6)
    u, v = joined(m, (tips[0], t[1]), (tips[1], t[2])), joined(m, (tips[2], t[3]), (tips[3], t[4]))
    from arborspark.functions.likelihood import across

    assert across(m, w, u, v, t[0]) == pytest.approx(ll, abs=1e-9)


def test_batches_of_pairs_agree_with_single_ones():
    rng = random.Random(6)
    for m in (models.jtt(), models.jukes_cantor(4)):
        w = np.array([rng.randrange(1, 4) for _ in range(25)], float)
        ends = [[tip(np.array([1 << rng.randrange(m.k) for _ in range(25)]), m.k) for _ in range(4)] for _ in range(9)]
        start = np.array([[0.1, *[rng.uniform(0.01, 1) for _ in range(4)]] for _ in range(9)])
        for eps in (1000.0, 1e-3):
            stacked = [tuple(np.stack([e[i][part] for e in ends]) for part in (0, 1)) for i in range(4)]
            ll, t = five_branches_many(m, w, stacked, start, eps=eps)
            for k, e in enumerate(ends):
                one, own = five_branches(m, w, e[:2], e[2:], start[k], eps=eps)
                assert ll[k] == pytest.approx(one, abs=1e-8) and np.allclose(t[k], own, atol=1e-6)


def test_timing_checks_for_drift():
    from arborspark.functions import timing

    t, m = parse(UNEVEN), models.jukes_cantor(4)
    masks = {n: np.array([1, 2, 4]) for n in t.leaves()}
    got = timing.evaluate(lambda: Scorer(t, masks, np.ones(3), m), 1, 3)
    assert 0 < got["best_us"] <= got["mean_us"] and got["cold_ms"] > 0


def test_moves_score_as_the_moved_tree():
    rng = random.Random(8)
    names = [f"t{i}" for i in range(9)]
    t, m = random_tree(names, rng), models.jukes_cantor(4)
    masks = {n: np.array([1 << rng.randrange(4) for _ in range(30)]) for n in names}
    new = lambda x: Scorer(x, masks, np.ones(30), m)
    for u, v in t.spr_points():
        plain = prune_and_place(t, new, u, v)
        for ll, x, y, _, _ in plain:
            assert ll == pytest.approx(new(t.spr(u, v, x, y)).score(), abs=1e-8)
        best = {(x, y): ll for ll, x, y, _, _ in plain}
        for ll, x, y, d, lengths in prune_and_place(t, new, u, v, thorough=True):
            if d > 1:
                assert new(commit(t, u, v, x, y, lengths)).score() == pytest.approx(ll, abs=1e-8)
        assert all(ll >= best[(x, y)] - 1e-6 for ll, x, y, _, _ in prune_and_place(t, new, u, v, thorough=True, eps=0.01))


@pytest.mark.parametrize("seed", range(12))
def test_merge_fuzz(seed):
    rng = random.Random(seed)
    n = rng.randint(8, 26)
    names = [f"t{i:02d}" for i in range(n)]
    t = random_tree(names, rng)
    side = set(min(sorted((s for s in t.splits() if 2 <= len(s) <= n - 2), key=sorted), key=lambda s: abs(len(s) - n / 2)))
    rest = set(names) - side
    inherited = [set(rng.sample(sorted(x), max(0, min(len(x) - 3, rng.randint(0, 3))))) for x in (side, rest)]
    real = [side - inherited[0], rest - inherited[1]]
    if min(map(len, real)) < 3:
        pytest.skip("too few real taxa")
    interest = [rng.choice(sorted(real[1])), rng.choice(sorted(real[0]))]
    sub = [t.prune(set(names) - (x | {o}))[0] for x, o in zip((side, rest), interest, strict=True)]
    seqs = {x: "".join(rng.choice("ACGT") for _ in range(60)) for x in names}
    args = (write(sub[0]), write(sub[1]), *interest)
    groups = [[[x] for x in sorted(i)] for i in inherited]
    got = merge(*args, msa=seqs, inherited_a=groups[0], inherited_b=groups[1], model="JC")
    out = parse(got.newick)
    assert out.leaves() == names and not out.problems()
    for s, o in zip(sub, interest, strict=True):
        assert rf(out, s.prune([o])[0])[0] == 0
    core = out.prune(inherited[0] | inherited[1])[0] if inherited[0] | inherited[1] else out
    assert score(write(core), seqs, "JC") == pytest.approx(got.loglik, abs=1e-6)
    shuffled = dict(sorted(seqs.items(), key=lambda _: rng.random()))
    again = merge(*args, msa=shuffled, inherited_a=groups[0][::-1], inherited_b=groups[1][::-1], model="JC")
    assert parse(again.newick).splits() == out.splits() and again.loglik == pytest.approx(got.loglik, abs=1e-9)


def test_merge_full_optimisation_scores_the_whole_tree():
    rng = random.Random(4)
    a, b = "(((s8:.25,s0:.15):.12,(s1:.3,s2:.22):.17):.08,s3:.11,s4:.45);", "(((s5:.14,s6:.26):.19,(s9:.33,s7:.21):.13):.09,s4:.16,s0:.38);"
    seqs = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(80)) for i in range(10)}
    off = merge(a, b, "s4", "s0", msa=seqs, inherited_a=[["s8"]], inherited_b=[["s9"]], model="JC")
    for mode in ("fast", "thorough"):
        got = merge(a, b, "s4", "s0", msa_a={k: seqs[k] for k in list(seqs)[:6]}, msa_b=seqs, inherited_a=[["s8"]], inherited_b=[["s9"]], model="JC", full_blo=mode)
        assert got.loglik == pytest.approx(score(got.newick, seqs, "JC"), abs=1e-6)
        assert got.loglik >= score(off.newick, seqs, "JC") and "MergeResult" in repr(got)


def test_chained_clades_keep_their_order():
    a = "((((m:.12,g1:.22):.32,(g2:.14,g3:.24):.34):.11,n:.21):.31,(p:.13,q:.23):.33,X:.41);"
    b = "(X:.15,(Y:.25,Z:.35):.18,(W:.28,p:.38):.16);"
    rng = random.Random(1)
    seqs = {x: "".join(rng.choice("ACGT") for _ in range(40)) for x in "m n p q g1 g2 g3 W X Y Z".split()}
    out = parse(merge(a, b, "X", "p", msa=seqs, inherited_a=[["g1"], ["g2", "g3"]], model="JC").newick)
    splits = {frozenset(s) for s in out.splits()} | {frozenset(set(out.leaves()) - s) for s in out.splits()}
    assert frozenset({"m", "g1"}) in splits and frozenset({"m", "g1", "g2", "g3"}) in splits and frozenset({"m", "g2", "g3"}) not in splits


def test_newton_finds_the_optimum_and_the_bounds():
    """Two sequences that differ in a share p of sites are -3/4 ln(1 - 4p/3) apart."""
    from arborspark.functions.optimize import LEAST, MOST, newton

    m = models.jukes_cantor(4)
    for differ, want in ((0, LEAST), (13, -0.75 * np.log(1 - 4 * 0.13 / 3)), (60, -0.75 * np.log(1 - 0.8)), (90, MOST)):
        a, b = np.ones(100, int), np.array([2] * differ + [1] * (100 - differ))
        for start in (1e-6, 0.1, 5.0, 100.0):
            t, fine = newton(m, np.ones(100), tip(a, 4), tip(b, 4), start)
            assert fine and t == pytest.approx(want, abs=1e-5) or (want == MOST and t > 10)


def test_adjacency_lists_every_node():
    lines = parse("(a:1,b:2,c:0.5);").adjacency().split("\n")
    assert len(lines) == 4 and sum("[" in x for x in lines) == 3 and any(x.count("(") == 3 for x in lines)


def side(name, guest):
    """Five leaves and the other side's guest, in a shape that the name decides."""
    return write(random_tree([*(f"{name}{i}" for i in range(5)), guest], random.Random(f"{name}{guest}")))


@pytest.mark.parametrize(
    "change, error",
    [
        ({"interest_a": ""}, "interest"), ({"interest_a": "zz"}, "not a leaf"), ({"full_blo": "slow"}, "full_blo"), ({"model": "XX"}, "unknown model"),
        ({"inherited_a": [["a0", "a1", "a2"]]}, "fewer than 3"), ({"newick_b": side("b", "P").replace("b2", "a1")}, "both sides"),
        ({"msa": None}, "provide either"), ({"msa": {"a0": "AC", "a1": "A", "a2": "AC"}}, "unequal"), ({"model": "JTT"}, "amino-acid"),
    ],
)
def test_merge_errors(change, error):
    seqs = {f"{x}{i}": "ACGTAC" for x in "ab" for i in range(5)}
    args = dict(newick_a=side("a", "O"), newick_b=side("b", "P"), interest_a="O", interest_b="P", msa=seqs, model="JC")
    with pytest.raises(ValueError, match=error):
        merge(**{**args, **change})


def test_alignments(tmp_path):
    seqs = {"a": "ACGTN-", "b": "ACGTRR", "c": "AAGTX?"}
    p = tmp_path / "x.fas"
    p.write_text("".join(f">{t} more words\r\n{s[:3]} {s[3:]}\r\n" for t, s in seqs.items()))
    x, y = Alignment.of(seqs), Alignment.of(str(p))
    assert x.seq_type == "AA" and alphabet.detect(["ACGU"]) == "DNA"
    assert all((x.masks[t] == y.masks[t]).all() for t in seqs) and (x.weights == y.weights).all()
    assert alphabet.encode("acgtun-", "DNA").tolist() == [1, 2, 4, 8, 8, 15, 31]
    with pytest.raises(ValueError, match="conflicting"):
        union({"a": "AC"}, {"a": "AG"})
    assert Alignment.of({"a": "AAC", "b": "AAC", "c": "AAG"}, "DNA").weights.tolist() == [2, 1]


def test_side_of_one_outgroup_only():
    s = merging.prepare(side("a", "O"), "O", [])
    assert s.core.leaves() == [f"a{i}" for i in range(5)] and not s.clades and s.reference == "a0"


def test_outgroup_candidates():
    from arborspark.functions.generate import random_alignment, random_tree as grown
    from arborspark.functions.outgroups import candidate_edges, find_anchor_edges, prune_and_record

    names = [f"n{i}" for i in range(9)]
    whole_tree = random_tree(names, random.Random(8))
    kept = set(names) - {"n2", "n6"}
    clean, splits = prune_and_record(write(whole_tree), ["n2", "n6", "unknown"])
    assert parse(clean).leaves() == sorted(kept) and splits.keys() == {"n2", "n6"}
    for name, split in splits.items():
        assert frozenset(split) in hosts(whole_tree, name, kept)
    whole, _ = prune_and_record(write(whole_tree), ["n2"], keep_outgroups=True)
    assert len(parse(whole).names) == 9
    tree = parse(clean)
    (at,) = find_anchor_edges(tree, splits["n2"], tree.leaves())
    got = candidate_edges(tree, [at], 5)
    assert got[0] == at and len(got) == 5 and len(candidate_edges(tree, [at], 99)) == 2 * len(kept) - 3
    t = grown([f"t{i}" for i in range(20)], 1)
    assert not t.problems() and len(t.edges()) == 37 and t.edges() == grown([f"t{i}" for i in range(20)], 1).edges()
    assert len(random_alignment(["a", "b"], 9, 1)["a"]) == 9


def test_tall_trees_take_memory_by_their_leaves():
    """Sides of splits, listed, would be millions of members here."""
    import tracemalloc

    n = 3000
    ladder = "(" * (n - 2) + "t0000:0.1,t0001:0.1)" + "".join(f":0.1,t{i:04d}:0.2)" for i in range(2, n - 1))
    tree = parse(ladder[:-1] + f",t{n - 1}:0.3);")
    tracemalloc.start()
    assert rf(tree, parse(write(tree))) == (0, 0.0, n)
    assert sorted(tree.split_sizes()) == sorted(min(k, n - k) for k in range(2, n - 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e7


@pytest.mark.parametrize("seed", range(6))
def test_distance_and_sizes_against_listed_splits(seed):
    rng = random.Random(seed)
    names = [f"t{i:02d}" for i in range(12)]
    a, b = random_tree(names, rng), random_tree([*rng.sample(names, 9), "x", "y"], rng)
    for u, v in [(u, v) for u, v, _ in a.edges() if u not in a.names and v not in a.names][: seed % 2]:
        for w in a.others(v, u):  # an inner node with more branches
            a.connect(u, w, a.disconnect(v, w))
        a.disconnect(u, v)
        del a.adj[v]
    taxa = set(a.names.values()) & set(b.names.values())
    assert rf(a, b) == rf(b, a) == (len(a.splits(taxa) ^ b.splits(taxa)), len(a.splits(taxa) ^ b.splits(taxa)) / (2 * (9 - 3)), 9)
    assert sorted(b.split_sizes()) == sorted(min(len(s), 11 - len(s)) for s in b.splits())
