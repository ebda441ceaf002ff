"""Tables of trees, many or large: sums, splits, distances, pruning and neighbourhoods.

A tree is a table of nodes (node, parent, bl, taxon), or with further key columns (``by``) a
table of trees. What runs along paths is done by pointer doubling: every node holds what
it knows of a stretch of its path and a pointer to where the stretch ends, and each
round joins the two stretches that meet there. So the number of rounds is the logarithm of
the height, a ladder of 10^5 leaves included, and a round moves one row a node, not one
for each node above it.

A split is known by 128 bits: the exclusive or of the hashes of the taxa on one side, the
smaller of both sides' values. Sides of equal hash are taken for equal; no list of
members is ever made.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.storage import once, small

from .corpus import placed

HASHES = ("h1", "h2")


def below(nodes: DataFrame, sums: Sequence[str] = (), xors: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by, node, columns): the sums (or exclusive ors) of columns over each node and all
    nodes below it. After round i a node holds those less than 2^i below it; the holders
    exactly 2^i below hand on theirs."""
    columns = [*sums, *xors]
    gather = lambda c: (F.sum(c) if c in sums else F.bit_xor(c)).alias(f"_{c}")
    joined = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))) if c in sums else F.col(c).bitwiseXOR(F.coalesce(F.col(f"_{c}"), F.lit(0)))
    d = once(nodes.select(*by, "node", F.col("parent").alias("up"), *columns))
    while not (open_ := d.where("up is not null")).isEmpty():
        gain = open_.groupBy(*by, F.col("up").alias("node")).agg(*map(gather, columns))
        further = open_.select(*by, "node", "up").join(d.select(*by, F.col("node").alias("up"), F.col("up").alias("up2")), [*by, "up"]).select(*by, "node", "up2")
        d = d.select(*by, "node", *columns).join(gain, [*by, "node"], "left").join(further, [*by, "node"], "left")
        d = once(d.select(*by, "node", F.col("up2").alias("up"), *[joined(c).alias(c) for c in columns]))
    return d.select(*by, "node", *columns)


def along(nodes: DataFrame, values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """nodes plus, for each of ``values`` (name -> column of nodes), its sum over the node and
    all nodes above it: each round adds what lies above a node's pointer and moves the
    pointer as far again."""
    names = list(values)
    d = once(nodes.select(*by, "node", F.col("parent").alias("up"), *[c.alias(n) for n, c in values.items()]))
    while not (open_ := d.where("up is not null")).isEmpty():
        above = d.select(*by, F.col("node").alias("up"), F.col("up").alias("up2"), *[F.col(n).alias(f"_{n}") for n in names])
        # nodes that are done take no part in the join
        moved = open_.join(above, [*by, "up"]).select(*by, "node", F.col("up2").alias("up"), *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names])
        d = once(moved.unionByName(d.where("up is null")))
    return nodes.join(d.select(*by, "node", *names), [*by, "node"])


def hashed(taxon: Column) -> list[Column]:
    """Two hashes of a leaf's name; null for inner nodes hashes to 0."""
    return [F.when(taxon.isNotNull(), F.xxhash64(taxon, F.lit(i))).otherwise(F.lit(0)).cast("long").alias(h) for i, h in enumerate(HASHES)]


def splits(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, c1, c2, size): every split with two taxa or more on both sides, once; size is
    the smaller side's. Nodes of degree two make no second one."""
    own = nodes.select(*by, "node", "parent", F.when(F.col("taxon").isNotNull(), 1).otherwise(0).cast("long").alias("n"), *hashed(F.col("taxon")))
    d = below(own, ["n"], HASHES, by)
    roots = nodes.where("parent is null").select(*by, "node")
    whole = d.join(roots, [*by, "node"]).select(*by, F.col("n").alias("all"), F.col("h1").alias("t1"), F.col("h2").alias("t2"))
    d = d.join(small(once(whole)), list(by)) if by else d.crossJoin(F.broadcast(whole))  # one row a tree
    o1, o2 = (F.col(h).bitwiseXOR(F.col(t)) for h, t in zip(HASHES, ("t1", "t2"), strict=True))
    mine = (F.col("h1") < o1) | ((F.col("h1") == o1) & (F.col("h2") <= o2))
    d = d.where((F.col("n") >= 2) & (F.col("all") - F.col("n") >= 2))
    return d.select(*by, F.when(mine, F.col("h1")).otherwise(o1).alias("c1"), F.when(mine, F.col("h2")).otherwise(o2).alias("c2"), F.least("n", F.col("all") - F.col("n")).alias("size")).distinct()


def rf(nodes: DataFrame, reference: Column, by: str = "tree") -> DataFrame:
    """(tree, n_splits, n_common, rf): each tree's distance to the one that ``reference`` (a
    condition on ``by``) picks; all trees have the same taxa."""
    s = once(splits(nodes, [by]))
    known = s.where(reference).select("c1", "c2", F.lit(1).alias("hit"))
    n = known.agg(F.count(F.lit(1)).alias("n_reference"))
    d = s.join(known, ["c1", "c2"], "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_splits"), F.count("hit").alias("n_common"))
    every = nodes.select(by).distinct().join(d, by, "left").na.fill(0, ["n_splits", "n_common"])  # a tree may have no split
    return every.crossJoin(F.broadcast(n)).select(by, "n_splits", "n_common", (F.col("n_splits") + F.col("n_reference") - 2 * F.col("n_common")).alias("rf"))


def divided(nodes: DataFrame, fa: float = 0.45, fb: float = 0.45, seed: int = 0) -> DataFrame:
    """(taxon, side, inherited) of one tree: the edge that divides the taxa nearest to fa : fb
    (the first by its node) makes sides A, below it, and B; of each side a seeded draw is
    inherited, as many as its share of the rest, leaving two real taxa or more.

    The draw ranks taxa by a digest in a range partitioning, so no task holds a side.
    """
    counts = below(nodes.select("node", "parent", F.when(F.col("taxon").isNotNull(), 1).otherwise(0).cast("long").alias("n")), ["n"])
    n = counts.agg(F.max("n")).first()[0]
    if n is None or n < 4:
        raise ValueError("a tree of four taxa or more is needed")
    want = fa / (fa + fb) * n
    best, na = counts.where(F.col("n").between(2, n - 2)).agg(F.min_by(F.struct("node", "n"), F.struct(F.abs(F.col("n") - want), "node")).alias("b")).select("b.*").first()
    out = max(0, round((1 - fa - fb) * n))
    share = int(out * na / n + 0.5)
    first, second = min(share, max(na - 2, 0)), min(out - share, max(n - na - 2, 0))
    leaves = along(nodes, {"inside": (F.col("node") == best).cast("long")}).where("taxon is not null")
    sided = leaves.select("taxon", F.when(F.col("inside") > 0, "A").otherwise("B").alias("side"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("taxon").cast("string"))).alias("draw"))
    # side A's places come first
    place = F.col("place") - F.when(F.col("side") == "A", 0).otherwise(na)
    return placed(sided, [F.col("side"), F.col("draw"), F.col("taxon")]).select("taxon", "side", (place < F.when(F.col("side") == "A", first).otherwise(second)).alias("inherited"))


def pruned(nodes: DataFrame, keep: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, u, v, bl): the edges of the trees without the leaves for which ``keep`` fails (a
    condition on nodes' columns). Nodes left with one way down go, and lengths along
    them add up; a top with two ways down is no node but a place on their edge."""
    kept = F.when(F.col("taxon").isNotNull() & F.coalesce(keep, F.lit(False)), 1).otherwise(0).cast("long")
    counts = below(nodes.select(*by, "node", "parent", kept.alias("k")), ["k"], by=by).where("k > 0")
    d = once(counts.join(nodes, [*by, "node"]).select(*by, "node", "parent", F.coalesce("bl", F.lit(0.0)).alias("bl"), "taxon"))
    ways = d.where("parent is not null").groupBy(*by, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("ways"))
    d = once(d.join(ways, [*by, "node"], "left").select(*by, "node", F.col("parent").alias("up"), "bl", (F.col("taxon").isNotNull() | (F.coalesce("ways", F.lit(0)) >= 2)).alias("stays")))
    # pointers pass nodes that go, until they rest on one that stays or leave the tree
    passing = d.where("not stays").select(*by, F.col("node").alias("up"))
    while not passing.isEmpty():
        over = d.where("not stays").select(*by, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("bl").alias("more"))
        reached = d.where("up is not null").join(over, [*by, "up"], "left")
        moved = reached.select(*by, "node", F.when(F.col("more").isNull(), F.col("up")).otherwise(F.col("up2")).alias("up"), (F.col("bl") + F.coalesce("more", F.lit(0.0))).alias("bl"), "stays")
        d = once(moved.unionByName(d.where("up is null")))
        passing = d.where("up is not null").select(*by, "up").join(d.where("not stays").select(*by, F.col("node").alias("up")), [*by, "up"], "left_semi")
    edges = once(d.where("stays and up is not null").select(*by, F.col("up").alias("u"), F.col("node").alias("v"), "bl"))
    tops = edges.join(d.where("stays and up is null").select(*by, F.col("node").alias("u")), [*by, "u"])
    two = tops.groupBy(*by, "u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("bl").alias("bl"), F.count(F.lit(1)).alias("n")).where("n = 2")
    plain = edges.join(two.select(*by, "u"), [*by, "u"], "left_anti")
    return plain.select(*by, "u", "v", "bl").unionByName(two.select(*by, F.col("a").alias("u"), F.col("b").alias("v"), "bl"))


def directed(edges: DataFrame) -> DataFrame:
    """(u, v) both ways."""
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def frontier(ways: DataFrame, seeds: DataFrame, by: Sequence[str], radius: int, enough: int | None = None) -> DataFrame:
    """(by, near, far, depth): the edges that walks from the seeds pass, up to ``radius``
    edges away. ways: (u, v) both ways; seeds: (by, near, far), depth 0, walk on from far.

    One join a step, for all seeds together. With ``enough``, a key stops once it has passed
    that many edges; its last step is whole."""
    at = once(seeds.select(*by, "near", "far", F.lit(0).cast("long").alias("depth")))
    steps = [at]
    for _ in range(radius):
        if enough is not None:
            every = steps[0]
            for s in steps[1:]:
                every = every.unionByName(s)
            full = every.groupBy(*by).agg(F.count_distinct(F.least("near", "far"), F.greatest("near", "far")).alias("n")).where(F.col("n") >= enough)
            at = at.join(full.select(*by), list(by), "left_anti")
        at = once(at.join(ways, F.col("far") == F.col("u")).where("v <> near").select(*by, F.col("far").alias("near"), F.col("v").alias("far"), (F.col("depth") + 1).alias("depth")))
        if at.isEmpty():
            break
        steps.append(at)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def windows(edges: DataFrame, anchors: DataFrame, by: Sequence[str], n: int = 14) -> DataFrame:
    """(by, u, v, depth, place): the n edges nearest to each key's anchors (by, u, v), nearest
    first, then by their ends. A key may have several anchors."""
    from pyspark.sql import Window

    seeds = anchors.select(*by, F.col("u").alias("near"), F.col("v").alias("far")).unionByName(anchors.select(*by, F.col("v").alias("near"), F.col("u").alias("far"))).distinct()
    found = frontier(directed(edges), seeds, by, n, n)
    d = found.groupBy(*by, F.least("near", "far").alias("u"), F.greatest("near", "far").alias("v")).agg(F.min("depth").alias("depth"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("depth", "u", "v"))  # a key has few edges here
    return d.withColumn("place", place.cast("long")).where(F.col("place") <= n)
