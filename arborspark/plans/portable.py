"""SQL that Spark and DuckDB both run, over tables of the driver's schema.

``{table}`` names a table; ``@list(x)`` is a comma-joined, sorted list aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.topology import Tree
from arborspark.storage import once


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = {}
    if NODES in text:
        # recursion reads the nodes once a level: they are computed once and kept in the
        # checkpoint folder, where they stay as long as its owner keeps it
        suppliers = once(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"))
        up = once(spark.sql("with " + NODES.rstrip(",") + " select * from up", supplier=suppliers))
        tables = {"supplier": suppliers, "tree_up": up}
        text = text.replace(NODES, "n as (select cast(count(*) as bigint) as n from {supplier}),\nup as (select * from {tree_up}),")
        # a recursion of Spark's ends with an error at a million rows, so its rows are made here
        if ABOVE in text:
            tables["tree_above"] = ancestors(up)
            text = text.replace(ABOVE, ",\nabove as (select * from {tree_above})")
        for walk, rows in ((REACH, "reach as (select * from {tree_walk})"), (WALK, "walk as (select * from {tree_walk} where prev > 0)")):
            if walk in text:
                tables["tree_walk"] = walked(up)
                text = text.replace(walk, rows)
    names = set(re.findall(r"\{(\w+)\}", text)) - set(tables)
    tables |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    return spark.sql(re.sub(r"@list\((\w+)\)", r"listagg(cast(\1 as string), ',') within group (order by \1)", text), **tables)


def ancestors(up: DataFrame) -> DataFrame:
    """(node, a, depth, dist): the rows of ``ABOVE``. After round i a node has what lies less
    than 2^i above it; a step of 2^i from each of these gives the next rows, which are
    kept, so the rounds are the logarithm of the height."""
    found = up.select("node", F.col("node").alias("a"), F.lit(0).alias("depth"), F.lit(0.0).alias("dist"))
    step = once(up.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("over"), F.col("bl").alias("far")))
    length = 1
    while not step.isEmpty():
        further = found.join(step, "a").select("node", F.col("over").alias("a"), (F.col("depth") + length).alias("depth"), (F.col("dist") + F.col("far")).alias("dist"))
        found = found.unionByName(once(further))
        beyond = step.select(F.col("a").alias("over"), F.col("over").alias("over2"), F.col("far").alias("far2"))
        step = once(step.join(beyond, "over").select("a", F.col("over2").alias("over"), (F.col("far") + F.col("far2")).alias("far")))
        length *= 2
    return found


def walked(up: DataFrame) -> DataFrame:
    """(prev, node, first_v): every node as a walk from node 2 reaches it, with the node
    before it and the first one of the walk; node 2 itself has prev 0 and no first. A level
    a round."""
    edges = up.where("parent > 1").select(F.col("parent").alias("u"), F.col("node").alias("v")).unionByName(up.where("node = 3").select(F.lit(2).cast("long").alias("u"), F.col("node").alias("v")))
    ways = once(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    at = once(up.where("node = 2").select(F.lit(0).cast("long").alias("prev"), "node", F.lit(None).cast("long").alias("first_v")))
    found = at
    while not at.isEmpty():
        on = at.join(ways, F.col("node") == F.col("u")).where("v <> prev")
        at = once(on.select(F.col("node").alias("prev"), F.col("v").alias("node"), F.coalesce("first_v", "v").alias("first_v")))
        found = found.unionByName(at)
    return found


def duckdb(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", re.sub(r"@list\((\w+)\)", r"string_agg(cast(\1 as varchar), ',' order by \1)", text))


#: A binary tree whose leaves are all suppliers: inner nodes 2 to n - 1, supplier s at
#: node n + s, the parent of i is i div 2, and the root is suppressed into edge 2-3.
NODES = """n as (select cast(count(*) as bigint) as n from {supplier}),
up as (
  select node, taxon, cast(floor(node / 2) as bigint) as parent, 0.05e0 + (node % 7) * 0.03e0 as bl
  from (select s_suppkey + n as node, s_suppkey as taxon from {supplier}, n
        union all select s_suppkey, cast(null as bigint) from {supplier} where s_suppkey >= 2) x
),"""
TREE = "with recursive " + NODES + """
edge as (
  select parent as u, node as v, bl from up where parent > 1
  union all select cast(2 as bigint), cast(3 as bigint), sum(bl) from up where parent = 1
),
directed as (select u, v, bl from edge union all select v, u, bl from edge)"""

#: Every node with all nodes above it (a), itself included.
ABOVE = """,
above(node, a, depth, dist) as (
  select node, node, 0, cast(0 as double) from up
  union all
  select above.node, up.parent, above.depth + 1, above.dist + up.bl from above join up on above.a = up.node
)"""

#: Every node, walked from node 2.
REACH = """reach(prev, node) as (
  select cast(0 as bigint), cast(2 as bigint)
  union all
  select reach.node, d.v from reach join directed d on d.u = reach.node and d.v <> reach.prev
)"""
WALK = """walk(prev, node, first_v) as (
  select cast(2 as bigint), v, v from directed where u = 2
  union all
  select walk.node, d.v, walk.first_v from walk join directed d on d.u = walk.node and d.v <> walk.prev
)"""

DEGREE = TREE + """
select u as node, count(*) as degree from directed group by u"""

VALIDATE = TREE + ",\n" + REACH + """,
deg as (select u as node, count(*) as k from directed group by u)
select (select count(*) from up) as nodes, (select count(*) from edge) as edges,
  cast(sum(case when up.taxon is not null and k <> 1 then 1 else 0 end) as bigint) as bad_leaves,
  cast(sum(case when up.taxon is null and k <> 3 then 1 else 0 end) as bigint) as bad_inner,
  (select count(distinct node) from reach) as reached
from up join deg on up.node = deg.node"""

POSTORDER = TREE + ABOVE + """
select node, max(depth) as depth, cast(row_number() over (order by max(depth) desc, node) as bigint) as place from above group by node"""

#: From supplier 0 to every supplier, over the nearest common ancestor. The suppressed
#: root is no node, so a path over it has one edge less.
DISTANCE = TREE + ABOVE + """,
origin as (select above.a, above.depth, above.dist from above join up on above.node = up.node where up.taxon = 0),
path as (
  select up.taxon, case when above.a = 1 then -1 else 0 end + above.depth + origin.depth as hops, above.dist + origin.dist as dist
  from above join origin on above.a = origin.a join up on up.node = above.node where up.taxon is not null
)
select taxon, min(hops) as hops, round(min(dist), 6) as dist from path group by taxon"""

PATH_EDGE = TREE + ",\n" + WALK + """
select cast(2 as bigint) as from_node, node as to_node, first_v from walk"""

#: What is left of the tree without every third supplier.
KEPT = TREE + ABOVE + """,
kept as (
  select above.a as node, count(*) as k from above join up on above.node = up.node
  where up.taxon is not null and up.taxon % 3 <> 0 group by above.a
),
joint as (
  select kept.node from kept left join up on up.parent = kept.node left join kept below on below.node = up.node
  group by kept.node having count(up.node) = 0 or count(below.node) = 2
),
run as (
  select node, a, dist from (
    select above.node, above.a, above.dist, row_number() over (partition by above.node order by above.depth) as r
    from above join joint lower on above.node = lower.node join joint upper on above.a = upper.node where above.depth > 0
  ) x where r = 1
),
top as (select joint.node from joint left join run on joint.node = run.node where run.node is null)"""

PRUNE = KEPT + """
select run.a as u, run.node as v, round(dist, 6) as bl from run left join top on run.a = top.node where top.node is null
union all
select min(run.node), max(run.node), round(sum(dist), 6) from run join top on run.a = top.node"""

#: The anchor of each removed leaf, as the lower node of the kept edge it hung from (the
#: root's two edges are one: its smaller lower node stands for both).
ANCHOR = KEPT + """,
host as (
  select taxon, host, k from (
    select up.taxon, above.a as host, kept.k, row_number() over (partition by up.taxon order by above.depth) as r
    from up join above on up.node = above.node join kept on above.a = kept.node
    where up.taxon is not null and up.taxon % 3 = 0
  ) x where r = 1
),
lower_end as (
  select host.taxon, max(joint.node) as node from host join above on above.a = host.host
  join joint on joint.node = above.node join kept on kept.node = joint.node and kept.k = host.k group by host.taxon
),
atop as (select min(run.node) as node from run join top on run.a = top.node)
select taxon, case when l.node in (select node from top) or run.a in (select node from top) then atop.node else l.node end as anchor
from lower_end l cross join atop left join run on run.node = l.node"""

#: The smaller side of each removed leaf's anchor edge, in kept taxa.
ANCHOR_SPLIT = ANCHOR.replace("\nselect taxon, case", ",\nanchor as (select taxon, case").rstrip() + """),
side as (
  select anchor.taxon, up.taxon as member from anchor join above on above.a = anchor.anchor join up on up.node = above.node
  where up.taxon % 3 <> 0
),
sized as (select taxon, count(*) as k from side group by taxon),
total as (select count(*) as m from up where taxon % 3 <> 0),
small as (
  select side.taxon, member from side join sized on side.taxon = sized.taxon cross join total where 2 * k <= m
  union all
  select sized.taxon, up.taxon from sized cross join total cross join up left join side on side.taxon = sized.taxon and side.member = up.taxon
  where 2 * k > m and up.taxon % 3 <> 0 and side.member is null
)
select taxon, count(*) as size, @list(member) as members from small group by taxon"""

#: Maximal subtrees of removed leaves only.
CLADES = KEPT + """,
lost as (select up.node, up.parent from up left join kept on up.node = kept.node where kept.node is null),
head as (select lost.node from lost left join lost over_it on lost.parent = over_it.node where over_it.node is null)
select above.a as root, count(*) as size, @list(taxon) as members
from head join above on above.a = head.node join up on up.node = above.node where up.taxon is not null group by above.a"""

#: Canonical splits (the side without supplier 0) of two trees: suppliers in order, and
#: supplier t at leaf (3t + 1) mod n.
SPLITS = TREE + ABOVE + """,
leaf as (
  select 1 as tree, node, taxon from up where taxon is not null
  union all select 2, n + (3 * s_suppkey + 1) % n, s_suppkey from {supplier}, n
),
members as (select leaf.tree, above.a as node, leaf.taxon from leaf join above on above.node = leaf.node where above.a > 1),
turned as (select tree, node from members where taxon = 0),
side as (
  select m.tree, m.node, m.taxon from members m left join turned t on m.tree = t.tree and m.node = t.node where t.node is null
  union all
  select t.tree, t.node, s.s_suppkey from turned t cross join {supplier} s
  left join members m on m.tree = t.tree and m.node = t.node and m.taxon = s.s_suppkey where m.node is null
),
splits as (
  select distinct tree, size, members from (
    select tree, node, count(*) as size, @list(taxon) as members from side group by tree, node
  ) x cross join n where size between 2 and n - 2
)"""

SPLIT_ROWS = SPLITS + """
select tree, size, members from splits"""

RF = SPLITS + """,
lone as (select members from splits group by members having count(*) = 1)
select (select count(*) from lone) as rf, (select count(*) from lone) / cast(2 * (n - 3) as double) as nrf, n as taxa from n"""

#: The split of the first tree that divides the suppliers most evenly.
CHOOSE = SPLITS + """
select size, members from (
  select size, members, row_number() over (order by abs(size - 0.45e0 / 0.9e0 * n), members) as r from splits cross join n where tree = 1
) x where r = 1"""

#: Edges around edge 2-3, the tree's root: an edge is as far as its lower node is deep.
WINDOW = TREE + ABOVE + """,
deep as (select node, max(depth) - 1 as depth from above group by node),
near as (
  select u, v, depth, cast(row_number() over (order by depth, u, v) as bigint) as place from (
    select cast(2 as bigint) as u, cast(3 as bigint) as v, 0 as depth
    union all
    select up.parent, up.node, deep.depth from up join deep on up.node = deep.node where up.parent > 1
  ) x
)"""

WINDOW_ROWS = WINDOW + """
select u, v, depth, place from near where place <= 14"""

#: Window x window, in rank order: the candidate pairs of a merge (14 x 14 at most).
WINDOW_PAIRS = WINDOW + """
select a.u as au, a.v as av, b.u as bu, b.v as bv, cast(row_number() over (order by a.place, b.place) as bigint) as place
from near a cross join near b where a.place <= 14 and b.place <= 14"""

NNI = TREE + """,
other as (select e.u, e.v, d.v as w, row_number() over (partition by e.u, e.v order by d.v) as r
          from directed e join directed d on d.u = e.u and d.v <> e.v)
select e.u, e.v, a.w as moved_u, b.w as moved_v
from edge e join other a on a.u = e.u and a.v = e.v and a.r = 1 join other b on b.u = e.v and b.v = e.u"""

SPR_POINTS = TREE + """
select d.u, d.v from directed d join directed o on o.u = d.u and o.v <> d.v join up on up.node = o.v and up.taxon is null
group by d.u, d.v"""

SPR_TARGETS = TREE + """,
start as (select d.u, d.v from directed d join directed o on o.u = d.u and o.v <> d.v join up on up.node = o.v and up.taxon is null group by d.u, d.v),
walk(pu, pv, prev, node, depth) as (
  select start.u, start.v, start.u, d.v, 0 from start join directed d on d.u = start.u and d.v <> start.v
  union all
  select walk.pu, walk.pv, walk.node, d.v, walk.depth + 1 from walk join directed d on d.u = walk.node and d.v <> walk.prev where walk.depth < 10
)
select pu, pv, prev as near, node as far, depth from walk where depth >= 1"""

#: The tree after the subtree behind (2, 4) moved to the middle of the edge above supplier n-1.
SPR_APPLY = TREE + """,
gone as (select bl, v as w from directed where u = 2 and v <> 4),
target as (select parent as x, node as y, bl from up join n on up.node = 2 * n - 1)
select u, v, round(e.bl, 6) as bl from edge e left join target t on e.u = t.x and e.v = t.y
where not (e.u = 2 and e.v <> 4) and t.x is null
union all select min(w), max(w), round(sum(bl), 6) from gone
union all select least(cast(2 as bigint), x), greatest(cast(2 as bigint), x), round(bl / 2, 6) from target
union all select least(cast(2 as bigint), y), greatest(cast(2 as bigint), y), round(bl / 2, 6) from target"""

# -- alignments derived from lineitem ------------------------------------------
#: Blocks of eight suppliers: taxa 0 to 7, sites by month, states 0 to 3.
CELLS = """select cast(floor(l_suppkey / 8) as bigint) as msa_id, l_suppkey % 8 as taxon, cast(year(l_shipdate) * 12 + month(l_shipdate) as bigint) as site,
  cast(sum(l_quantity) as bigint) % {states} as st from {{lineitem}} group by 1, 2, 3"""


def cells(states: int = 4) -> str:
    return CELLS.format(states=states)


def pattern_ctes(taxa: int = 8) -> str:
    """``cells``, ``cols`` and ``pats``: distinct columns (t0 ... ; null is a gap)."""
    each = ", ".join(f"max(case when taxon = {t} then st end) as t{t}" for t in range(taxa))
    names = ", ".join(f"t{t}" for t in range(taxa))
    return f"""with cells as ({cells()}),
cols as (select msa_id, site, {each} from cells group by msa_id, site),
pats as (select msa_id, {names}, count(*) as weight, min(site) as first_site from cols group by msa_id, {names})"""


def heap_tree(n: int = 8, leaf=lambda t: t) -> Tree:
    """The tree of TREE for n leaves named t0, t1, ...; leaf: taxon -> leaf place."""
    tree = Tree(names={n + leaf(t): f"t{t}" for t in range(n)})
    length = lambda i: 0.05 + (i % 7) * 0.03
    for i in range(4, 2 * n):
        tree.connect(i // 2, i, length(i))
    tree.connect(2, 3, length(2) + length(3))
    return tree


def jc_ctes(tree: Tree, source: str = "pats", k: int = 4) -> tuple[str, str]:
    """(CTEs, name of the last): the Jukes-Cantor likelihood of each row of ``source``.

    Leaves are columns of states named by taxon. Each inner node adds k plain columns,
    so engines compile the whole pruning into one pass; ``site`` is the likelihood.
    """
    import math

    leaf = tree.leaf(min(tree.names.values()))
    (root,) = tree.adj[leaf]
    out, last = [], source

    def value(node: int, s: int) -> str:
        if node in tree.names:
            t = tree.names[node]
            return f"(case when {t} is null or {t} = {s} then 1e0 else 0e0 end)"
        return f"x{node}_{s}"

    def over(node: int, bl: float, s: int) -> str:
        other = (1 - math.exp(-k * bl / (k - 1))) / k
        same = 1 - (k - 1) * other
        total = " + ".join(value(node, j) for j in range(k))
        return f"({other!r} * ({total}) + {same - other!r} * {value(node, s)})"

    for node, parent in tree.postorder(root):
        if node in tree.names:
            continue
        kids = [(v, bl) for v, bl in sorted(tree.adj[node].items()) if v != parent]
        each = ", ".join(f"{' * '.join(over(v, bl, s) for v, bl in kids)} as x{node}_{s}" for s in range(k))
        out.append(f"n{node} as (select {last}.*, {each} from {last})")
        last = f"n{node}"
    out.append(f"lik as (select {last}.*, ({' + '.join(f'x{root}_{s}' for s in range(k))}) / {k} as like_ from {last})")
    return ",\n".join(out), "lik"


_JC, _ = jc_ctes(heap_tree())
SCORE_JC = pattern_ctes() + ",\n" + _JC + """
select msa_id, cast(sum(weight) as bigint) as n_sites, count(*) as n_patterns, round(sum(weight * ln(greatest(like_, 1e-300))), 6) as loglik
from lik group by msa_id"""
SITE_JC = pattern_ctes() + ",\n" + _JC + """
select msa_id, first_site, weight, round(ln(greatest(like_, 1e-300)), 6) as site_lnl from lik"""
