"""Newick trees: parser, writer, and a table function for SQL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from arborspark.functions.topology import Tree

TOKEN = re.compile(r"\s*('(?:[^']|'')*'|[(),:;]|[^\s(),:;']+)")
DEFAULT_LENGTH = 0.1


def parse(text: str, *, default: float = DEFAULT_LENGTH, taxa: list[str] | None = None, strict: bool = True) -> Tree:
    """Unrooted tree of a Newick string. Missing lengths are ``default``; a root with two
    children is suppressed (their lengths add up); labels of inner nodes are
    ignored. strict: only binary inner nodes. taxa: the only names allowed."""
    tree, stack, node, at = Tree(), [], 0, None
    want_length, lengths, parent = False, {}, {}
    children: dict[int, list[int]] = {0: []}
    tokens = TOKEN.findall(re.sub(r"\[[^\]]*\]", "", text.strip()))
    if not tokens or tokens[0] != "(":
        raise ValueError("a Newick tree starts with '('")
    closed = False
    for token in tokens:
        if token == "(":
            if at is None and not stack:
                at = 0
            else:
                node += 1
                children[node] = []
                parent[node] = stack[-1]
                children[stack[-1]].append(node)
                at = node
            stack.append(at)
            closed, at = False, None
        elif token in ",)":
            if not stack:
                raise ValueError("unbalanced parentheses")
            closed, want_length = token == ")", False
            at = stack.pop() if closed else None
        elif token == ":":
            want_length = True
        elif token == ";":
            break
        elif want_length:
            lengths[at] = float(token)
            want_length = False
        elif not closed:
            name = token[1:-1].replace("''", "'") if token[0] == "'" else token
            if taxa is not None and name not in taxa:
                raise ValueError(f"Unknown taxon: {name}")
            node += 1
            at, children[node], parent[node] = node, [], stack[-1]
            children[stack[-1]].append(node)
            tree.names[node] = name
    if stack:
        raise ValueError("unbalanced parentheses")
    for u, p in parent.items():
        tree.connect(u, p, lengths.get(u, default))
    if len(tree.adj.get(0, ())) == 2:
        tree.suppress(0)
    if len(set(tree.names.values())) != len(tree.names):
        raise ValueError("a taxon occurs twice")
    if len(tree.names) < 3:
        raise ValueError("a tree needs 3 leaves")
    if strict and (wrong := tree.problems()):
        raise ValueError(wrong[0])
    return tree


def write(tree: Tree, digits: int = 15) -> str:
    """Canonical Newick: rooted at the neighbour of the smallest leaf, subtrees by their
    smallest leaf, so equal trees give equal strings."""
    smallest = tree.leaf(min(tree.names.values()))
    (root,) = tree.adj[smallest]
    least: dict[int, str] = {}
    for u, p in tree.postorder(root):
        least[u] = tree.names[u] if u in tree.names else min(least[v] for v in tree.adj[u] if v != p)
    # pieces in order, so that no text is copied at every level
    out: list[str] = []
    todo: list[str | tuple[int, int | None]] = [(root, None)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        u, p = item
        length = "" if p is None else f":{tree.adj[u][p]:.{digits}g}"
        if u in tree.names:
            out.append(_quoted(tree.names[u]) + length)
            continue
        todo.append(")" + length)
        kids = sorted((v for v in tree.adj[u] if v != p), key=least.__getitem__, reverse=True)
        for i, v in enumerate(kids):
            todo += [",", (v, u)] if i else [(v, u)]
        out.append("(")
    return "".join(out) + ";"


def _quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if re.search(r"[\s(),:;'\[\]]", name) else name


@udtf(returnType="u int, v int, bl double, taxon string")
class NewickEdges:
    """Edges (u, v, bl) of a Newick tree; taxon names v where it is a leaf."""

    def eval(self, newick: str):
        tree = parse(newick)
        root = next(iter(sorted(set(tree.adj) - set(tree.names))))
        for v, u in tree.walk(root):
            if u is not None:
                yield u, v, tree.adj[u][v], tree.names.get(v)


def register(spark: SparkSession) -> None:
    """Makes newick_edges(text) available to SQL, for LATERAL joins."""
    spark.udtf.register("newick_edges", NewickEdges)
