"""Outgroup candidates: where removed leaves hung, as splits of the real leaves, and
the edges worth trying around those places."""

from __future__ import annotations

from collections.abc import Iterable

from arborspark.sources import newick

from .topology import Edge, Tree, edge

Split = tuple[str, ...]


def canonical(side: Iterable[str], taxa: Iterable[str]) -> Split:
    """The smaller side of a split, of equal ones the first by name."""
    a = tuple(sorted(side))
    b = tuple(sorted(set(taxa) - set(a)))
    return min((len(a), a), (len(b), b))[1]


def prune_and_record(text: str, remove: Iterable[str], real: Iterable[str] | None = None, keep_outgroups: bool = False) -> tuple[str, dict[str, Split]]:
    """(Newick without the leaves, leaf -> split of the real leaves where it hung).

    Names that aren't in the tree are ignored. ``real``: the leaves that splits speak of
    (all that are not removed, unless given). keep_outgroups: leaves the tree as is.
    """
    tree = newick.parse(text)
    gone = sorted(set(remove) & set(tree.names.values()))
    taxa = sorted((set(tree.names.values()) if real is None else set(real) & set(tree.names.values())) - set(gone))
    skeleton, anchors = tree.prune(sorted(set(tree.names.values()) - set(taxa)))
    splits = {n: canonical(skeleton.beyond(*anchors[n]), taxa) for n in gone}
    return newick.write(tree if keep_outgroups else tree.prune(gone)[0]), splits


def split_of_edge(tree: Tree, u: int, v: int, real: Iterable[str]) -> Split:
    taxa = set(real)
    return canonical(tree.beyond(u, v) & taxa, taxa & set(tree.names.values()))


def find_anchor_edges(tree: Tree, anchor: Split, real: Iterable[str]) -> list[Edge]:
    """All edges that split the real leaves as the anchor does."""
    taxa = set(real) & set(tree.names.values())
    want = canonical(anchor, taxa)
    return [(u, v) for u, v, _ in tree.edges() if split_of_edge(tree, u, v, taxa) == want]


def candidate_edges(tree: Tree, seeds: Iterable[Edge], n: int = 14) -> list[Edge]:
    """The seeds and the edges nearest to any of them, at most n, ring by ring."""
    ring = sorted({edge(*s) for s in seeds})
    out, seen = ring[:n], set(ring)
    while ring and len(out) < n:
        ring = sorted({edge(x, w) for u, v in ring for x in (u, v) for w in tree.adj[x]} - seen)
        seen |= set(ring)
        out += ring[: n - len(out)]
    return out
