"""The merge of two outgroup-carrying subtrees, for work inside one task.

Each side is searched without its outgroups. The connector's two ends run over the
edges nearest to where the other side's outgroup hung; each pair is scored with its
five branches optimised. Then the inherited clades go back where they came from.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import numpy as np

from arborspark.sources import newick

from .likelihood import Scorer
from .models import Model
from .optimize import EPSILON, all_branches, five_branches_many
from .topology import Clade, Edge, Tree, edge


#: Numbers of a message array that are worked on at once: bounds a task's memory.
BATCH = 1 << 19


@dataclass(frozen=True)
class Options:
    window: int = 14
    connector: float = 0.1
    full_blo: str = "off"
    eps_five: float = 1000.0
    eps_full: float = -1.0

    def __post_init__(self) -> None:
        if self.full_blo not in ("off", "fast", "thorough"):
            raise ValueError('full_blo must be "off", "fast", or "thorough"')
        if self.window < 1:
            raise ValueError("window must be positive")


@dataclass
class Side:
    """One side, ready for the search."""

    core: Tree
    anchor: Edge
    clades: list[tuple[Clade, Edge, int]]  # with its anchor and its rank
    reference: str


def prepare(text: str, interest: str, inherited: Iterable[str]) -> Side:
    """Takes the interest leaf and all inherited leaves out, remembering where they were.

    Clades are found in the tree without the interest leaf only, whatever the
    caller's grouping; a clade's rank is the distance of its host from the
    smallest real leaf.
    """
    if not interest:
        raise ValueError("an interest leaf is needed")
    tree, names = newick.parse(text), sorted(set(inherited))
    core, anchors = tree.prune([interest, *names])
    bare = tree.copy()
    bare.detach({interest})
    reference = min(core.names.values())
    origin = bare.leaf(reference)
    clades = []
    for members in bare.clades_of(set(names)):
        host, _ = bare.stem(members)
        clades.append((bare.copy().detach(members), edge(*anchors[min(members)]), bare.hops(host, origin)))
    return Side(core, anchors[interest], clades, reference)


def connect(a: Side, b: Side, masks: Mapping[str, np.ndarray], weights: np.ndarray, model: Model, o: Options) -> tuple[float, Edge, Edge, list[float]]:
    """The best pair of edges, its log-likelihood and five branch lengths."""
    found = []
    scorers = [Scorer(s.core, masks, weights, model) for s in (a, b)]
    ends = []
    for side, s in zip((a, b), scorers, strict=True):
        ends.append([((u, v), (s.message(u, v), s.message(v, u)), side.core.adj[u][v] / 2) for u, v in side.core.window(*side.anchor, o.window)])
    pairs = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))]
    w = scorers[0].weights
    step = max(1, BATCH // (model.k * max(1, len(w))))
    for at in range(0, len(pairs), step):
        block = pairs[at : at + step]
        chosen = [[ends[0][i][1][0] for i, _ in block], [ends[0][i][1][1] for i, _ in block], [ends[1][j][1][0] for _, j in block], [ends[1][j][1][1] for _, j in block]]
        stacked = [(np.stack([m[0] for m in ms]), np.stack([m[1] for m in ms])) for ms in chosen]
        start = np.array([[o.connector, ends[0][i][2], ends[0][i][2], ends[1][j][2], ends[1][j][2]] for i, j in block])
        lls, lengths = five_branches_many(model, w, stacked, start, eps=o.eps_five)
        found += [(float(ll), ends[0][i][0], ends[1][j][0], t.tolist()) for (i, j), ll, t in zip(block, lls, lengths, strict=True)]
    return max(found, key=lambda x: x[0])  # the first of equals


class Merged:
    """The two cores joined at a connector, to which clades are given back."""

    def __init__(self, a: Side, b: Side, at: Edge, bt: Edge, lengths: list[float]) -> None:
        self.shift = a.core.fresh()
        self.tree = a.core.copy()
        for u, v, t in b.core.edges():
            self.tree.connect(u + self.shift, v + self.shift, t)
        self.tree.names.update({u + self.shift: n for u, n in b.core.names.items()})
        self.ends = []
        for (u, v), x, y in ((at, *lengths[1:3]), ((bt[0] + self.shift, bt[1] + self.shift), *lengths[3:5])):
            new = self.tree.split(u, v)
            self.tree.connect(u, new, x)
            self.tree.connect(new, v, y)
            self.ends.append((u, v, new))
        self.tree.connect(self.ends[0][2], self.ends[1][2], lengths[0])
        self.search = self.tree.copy()

    def restore(self, side: Side, which: int, masks, weights, model: Model) -> None:
        """Clades alone on their anchor edge go to its middle (on the connector's edge,
        to the better half); several on one edge are chained in their old order."""
        shift = self.shift * which
        u, v, new = self.ends[which]
        groups: dict[Edge, list[tuple[int, str, Clade]]] = {}
        for clade, (p, q), rank in side.clades:
            groups.setdefault((p + shift, q + shift), []).append((rank, min(clade.tree.names.values()), clade))
        for (p, q), members in sorted(groups.items(), key=lambda g: g[1][0][1]):
            members.sort(key=lambda m: m[:2])
            if len(members) == 1:
                clade = members[0][2]
                at = (p, q)
                if edge(p, q) == edge(u, v):
                    at = self._better_half(clade, u, new, v, masks, weights, model)
                if at[1] not in self.tree.adj[at[0]]:
                    at = self.tree.first_step(p, q)
                self.tree.graft(clade, *at)
                continue
            origin = self.tree.leaf(side.reference)
            near, far = sorted((p, q), key=lambda x: (self.tree.hops(origin, x), x))
            for _, _, clade in members:
                near = self.tree.graft(clade, *self.tree.first_step(near, far))

    def _better_half(self, clade: Clade, u: int, new: int, v: int, masks, weights, model: Model) -> Edge:
        def ll(x: int, y: int) -> float:
            t = self.search.copy()
            t.graft(clade, x, y)
            return Scorer(t, masks, weights, model).score()

        return (u, new) if ll(u, new) >= ll(new, v) else (new, v)


def merge(text_a: str, text_b: str, interest_a: str, interest_b: str, inherited_a: Iterable[str], inherited_b: Iterable[str], masks: Mapping[str, np.ndarray], weights: np.ndarray, model: Model, options: Options = Options()) -> tuple[str, float]:
    """(Newick, log-likelihood) of the merged tree.

    Without full optimisation the log-likelihood is that of the search tree (real
    taxa only); with it, of the whole returned tree.
    """
    a, b = prepare(text_a, interest_a, inherited_a), prepare(text_b, interest_b, inherited_b)
    both = _all_names(a) & _all_names(b)
    if both:
        raise ValueError(f"taxon on both sides: {min(both)}")
    ll, at, bt, lengths = connect(a, b, masks, weights, model, options)
    m = Merged(a, b, at, bt, lengths)
    m.restore(a, 0, masks, weights, model)
    m.restore(b, 1, masks, weights, model)
    if options.full_blo != "off":
        s = Scorer(m.tree, masks, weights, model)
        ll = all_branches(s, options.full_blo, eps=options.eps_full if options.eps_full > 0 else EPSILON[options.full_blo])
    return newick.write(m.tree), ll


def _all_names(s: Side) -> set[str]:
    return set(s.core.names.values()).union(*(c.tree.names.values() for c, _, _ in s.clades))
