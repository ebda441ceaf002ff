"""Seeded random trees and alignments for tests and benchmarks."""

from __future__ import annotations

import random
from collections.abc import Sequence

from .topology import Tree


def random_tree(taxa: Sequence[str], seed: int, low: float = 0.02, high: float = 0.4) -> Tree:
    """Grown by hanging each next taxon from a random edge."""
    rng = random.Random(seed)
    tree = Tree(names=dict(enumerate(taxa[:3])))
    hub = len(taxa)
    for i in range(3):
        tree.connect(i, hub, rng.uniform(low, high))
    for i in range(3, len(taxa)):
        u, v, _ = rng.choice(tree.edges())
        tree.names[i] = taxa[i]
        tree.adj[i] = {}
        new = max(hub, *tree.adj) + 1
        length = tree.disconnect(u, v)
        at = rng.random()
        tree.connect(u, new, at * length)
        tree.connect(new, v, (1 - at) * length)
        tree.connect(new, i, rng.uniform(low, high))
    return tree


def random_alignment(taxa: Sequence[str], sites: int, seed: int, letters: str = "ACGT") -> dict[str, str]:
    rng = random.Random(seed)
    return {t: "".join(rng.choice(letters) for _ in range(sites)) for t in taxa}
