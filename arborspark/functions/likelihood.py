"""Log-likelihoods of a tree over weighted alignment patterns, for work inside one task.

A message (u, v) holds, for each state and pattern, the likelihood of what lies on u's
side of the edge u-v given the state at u. Messages are computed when asked for and kept
until a branch length behind them changes.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

from .models import Model
from .topology import Tree

TINY, BOOST = 1e-40, 1e40
FLOOR = 1e-300
Message = tuple[np.ndarray, np.ndarray]


def tip(masks: np.ndarray, k: int) -> Message:
    """Message of a leaf: one for each state its mask allows, all ones for a gap."""
    m = np.asarray(masks, np.int64)
    out = ((m[None, :] >> np.arange(k)[:, None]) & 1).astype(float)
    out[:, ~out.any(0)] = 1.0
    return out, np.zeros(len(m))


def rescaled(x: np.ndarray, log: np.ndarray) -> Message:
    """Lifts patterns whose largest entry falls below 1e-40, and notes it in the log."""
    top = x.max(0) if x.size else np.zeros(0)
    low = (top > 0) & (top < TINY)
    if low.any():
        x = x.copy()
        x[:, low] *= BOOST
        log = log - np.where(low, np.log(BOOST), 0.0)
    return x, log


def joined(model: Model, *parts: tuple[Message, float]) -> Message:
    """Product of messages, each carried over a branch."""
    x, log = None, 0.0
    for (m, own), t in parts:
        y = model.p(t) @ m
        x = y if x is None else x * y
        log = log + own
    return rescaled(x, log)


def across(model: Model, weights: np.ndarray, a: Message, b: Message, t: float) -> float:
    """Log-likelihood at a branch of length t between two messages."""
    site = (model.pi[:, None] * a[0] * (model.p(t) @ b[0])).sum(0)
    return float((weights * (np.log(np.maximum(site, FLOOR)) + a[1] + b[1])).sum())


def site_logs(model: Model, a: Message, b: Message, t: float) -> np.ndarray:
    site = (model.pi[:, None] * a[0] * (model.p(t) @ b[0])).sum(0)
    return np.log(np.maximum(site, FLOOR)) + a[1] + b[1]


class Scorer:
    """Messages and likelihood of one tree. masks: taxon -> state masks by pattern;
    leaves without a row are refused."""

    def __init__(self, tree: Tree, masks: Mapping[str, np.ndarray], weights: np.ndarray, model: Model) -> None:
        missing = sorted(set(tree.names.values()) - set(masks))
        if missing:
            raise KeyError(f"taxon not in the alignment: {missing[0]}")
        self.tree, self.model = tree, model
        self.weights = np.asarray(weights, float)
        self.tips = {u: tip(masks[n], model.k) for u, n in tree.names.items()}
        self.kept: dict[tuple[int, int], Message] = {}

    def message(self, u: int, v: int) -> Message:
        kept, adj = self.kept, self.tree.adj
        stack = [(u, v)]
        while stack:
            x, p = stack[-1]
            if (x, p) in kept:
                stack.pop()
                continue
            if x in self.tips:
                kept[(x, p)] = self.tips[x]
                stack.pop()
                continue
            kids = [w for w in adj[x] if w != p]
            todo = [(w, x) for w in kids if (w, x) not in kept]
            if todo:
                stack.extend(todo)
            else:
                kept[(x, p)] = joined(self.model, *((kept[(w, x)], adj[x][w]) for w in kids))
                stack.pop()
        return kept[(u, v)]

    def set_length(self, u: int, v: int, t: float) -> None:
        """Changes a branch and forgets the messages that carry it."""
        self.tree.connect(u, v, t)
        for start, p in ((u, v), (v, u)):
            for x, q in self.tree.walk(start, p):
                # what x sends on, away from the branch
                for w in self.tree.adj[x]:
                    if w != q:
                        self.kept.pop((x, w), None)

    def root(self) -> tuple[int, int]:
        leaf = self.tree.leaf(min(self.tree.names.values()))
        return leaf, next(iter(self.tree.adj[leaf]))

    def score(self) -> float:
        u, v = self.root()
        return across(self.model, self.weights, self.message(u, v), self.message(v, u), self.tree.adj[u][v])

    def sites(self) -> np.ndarray:
        """Log-likelihood of each pattern."""
        u, v = self.root()
        return site_logs(self.model, self.message(u, v), self.message(v, u), self.tree.adj[u][v])
