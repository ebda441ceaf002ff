"""Branch-length optimisation: Newton steps on one branch, and sweeps over several."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .likelihood import BOOST, FLOOR, TINY, Message, Scorer, across, joined
from .models import Model
from .topology import Edge, Tree

LEAST, MOST = 1e-6, 100.0
TOLERANCE, STEPS, SWEEPS = 1e-7, 30, 32


def newton(model: Model, weights: np.ndarray, a: Message, b: Message, t: float) -> tuple[float, bool]:
    """(length, converged) of the branch between two messages: ``newton_many`` for one
    branch, with plain numbers where that has an array a branch."""
    s = (model.right @ b[0]) * ((model.left * model.pi[:, None]).T @ a[0])
    powers = np.stack([np.ones_like(model.rates), model.rates, model.rates**2])
    x, low, high = math.log(min(max(t, LEAST), MOST)), math.log(LEAST), math.log(MOST)
    known_low = known_high = False
    for _ in range(STEPS):
        length = math.exp(x)
        like, first, second = (powers * np.exp(model.rates * length)) @ s
        np.maximum(like, FLOOR, out=like)
        first /= like
        slope = float(first @ weights)
        bend = length * (length * (float((weights / like) @ second) - float((first * first) @ weights)) + slope)
        if not (math.isfinite(slope) and math.isfinite(bend)):
            break
        if slope >= TOLERANCE:
            low, known_low, goal, tested = x, True, high, known_high
        else:
            high, known_high, goal, tested = x, True, low, known_low
        step = x - length * slope / bend if bend < 0 else math.nan
        new = step if min(x, goal) < step < max(x, goal) else (x + goal) / 2 if tested else goal
        if (abs(slope) < TOLERANCE and bend < -TOLERANCE) or abs(math.exp(new) - length) < TOLERANCE:
            return min(max(length, LEAST), MOST), True
        x = new
    return min(max(math.exp(x), LEAST), MOST), False


def newton_many(model: Model, weights: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, converged) of many branches at once: messages (branches, states, patterns).

    In the model's eigenbasis a pattern's likelihood is a sum of exponentials of the length,
    so a point costs a few products.
    """
    s = (model.right @ b) * ((model.left * model.pi[:, None]).T @ a)
    powers = np.stack([np.ones_like(model.rates), model.rates, model.rates**2])

    def sums(rows: np.ndarray, _: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms = powers * np.exp(model.rates * length[:, None])[:, None, :]
        like, first, second = np.moveaxis(terms @ (s if len(rows) == len(s) else s[rows]), 1, 0)
        first, second = first / np.maximum(like, FLOOR), second / np.maximum(like, FLOOR)
        slope = first @ weights
        return slope, length * (length * ((second - first**2) @ weights) + slope)

    return climbed(sums, t)


def climbed(sums: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, converged) of many branches from the lengths t. ``sums`` gives, for some of them
    (their numbers, logarithms of lengths and lengths), the slopes by the length and the
    second derivatives by its logarithm.

    Works on the logarithm x of the length, within a bracket that every slope shrinks: the
    optimum lies right of a rising point and left of a falling one. A Newton step is
    taken if it stays inside; else the bracket's end is tried, if nothing is known of
    it yet, and then the middle.
    """
    x = np.log(np.clip(t, LEAST, MOST))
    ends = np.tile(np.log([LEAST, MOST]), (len(x), 1))
    known = np.zeros((len(x), 2), bool)
    fine, open_ = np.zeros(len(x), bool), np.arange(len(x))
    for _ in range(STEPS):
        at = x[open_]
        length = np.exp(at)
        slope, bend = sums(open_, at, length)
        sound = np.isfinite(slope) & np.isfinite(bend)
        side = (slope < TOLERANCE).astype(int)  # 0: rising, the optimum is to the right; flat tails count as falling
        rows = open_[sound]
        ends[rows, side[sound]], known[rows, side[sound]] = at[sound], True
        goal = np.take_along_axis(ends[open_], 1 - side[:, None], 1)[:, 0]
        tested = np.take_along_axis(known[open_], 1 - side[:, None], 1)[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(bend < 0, at - length * slope / bend, np.nan)
        low, high = np.minimum(at, goal), np.maximum(at, goal)
        new = np.where((step > low) & (step < high), step, np.where(tested, (low + high) / 2, goal))
        done = ((np.abs(slope) < TOLERANCE) & (bend < -TOLERANCE)) | (np.abs(np.exp(new) - length) < TOLERANCE)  # a flat tail is no optimum
        x[open_[sound & ~done]] = new[sound & ~done]
        fine[open_[sound & done]] = True
        open_ = open_[sound & ~done]
        if not len(open_):
            break
    return np.clip(np.exp(x), LEAST, MOST), fine


def moved_many(model: Model, m: Message, x: np.ndarray) -> Message:
    """Messages (branches, states, patterns), each carried over a branch of its own length."""
    p = np.maximum((model.left * np.exp(model.rates * x[:, None])[:, None, :]) @ model.right, 0.0)
    p[x <= 0] = np.eye(model.k)
    return p @ m[0], m[1]


def both_many(model: Model, a: Message, x: np.ndarray, b: Message, y: np.ndarray) -> Message:
    """The products of two messages, each carried over its branch, rescaled."""
    (u, lu), (v, lv) = moved_many(model, a, x), moved_many(model, b, y)
    z, log = u * v, lu + lv
    top = z.max(1)
    low = (top > 0) & (top < TINY)
    if low.any():
        z, log = np.where(low[:, None, :], z * BOOST, z), log - np.where(low, np.log(BOOST), 0.0)
    return z, log


def five_branches(model: Model, weights: np.ndarray, a: tuple[Message, Message], b: tuple[Message, Message], start, *, eps: float = 1000.0, sweeps: int = SWEEPS) -> tuple[float, list[float]]:
    """Gauss-Seidel over an inner branch and its four neighbours.

    a, b: the two messages beyond either end. start and result: [inner, a0, a1, b0, b1].
    Returns the log-likelihood of the last sweep and its lengths.
    """
    t = list(start)
    ends = [*a, *b]
    u, v = (joined(model, (ends[i], t[1 + i]), (ends[i + 1], t[2 + i])) for i in (0, 2))
    last = across(model, weights, u, v, t[0])
    for _ in range(sweeps):
        t[0] = newton(model, weights, u, v, t[0])[0]
        for i in range(4):
            # the rest of the tree as seen from this end's branch
            far, mate = (v if i < 2 else u), i ^ 1
            rest = joined(model, (far, t[0]), (ends[mate], t[1 + mate]))
            t[1 + i] = newton(model, weights, rest, ends[i], t[1 + i])[0]
            if i == 1:
                u = joined(model, (ends[0], t[1]), (ends[1], t[2]))
        v = joined(model, (ends[2], t[3]), (ends[3], t[4]))
        now = across(model, weights, u, v, t[0])
        if now - last < eps:
            return now, t
        last = now
    return last, t


def five_branches_many(model: Model, weights: np.ndarray, ends: list[Message], start: np.ndarray, *, eps: float = 1000.0, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """``five_branches`` for many pairs at once. ends: the four messages, each
    (pairs, states, patterns) with logs (pairs, patterns); start: (pairs, 5)."""
    t, ends = start.copy(), list(ends)
    out, lengths = np.zeros(len(t)), start.copy()
    live = np.arange(len(t))

    def both(a: Message, x: np.ndarray, b: Message, y: np.ndarray) -> Message:
        return both_many(model, a, x, b, y)

    def total(u: Message, v: Message, x: np.ndarray) -> np.ndarray:
        site = (model.pi[:, None] * u[0] * moved_many(model, v, x)[0]).sum(1)
        return (np.log(np.maximum(site, FLOOR)) + u[1] + v[1]) @ weights

    u, v = both(ends[0], t[:, 1], ends[1], t[:, 2]), both(ends[2], t[:, 3], ends[3], t[:, 4])
    last = total(u, v, t[:, 0])
    for _ in range(sweeps):
        t[:, 0] = newton_many(model, weights, u[0], v[0], t[:, 0])[0]
        for i in range(4):
            rest = both(v if i < 2 else u, t[:, 0], ends[i ^ 1], t[:, 1 + (i ^ 1)])
            t[:, 1 + i] = newton_many(model, weights, rest[0], ends[i][0], t[:, 1 + i])[0]
            if i == 1:
                u = both(ends[0], t[:, 1], ends[1], t[:, 2])
        v = both(ends[2], t[:, 3], ends[3], t[:, 4])
        now = total(u, v, t[:, 0])
        out[live], lengths[live] = now, t
        more = now - last >= eps
        if not more.any():
            break
        live, t, last = live[more], t[more], now[more]
        ends, (u, v) = [(x[more], y[more]) for x, y in ends], ((x[more], y[more]) for x, y in (u, v))
    return out, lengths


def three_branches(model: Model, weights: np.ndarray, ends: tuple[Message, Message, Message], start, *, eps: float = 1000.0) -> tuple[float, list[float]]:
    """The three branches of one node, in turn."""
    t = list(start)
    last = across(model, weights, joined(model, (ends[0], t[0]), (ends[1], t[1])), ends[2], t[2])
    for _ in range(SWEEPS):
        for i in range(3):
            j, k = (x for x in range(3) if x != i)
            t[i] = newton(model, weights, joined(model, (ends[j], t[j]), (ends[k], t[k])), ends[i], t[i])[0]
        now = across(model, weights, joined(model, (ends[0], t[0]), (ends[1], t[1])), ends[2], t[2])
        if now - last < eps:
            break
        last = now
    return now, t


def one_branch(scorer: Scorer, u: int, v: int) -> bool:
    """Optimises a branch in place; keeps the old length if Newton did not converge."""
    t = scorer.tree.adj[u][v]
    if t <= 0:
        return False
    new, fine = newton(scorer.model, scorer.weights, scorer.message(u, v), scorer.message(v, u), t)
    if fine and new != t:
        scorer.set_length(u, v, new)
        return True
    return False


EPSILON = {"fast": 10.0, "thorough": 0.1, "lbfgsb": 0.1}


def all_branches(scorer: Scorer, mode: str = "fast", *, eps: float | None = None, sweeps: int | None = None, edges: list[Edge] | None = None) -> float:
    """Sweeps over the tree's branches in place; returns the log-likelihood.

    fast, thorough (and lbfgsb, the same): until a sweep gains less than ``eps``;
    fixed: ``sweeps`` sweeps; local: one sweep over ``edges``; triplet: node by node.
    """
    if mode == "triplet":
        return triplets(scorer, eps=10.0 if eps is None else eps)
    if mode not in (*EPSILON, "fixed", "local"):
        raise ValueError(f"unknown mode '{mode}'")
    if edges is None:
        leaf, _ = scorer.root()
        edges = [(u, p) for u, p in scorer.tree.postorder(leaf) if p is not None]
    until = EPSILON.get(mode) if eps is None else eps
    last = scorer.score()
    for _ in range(sweeps or (SWEEPS if mode in EPSILON else 1)):
        for u, v in edges:
            one_branch(scorer, u, v)
        now = scorer.score()
        if mode in EPSILON and now - last < until:
            return now
        last = now
    return last


def triplets(scorer: Scorer, *, eps: float = 10.0) -> float:
    """Sweeps over the inner nodes, each time over a node's three branches; a branch keeps
    its length unless the new one is at least as likely."""
    now = scorer.score()
    for _ in range(SWEEPS):
        start = now
        for u, _ in scorer.tree.postorder(scorer.root()[0]):
            if len(scorer.tree.adj[u]) == 3:
                for x in sorted(scorer.tree.adj[u]):
                    _climb(scorer, u, x)
        now = scorer.score()
        if now - start < eps:
            break
    return now


def _climb(scorer: Scorer, u: int, x: int) -> None:
    a, b, old = scorer.message(u, x), scorer.message(x, u), scorer.tree.adj[u][x]
    if old > 0:
        new, _ = newton(scorer.model, scorer.weights, a, b, old)
        if across(scorer.model, scorer.weights, a, b, new) > across(scorer.model, scorer.weights, a, b, old):
            scorer.set_length(u, x, new)


def prune_and_place(tree: Tree, scorer_of, u: int, v: int, *, radius: int = 10, thorough: bool = False, eps: float = 1000.0) -> list[tuple[float, int, int, int, list[float]]]:
    """Scores every move of the subtree behind u-v: (ll, near, far, distance, lengths
    [pendant, near, far]). scorer_of makes a Scorer of a tree."""
    whole = scorer_of(tree)
    moved, pendant = whole.message(v, u), tree.adj[u][v]
    a, b = tree.others(u, v)
    rest = tree.copy()
    gone = {x for x, _ in tree.walk(v, u)}
    for x in gone:
        rest.adj.pop(x)
        rest.names.pop(x, None)
    del rest.adj[u][v]
    rest.suppress(u)
    s = scorer_of(rest)
    model, w = s.model, s.weights
    out = []
    for x, y, d in tree.spr_targets(u, v, radius):
        half = rest.adj[x][y] / 2
        near, far = s.message(x, y), s.message(y, x)
        lengths = [pendant, half, half]
        if not thorough:
            ll = across(model, w, joined(model, (near, half), (far, half)), moved, pendant)
        elif d == 1:
            end = a if a in rest.adj[x] and b in rest.adj[x] and a != x else (a if x == b else b)
            mate = next(m for m in rest.adj[x] if m not in (y, end))
            ends = (moved, far), (s.message(end, x), s.message(mate, x))
            ll, t = five_branches(model, w, *ends, [half, pendant, half, rest.adj[x][end], rest.adj[x][mate]], eps=eps)
            lengths = [t[1], t[0], t[2]]
        else:
            ll, lengths = three_branches(model, w, (moved, near, far), lengths, eps=eps)
        out.append((ll, x, y, d, lengths))
    return out


def commit(tree: Tree, u: int, v: int, near: int, far: int, lengths: list[float]) -> Tree:
    """The tree after a scored move, with the move's lengths [pendant, near, far]."""
    out = tree.spr(u, v, near, far)
    for x, t in zip((v, near, far), lengths, strict=True):
        out.connect(u, x, t)
    return out
