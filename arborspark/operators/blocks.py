"""Likelihoods and branch lengths of alignments that exceed a task.

An alignment's patterns lie in blocks, rows of flat arrays (Arrow lists that NumPy reads
as they are). What one step needs of all blocks are a few sums: a branch's slope and
curvature, or a log-likelihood; each is a partial sum in the block's task and a final sum
by key. The state of the search (a row a branch) is a table too, so neither the driver
nor any task sees a whole alignment, and many branches of many alignments take their
steps together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborspark.functions import curves
from arborspark.functions.likelihood import FLOOR, Message, Scorer
from arborspark.functions.merging import Options, prepare
from arborspark.functions.models import Model
from arborspark.functions.optimize import LEAST, MOST, STEPS, SWEEPS, TOLERANCE, both_many, prune_and_place
from arborspark.functions.topology import Tree
from arborspark.storage import once, small, written

#: Patterns of a block.
BLOCK = 1024


def blocks(columns: DataFrame, size: int = BLOCK) -> DataFrame:
    """(msa_id, block, n, masks array<int>, weights array<double>) of alignment columns
    (msa_id, masks, ...): equal columns collapse, and hashes of patterns deal them to
    blocks, so no alignment is sorted or numbered. masks: pattern by pattern."""
    pats = columns.groupBy("msa_id", "masks").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    pats = once(pats)
    parts = pats.groupBy("msa_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    dealt = pats.join(small(parts), "msa_id").withColumn("block", F.pmod(F.xxhash64("masks"), F.col("parts")).cast("int"))
    listed = F.collect_list(F.struct("masks", "weight")).alias("p")  # about ``size`` patterns
    return dealt.groupBy("msa_id", "block").agg(listed).select("msa_id", "block", F.size("p").alias("n"), F.flatten("p.masks").alias("masks"), F.col("p.weight").alias("weights"))


def _floats(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _dicts(b: pa.RecordBatch, arrays: set[str]) -> Iterator[dict]:
    """A batch's rows as dicts, the named columns as NumPy arrays."""
    for i in range(b.num_rows):
        yield {n: _floats(b.column(k), i) if n in arrays else b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}


def _rows(batches: Iterator[pa.RecordBatch], work: Callable[[dict], list[tuple]], schema: pa.Schema, arrays: set[str]) -> Iterator[pa.RecordBatch]:
    """Runs ``work`` on each row."""
    for b in batches:
        for row in _dicts(b, arrays):
            out = work(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def _batch(columns: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of columns; arrays of two dimensions become lists."""
    made = [_lists(c) if np.ndim(c) == 2 else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def by_row(d: DataFrame, work: Callable[[dict], list[tuple]], schema: T.StructType, arrays: Sequence[str]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, named = to_arrow_schema(schema), set(arrays)
    return d.mapInArrow(lambda batches: _rows(batches, work, arrow, named), schema)


def _schema(keys: DataFrame, names: Sequence[str], columns: str) -> T.StructType:
    out = T.StructType([keys.schema[n] for n in names])
    for part in columns.split(","):
        name, kind = part.split()
        out = out.add(name, T.ArrayType(T.DoubleType()) if kind == "doubles" else kind)
    return out


def flat(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, float).ravel()


# -- one branch a key ------------------------------------------------------------
def sumtable(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(states, patterns): in the model's eigenbasis a pattern's likelihood at a branch of
    length t is the sum over states of these times exp(rate * t)."""
    return (model.right @ b) * ((model.left * model.pi[:, None]).T @ a)


def sumtables(parts: DataFrame, tree: Tree, taxa: Sequence[str], model: Model, u: int, v: int) -> DataFrame:
    """(msa_id, block, s, logs, weights) of the branch u-v, kept by block: the tree's messages
    are computed where a block's patterns lie, once."""

    def work(r: dict) -> list[tuple]:
        masks = r["masks"].reshape(r["n"], -1).T
        sc = Scorer(tree, dict(zip(taxa, masks, strict=True)), r["weights"], model)
        a, b = sc.message(u, v), sc.message(v, u)
        return [(r["msa_id"], r["block"], flat(sumtable(model, a[0], b[0])), flat(a[1] + b[1]), r["weights"])]

    return written(by_row(parts, work, _schema(parts, ["msa_id", "block"], "s doubles, logs doubles, weights doubles"), ["masks", "weights"]))


def evaluated(tables: DataFrame, at: DataFrame, model: Model, keys: Sequence[str], n: int = 1) -> DataFrame:
    """(keys, slope, curve, loglik: arrays with an entry a point) at ``at`` (keys, points
    array<double> of n logarithms of lengths): one partial sum a block, one final sum a
    key. Points share one reading of the tables."""

    def work(r: dict) -> list[tuple]:
        s, w, t = r["s"].reshape(model.k, -1), r["weights"], np.exp(r["points"])
        e = np.exp(np.outer(t, model.rates))
        like, first, second = np.stack([e, model.rates * e, model.rates**2 * e]) @ s
        like = np.maximum(like, FLOOR)
        first, second = first / like, second / like
        return [(*[r[k] for k in keys], first @ w, (second - first**2) @ w, (np.log(like) + r["logs"]) @ w)]

    d = tables.join(at.select(*keys, "points"), list(keys)).select(*keys, "points", "s", "logs", "weights")
    parts = by_row(d, work, _schema(tables, keys, "slope doubles, curve doubles, loglik doubles"), ["points", "s", "logs", "weights"])
    return parts.groupBy(*keys).agg(*[F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c) for c in ("slope", "curve", "loglik")])


#: Lengths tried in one reading of the tables.
POINTS = 8
#: A branch is done if its bracket has less log-likelihood than this left to gain.
GAIN = 1e-9


def newton(tables: DataFrame, start: DataFrame, model: Model, keys: Sequence[str] = ("msa_id",)) -> DataFrame:
    """(keys, t, fine): the best length of each key's branch. start: (keys, t).

    Reading the tables is what costs, so each reading tries several lengths (on a log
    scale): first the start and a grid, then a Newton step from the best length so far
    and points that divide the bracket between its neighbours. All keys step together; those
    that are done take no further part.
    """
    least, most = np.log([LEAST, MOST])
    grid = [F.lit(float(x)) for x in np.linspace(least, most, POINTS - 1)]
    x = F.log(F.least(F.greatest(F.col("t"), F.lit(LEAST)), F.lit(MOST)))
    state = once(start.select(*keys, F.array_sort(F.array(x, *grid)).alias("points"), F.lit(float(least)).alias("low"), F.lit(float(most)).alias("high")))
    done = []
    for _ in range(STEPS):
        found = evaluated(tables, small(state.select(*keys, "points")), model, keys, POINTS)
        state = once(_next(state.join(found, list(keys)), keys))
        done.append(state.where("fine").select(*keys, F.exp("x").alias("t"), "fine"))
        state = state.where("not fine")
        if state.isEmpty():
            break
    else:
        done.append(state.select(*keys, F.exp("x").alias("t"), "fine"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return once(out)


def _next(seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next points of each branch from the sums at the last ones."""
    tried = F.transform(F.arrays_zip("points", "slope", "curve", "loglik"), lambda p: F.struct(F.abs(p["slope"]).alias("steep"), p["points"].alias("x"), p["slope"].alias("slope"), p["curve"].alias("curve"), p["loglik"].alias("loglik")))
    d = seen.select(*keys, "points", "low", "high", tried.alias("tried"), F.array_max("loglik").alias("top"))
    # of lengths that are as good as the best, the one with the flattest slope
    best = F.array_min(F.filter("tried", lambda p: p["loglik"] >= F.col("top") - 1e-12 * F.abs(F.col("top"))))
    d = d.select("*", best.alias("best")).select("*", F.col("best.x").alias("x"), F.col("best.slope").alias("slope"), F.exp("best.x").alias("length"))
    rising = F.col("slope") >= TOLERANCE  # the optimum lies right of a rising point; flat tails count as falling
    below = F.array_max(F.filter("points", lambda p: p < F.col("x")))
    above = F.array_min(F.filter("points", lambda p: p > F.col("x")))
    low = F.when(rising, F.col("x")).otherwise(F.greatest("low", below))  # greatest and least skip nulls
    high = F.when(rising, F.least("high", above)).otherwise(F.col("x"))
    bend = F.col("length") * (F.col("length") * F.col("best.curve") + F.col("slope"))
    d = d.select(*keys, "x", "slope", "length", "top", low.alias("low"), high.alias("high"), bend.alias("bend"))
    step = F.when(F.col("bend") < 0, F.col("x") - F.col("length") * F.col("slope") / F.col("bend"))
    new = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
    flat_here = (F.abs("slope") < TOLERANCE) & (F.col("bend") < -TOLERANCE)
    width = F.exp("high") - F.exp("low")
    nothing_left = (width < TOLERANCE) | (F.abs("slope") * width < GAIN)
    still = F.abs(F.exp(step) - F.col("length")) < TOLERANCE
    gone = ~(F.abs("top") < float("inf"))  # not a number: the branch stays where it is
    inside = [F.col("low") + (F.col("high") - F.col("low")) * (i / (POINTS - 1)) for i in range(POINTS - 1)]
    return d.select(*keys, "x", "low", "high", F.array(new, *inside).alias("points"), F.coalesce(flat_here | nothing_left | still | gone, F.lit(False)).alias("fine"))


def followed(tables: DataFrame, start: DataFrame, model: Model, keys: Sequence[str] = ("msa_id",)) -> DataFrame:
    """(keys, t, fine): as ``newton``, by the very steps of ``optimize.newton``. A branch may have
    several optima, and where a search must end in the one that a task alone finds, its
    path must be the same, not only its goal.

    A reading also tries the points that come next where no Newton step is taken: the
    bracket's ends and the middles on the way to them.
    """
    least, most = float(np.log(LEAST)), float(np.log(MOST))

    def begin(r: dict) -> list[tuple]:
        x = float(np.log(min(max(r["t"], LEAST), MOST)))
        return [(*[r[k] for k in keys], _ahead(x, least, most), x, least, most, False, False, 0, False)]

    def work(r: dict) -> list[tuple]:
        return [(*[r[k] for k in keys], *_follow(r))]

    schema = _schema(start, keys, PATH)
    state = once(by_row(start.select(*keys, "t"), begin, schema, []))
    done = []
    while not state.isEmpty():
        found = evaluated(tables, small(state.select(*keys, "points")), model, keys, POINTS)
        state = once(by_row(state.join(found.drop("loglik"), list(keys)), work, schema, ["points", "slope", "curve"]))
        over = F.size("points") == 0
        t = F.least(F.greatest(F.exp("x"), F.lit(LEAST)), F.lit(MOST))
        done.append(state.where(over).select(*keys, t.alias("t"), "fine"))
        state = state.where(~over)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return once(out)


PATH = "points doubles, x double, low double, high double, known_low boolean, known_high boolean, steps integer, fine boolean"


def _ahead(x: float, low: float, high: float) -> list[float]:
    """x and the points that may follow it without a Newton step, ``POINTS`` in all."""
    down, up = [(x + low) / 2], [(x + high) / 2]
    for _ in range(2):
        down.append((down[-1] + low) / 2)
    up.append((up[-1] + high) / 2)
    return [x, low, high, *down, *up]


def _follow(r: dict) -> tuple:
    """The state of a branch after all steps of ``optimize.newton`` that lead to points whose
    sums are known; no points are left to try if the branch is done."""
    known = {float(p): (float(s), float(c)) for p, s, c in zip(r["points"], r["slope"], r["curve"], strict=True)}
    x, low, high, known_low, known_high, steps = (r[n] for n in ("x", "low", "high", "known_low", "known_high", "steps"))
    while x in known and steps < STEPS:
        steps += 1
        slope, curve = known[x]
        length = math.exp(x)
        bend = length * (length * curve + slope)
        if not (math.isfinite(slope) and math.isfinite(bend)):
            return [], x, low, high, known_low, known_high, steps, False
        if slope >= TOLERANCE:
            low, known_low, goal, tested = x, True, high, known_high
        else:
            high, known_high, goal, tested = x, True, low, known_low
        step = x - length * slope / bend if bend < 0 else math.nan
        new = step if min(x, goal) < step < max(x, goal) else (x + goal) / 2 if tested else goal
        if (abs(slope) < TOLERANCE and bend < -TOLERANCE) or abs(math.exp(new) - length) < TOLERANCE:
            return [], x, low, high, known_low, known_high, steps, True
        x = new
    return [] if steps >= STEPS else _ahead(x, low, high), x, low, high, known_low, known_high, steps, False


# -- moves ------------------------------------------------------------------------
MOVE = ("msa_id", "pu", "pv", "near", "far", "distance")


def spr_sums(parts: DataFrame, tree: Tree, taxa: Sequence[str], model: Model, radius: int = 10) -> DataFrame:
    """(msa_id, pu, pv, near, far, distance, ll): every SPR move at the tree's own lengths.

    A move's likelihood is a sum over patterns, so each block scores all moves for its own
    patterns, from directional messages it computes once a pruned subtree, and the sums
    of a move meet. No task holds an alignment."""

    def work(r: dict) -> list[tuple]:
        masks, w = dict(zip(taxa, r["masks"].reshape(r["n"], -1).T, strict=True)), r["weights"]
        make = lambda t: Scorer(t, masks, w, model)
        return [(r["msa_id"], u, v, x, y, d, ll) for u, v in tree.spr_points() for ll, x, y, d, _ in prune_and_place(tree, make, u, v, radius=radius)]

    columns = "pu integer, pv integer, near integer, far integer, distance integer, part double"
    found = by_row(parts, work, _schema(parts, ["msa_id"], columns), ["masks", "weights"])
    return found.groupBy(*MOVE).agg(F.sum("part").alias("ll"))


def best_moves(moves: DataFrame, k: int) -> DataFrame:
    """The k best moves of each alignment, ties by the move. The window's limit keeps the k
    best of every task before they meet, so a heap merges without holding all moves."""
    order = Window.partitionBy("msa_id").orderBy(F.desc("ll"), "pu", "pv", "near", "far")
    return moves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# -- the sweep of a merge ---------------------------------------------------------
PAIR = ("msa_id", "a", "b")
#: Blocks whose messages one task computes and keeps: the number of tasks grows with that of blocks.
TASK = 64
#: Candidate pairs up to which their lengths are sent to every task.
PAIRS = 200_000
#: Numbers of an array that are worked on at once: a megabyte stays in a core's cache.
BATCH = 1 << 17


def boundary_messages(jobs: DataFrame, parts: DataFrame, model: Model, o: Options = Options()) -> DataFrame:
    """(msa_id, block, weights and, with a_ and b_ before them, half, near, near_logs, far,
    far_logs): the messages at both ends of every edge of a side's window, edge by edge in
    flat arrays, a row a block. Neighbouring blocks of a job lie in one task.

    jobs: as for ``merge_many``. Each row joins a job's few kilobytes of trees to one block.
    """

    def work(r: dict) -> list[tuple]:
        masks = dict(zip(r["taxa"], r["masks"].reshape(r["n"], -1).T, strict=True))
        out = [r["msa_id"], r["block"], r["weights"]]
        for side in "ab":
            p = prepare(r[f"newick_{side}"], r[f"interest_{side}"], r[f"inherited_{side}"])
            s, edges = Scorer(p.core, masks, r["weights"], model), p.core.window(*p.anchor, o.window)
            out.append([p.core.adj[u][v] / 2 for u, v in edges])
            for ends in ([s.message(u, v) for u, v in edges], [s.message(v, u) for u, v in edges]):
                out += [flat(np.stack([m for m, _ in ends])), flat(np.stack([log for _, log in ends]))]
        return [tuple(out)]

    parts = once(parts)
    near = F.floor(F.col("block") / TASK)
    d = parts.join(small(jobs), "msa_id").repartition(-(-max(parts.count(), 1) // TASK), "msa_id", near).sortWithinPartitions("msa_id", "block")
    columns = ", ".join(["weights doubles", *[f"{n} doubles" for s in "ab" for n in (f"{s}_half", *_ends(s))]])
    return once(by_row(d, work, _schema(parts, ["msa_id", "block"], columns), ["masks", "weights"]))


def _ends(side: str) -> list[str]:
    return [f"{side}_{part}" for part in ("near", "near_logs", "far", "far_logs")]


ARRAYS = ["weights", *_ends("a"), *_ends("b"), "a", "b", "t", "ll"]


def _met(messages: DataFrame, live: DataFrame, few: bool) -> DataFrame:
    """Each block's messages with all live pairs (PAIR, t, ll) of its job as flat arrays; few:
    the pairs are sent to every task."""
    pairs = live.groupBy("msa_id").agg(F.collect_list(F.struct("a", "b", "t", "ll")).alias("p"))
    pairs = pairs.select("msa_id", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.flatten("p.t").alias("t"), F.col("p.ll").alias("ll"))
    return messages.join(F.broadcast(pairs) if few else pairs, "msa_id").select("msa_id", "block", *ARRAYS)


def _across(model: Model, e: list[Message], t: np.ndarray, branch: int) -> tuple[Message, Message]:
    """The messages at the two ends of one of the five branches (0: the connector) of many
    pairs; e: their four messages, t: (pairs, 5)."""
    u = lambda: both_many(model, e[0], t[:, 1], e[1], t[:, 2])
    v = lambda: both_many(model, e[2], t[:, 3], e[3], t[:, 4])
    if branch == 0:
        return u(), v()
    i = branch - 1
    mate = i ^ 1
    return both_many(model, v() if i < 2 else u(), t[:, 0], e[mate], t[:, 1 + mate]), e[i]


def _branches(model: Model, r: dict, branch: int, values: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(pairs, sum tables, logs) of a block's pairs, some at a time; values: numbers that a
    pattern of a pair takes at once."""
    n, t = len(r["weights"]), r["t"].reshape(-1, 5)
    ends = [(r[f"{s}_{part}"].reshape(-1, model.k, n), r[f"{s}_{part}_logs"].reshape(-1, n), r[s]) for s in "ab" for part in ("near", "far")]
    step = max(1, BATCH // (max(model.k, values) * max(1, n)))
    for at in range(0, len(t), step):
        some = slice(at, at + step)
        a, b = _across(model, [(m[edge[some]], logs[edge[some]]) for m, logs, edge in ends], t[some], branch)
        yield some, sumtable(model, a[0], b[0]), a[1] + b[1]


def _block_sums(model: Model, r: dict, branch: int, curve: bool) -> np.ndarray:
    """(pairs, values): a block's part of the curve of each pair's branch, if asked for, and of
    its log-likelihood at the lengths of now."""
    w, t = r["weights"], r["t"].reshape(-1, 5)[:, branch]
    out = np.empty((len(t), curves.SIZE * curve + 1))
    for some, s, logs in _branches(model, r, branch, curves.SIZE * curve):
        like = (np.exp(np.outer(t[some], model.rates))[:, None, :] @ s)[:, 0]
        out[some, -1] = (np.log(np.maximum(like, FLOOR)) + logs) @ w
        if curve:
            out[some, :-1] = curves.values(model, s, w)
    return out


def _task_sums(batches: Iterator[pa.RecordBatch], work: Callable[[dict], np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(PAIR, t, ll, sums): the sums of a job's neighbouring blocks, a row a pair."""

    def rows(job: dict, sums: np.ndarray) -> pa.RecordBatch:
        return _batch([[job["msa_id"]] * len(sums), job["a"], job["b"], job["t"].reshape(-1, 5), job["ll"], sums], schema)

    job, sums = None, None
    for b in batches:
        for r in _dicts(b, set(ARRAYS)):
            found = work(r)
            if job is not None and job["msa_id"] == r["msa_id"]:
                sums += found
                continue
            if job is not None:
                yield rows(job, sums)
            job, sums = {n: r[n] for n in ("msa_id", "a", "b", "t", "ll")}, found
    if job is not None:
        yield rows(job, sums)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """msa_id, a, b, t, ll and the whole sums, some pairs at a time, of rows in order of pairs:
    what is held is a batch and the last pair's sum."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        x = [c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            x = [np.concatenate([h, y]) for h, y in zip(held, x, strict=True)]
        at = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in x[:3]], axis=0)))
        x = [*[y[at] for y in x[:5]], np.add.reduceat(x[5], at)]
        yield [y[:-1] for y in x]
        held = [y[-1:] for y in x]
    if held is not None:
        yield held


def _summed(messages: DataFrame, live: DataFrame, few: bool, model: Model, branch: int, curve: bool, finish: Callable[..., list[np.ndarray]], columns: str) -> DataFrame:
    """(PAIR, t, columns) of the live pairs (PAIR, t, ll) from ``finish(t, ll, sums)``, in one
    reading of the messages: a task adds up a job's blocks, and the tasks' sums of a pair
    meet in one shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    part, whole = _schema(live, PAIR, "t doubles, ll double, sums doubles"), _schema(live, PAIR, f"t doubles, {columns}")
    arrow_part, arrow_whole = to_arrow_schema(part), to_arrow_schema(whole)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _task_sums(batches, lambda r: _block_sums(model, r, branch, curve), arrow_part)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *keys, t, ll, sums in _pair_sums(batches):
            if len(t):
                t, *rest = finish(t, ll, sums)
                yield _batch([*keys, t, *rest], arrow_whole)

    parts = _met(messages, live, few).mapInArrow(add, part)
    return once(parts.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(end, whole))


def _moved(messages: DataFrame, live: DataFrame, few: bool, model: Model, branch: int, share: float = curves.SHARE) -> DataFrame:
    """The live pairs (PAIR, t, ll) after the steps on one branch, all taken on the curve of its
    slope; ll, if it is not a number, becomes the likelihood before them.

    Where the curve cannot be trusted the steps are taken one reading at a time."""

    def finish(t: np.ndarray, ll: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
        found, sure = curves.best(model, sums[:, :-1], t[:, branch], share)
        t = t.copy()
        t[sure, branch] = found[sure]
        return [t, np.where(np.isnan(ll), sums[:, -1], ll), sure]

    state = _summed(messages, live, few, model, branch, True, finish, "ll double, sure boolean")
    doubt = state.where("not sure").drop("sure")
    if doubt.isEmpty():
        return state.drop("sure")

    def tables(r: dict) -> list[tuple]:
        return [(r["msa_id"], int(r["a"][i]), int(r["b"][i]), r["block"], flat(x), flat(y), r["weights"]) for some, s, logs in _branches(model, r, branch, 0) for i, x, y in zip(range(len(r["a"]))[some], s, logs, strict=True)]

    of = _schema(live, PAIR, "block integer, s doubles, logs doubles, weights doubles")
    best = followed(written(by_row(_met(messages, doubt, few), tables, of, ARRAYS)), doubt.select(*PAIR, F.col("t")[branch].alias("t")), model, PAIR)
    t = F.array(*[F.col("best") if i == branch else F.col("t")[i] for i in range(5)])
    again = doubt.join(best.select(*PAIR, F.col("t").alias("best")), list(PAIR)).select(*PAIR, t.alias("t"), "ll")
    return once(state.where("sure").drop("sure").unionByName(again))


def sweep(messages: DataFrame, model: Model, o: Options = Options(), sweeps: int = SWEEPS) -> DataFrame:
    """(msa_id, a, b, t array<double>, ll): every candidate pair of every job with its five
    branches optimised in turn, each in one reading of the messages. Pairs stop as their
    gain falls below ``eps_five``."""
    halves = messages.select("msa_id", "a_half", "b_half").distinct()
    pairs = halves.select("msa_id", F.posexplode("a_half").alias("a", "ha"), "b_half").select("msa_id", "a", "ha", F.posexplode("b_half").alias("b", "hb"))
    start = F.array(F.lit(o.connector), "ha", "ha", "hb", "hb")
    state = once(pairs.select(*PAIR, start.alias("t"), F.lit(float("nan")).alias("ll")))

    def gained(t: np.ndarray, ll: np.ndarray, sums: np.ndarray) -> list[np.ndarray]:
        return [t, sums[:, 0], sums[:, 0] - ll >= o.eps_five]

    done = []
    for _ in range(sweeps):
        few = state.limit(PAIRS + 1).count() <= PAIRS
        for branch in range(5):
            state = _moved(messages, state, few, model, branch)
        state = _summed(messages, state, few, model, 0, False, gained, "ll double, more boolean")
        done.append(state.where("not more").drop("more"))
        state = state.where("more").drop("more")
        if state.isEmpty():
            break
    out = state
    for d in done:
        out = out.unionByName(d)
    return out


def winners(pairs: DataFrame) -> DataFrame:
    """(msa_id, a, b, t, ll, n_pairs): the best pair of each job, the first of equals."""
    best = F.max_by(F.struct("a", "b", "t", "ll"), F.struct("ll", -F.col("a"), -F.col("b")))
    return pairs.groupBy("msa_id").agg(best.alias("w"), F.count(F.lit(1)).alias("n_pairs")).select("msa_id", "w.a", "w.b", "w.t", "w.ll", "n_pairs")
