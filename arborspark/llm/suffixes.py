"""Removal of repeated byte strings by a common-prefix-aware merge sort of suffixes.

A byte is removed if a ``LENGTH``-byte string that covers it also starts in a
document with a smaller id. Matches never cross documents; all is judged on the
input.

Which suffixes: every LENGTH-byte window holds the smallest hash of its 16-byte
strings at one place or more; these anchors depend on the window's bytes only, so two equal
windows share an anchor at the same offset, and only suffixes that start at
anchors (about one byte in eighteen) need be sorted. Each carries what a window
around it can hold: LENGTH bytes to the right, and the rest of a window to the left.

Communication: documents are dealt into chunks of bounded size. First, anchors'
hashes alone find which occur in more than one chunk (the distinguishing-prefix
step: a suffix that nobody shares is never sent). Then each chunk sorts its
shared suffixes, resolves equal ones locally, and sends the rest as front-coded
runs: the length of the prefix shared with the run's previous suffix, and the
bytes after it. Runs are merged by loser trees that keep, for each loser, the prefix
it shares with the winner it lost to, so known prefixes are never compared again.
A chunk deals its suffixes to at most FAN parts by hash of the anchor. Where there are more than
FAN chunks, the runs of FAN chunks are merged first and each part is dealt to FAN finer ones,
and so on (a merge sort of several passes): blocks grow in proportion to the chunks.
The merged order and its common prefixes give, for each suffix, how far windows
can reach to the right; the few windows this leaves are looked up in groups of one
anchor, by content, never as pairs.

Skew: a passage in a third of all documents is one suffix a chunk, whatever the
number of copies. All steps are shuffles by hash; a lost executor's part is
computed again from its inputs.

Cases: null and empty texts have no bytes and nothing removed; a null id counts as
larger than all others, and rows with equal ids never remove each other's bytes;
repeated rows are treated alike; very long texts are walked in blocks; an
empty table gives an empty result; extra columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, col

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
WIDTH = LENGTH + LEFT
CHUNK = 8 << 20
STEP = 1 << 19
NO_ID = (1 << 63) - 1
#: Parts into which a step deals its suffixes or hashes, and runs that one merge takes: each
#: step makes at most FAN blocks for each one it reads, whatever the number of chunks.
FAN = 128


def _slide(a: np.ndarray, width: int, f: np.ufunc, ahead: bool) -> np.ndarray:
    """f over a[i : i + width] (ahead) or a[i - width + 1 : i + 1], cut at the ends."""
    out, span = a.copy(), 1
    while span < width:
        by = min(span, width - span)
        if ahead:
            out[:-by] = f(out[:-by], out[by:])
        else:
            out[by:] = f(out[by:], out[:-by].copy())
        span += by
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents laid end to end. ends: where
    each document ends. Works in blocks, so temporary memory is bounded."""
    places, hashes = [], []
    margin = LENGTH
    for start in range(0, len(data), STEP):
        lo, hi = max(0, start - margin), min(len(data), start + STEP + margin)
        at = np.arange(lo, hi)
        end = ends[np.searchsorted(ends, at, side="right")]
        h = np.append(gram_hashes(data[lo:hi]), np.zeros(min(GRAM - 1, hi - lo), np.uint64))  # none for the last bytes
        whole = at + LENGTH <= end
        low = np.where(whole, _slide(h, WINDOW, np.minimum, True), np.uint64(0))
        take = (_slide(low, WINDOW, np.maximum, False) == h) & (at + GRAM <= end)
        take[: start - lo] = False
        take[start - lo + STEP :] = False
        at = np.flatnonzero(take)
        places.append(at + lo)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Odd hashes of the GRAM-byte strings along the last axis."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    span = 1
    while span < GRAM:
        a, b = h[..., :-span], h[..., span:]
        h = (a * np.uint64(0xD6E8FEB86659FD93 ** span & (1 << 64) - 1)) ^ (b + (b >> np.uint64(31)))
        span *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


class Chunk:
    """Documents of one chunk, in an order that recomputation repeats."""

    def __init__(self, table: pa.Table) -> None:
        ids = [NO_ID if i is None else i for i in table.column("doc_id").to_pylist()]
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.order = order
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.places, self.hashes = anchors(self.data, self.ends)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as compressed differences, byte plane by byte plane."""
    step = np.diff(h, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_hashes(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash, of so many; a part of n is parts p, p + n, ... of a multiple."""
    return ((h >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)


def _split(h: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The parts that occur, and each one's (sorted) hashes packed."""
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    return found, [pack_hashes(x) for x in np.split(h[order], first[1:])] if len(h) else []


def _blocks(part: np.ndarray, node, blocks: list[bytes]) -> pa.Table:
    nodes = np.broadcast_to(np.asarray(node, np.int64), len(blocks))
    return pa.table({"part": pa.array(part, pa.int64()), "node": pa.array(nodes, pa.int64()), "block": pa.array(blocks, pa.binary())})


BLOCKS = "part long, node long, block binary"


def _first(table: pa.Table, name: str) -> int:
    return table.column(name)[0].as_py() if len(table) else 0


def _seen(fan: int):
    """BLOCKS: the distinct anchor hashes of a chunk (the node), by part."""

    def run(table: pa.Table) -> pa.Table:
        h = np.unique(Chunk(table).hashes)
        found, blocks = _split(h, parts_of(h, fan))
        return _blocks(found, _first(table, "chunk"), blocks)

    return run


def _owned(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of a table of BLOCKS, sorted, the place of each one's block, and the nodes."""
    held = [unpack_hashes(b) for b in table.column("block").to_pylist()]
    h = np.concatenate([*held, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
    order = np.argsort(h, kind="stable")
    return h[order], owner[order], np.array(table.column("node").to_pylist(), np.int64)


def _twice(h: np.ndarray) -> np.ndarray:
    same = h[1:] == h[:-1]
    out = np.zeros(len(h), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _answer(part: int, h: np.ndarray, owner: np.ndarray, nodes: np.ndarray) -> pa.Table:
    found, blocks = _split(h, owner)
    return _blocks(np.full(len(found), part), nodes[found] if len(found) else 0, blocks)


def _shared(table: pa.Table) -> pa.Table:
    """BLOCKS: of a part's hashes, for each node those that others have too."""
    h, owner, nodes = _owned(table)
    keep = _twice(h)
    return _answer(_first(table, "part"), h[keep], owner[keep], nodes)


def _union(fan: int, parts: int):
    """BLOCKS of finer parts: the distinct hashes of ``fan`` nodes as one node's."""

    def run(table: pa.Table) -> pa.Table:
        h = np.unique(_owned(table)[0])
        found, blocks = _split(h, parts_of(h, parts * fan))
        return _blocks(found, _first(table, "node") // fan, blocks)

    return run


def _pass_on(table: pa.Table, answers: pa.Table) -> pa.Table:
    """BLOCKS: for each of FAN nodes its hashes that another of them has, or another group."""
    h, owner, nodes = _owned(table)
    far = np.sort(_owned(answers)[0])
    keep = _twice(h)
    if len(far):
        keep |= far[np.minimum(np.searchsorted(far, h), len(far) - 1)] == h
    return _answer(_first(table, "part"), h[keep], owner[keep], nodes)


def exchange(rows: DataFrame, nodes: int, fan: int, parts: int) -> DataFrame:
    """BLOCKS -> BLOCKS: the hashes that more than one node has, back to each of them. With
    more than ``fan`` nodes, groups of them ask first among themselves, then as one node."""
    if nodes <= fan:
        return rows.groupBy("part").applyInArrow(_shared, BLOCKS)
    rows = rows.withColumn("group", F.floor(F.col("node") / fan))
    up = rows.groupBy("part", "group").applyInArrow(_union(fan, parts), BLOCKS)
    down = exchange(up, blocks_for(nodes, fan), fan, parts * fan).withColumns({"part": F.pmod("part", F.lit(parts)), "group": F.col("node")})
    return rows.groupBy("part", "group").cogroup(down.groupBy("part", "group")).applyInArrow(_pass_on, BLOCKS)


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, WIDTH) bytes: LENGTH to the right, then LEFT backwards to the left, zeros
    beyond the document; and how many of either are real."""
    right = np.minimum(LENGTH, ends - places).astype(np.uint8)
    left = np.minimum(LEFT, places - starts).astype(np.uint8)
    out = np.zeros((len(places), WIDTH), np.uint8)
    if not len(places):
        return out, right, left
    most = len(data) - 1
    for j in range(LENGTH):
        np.multiply(data[np.minimum(places + j, most)], right > j, out=out[:, j], casting="unsafe")
    for j in range(LEFT):
        np.multiply(data[np.maximum(places - 1 - j, 0)], left > j, out=out[:, LENGTH + j], casting="unsafe")
    return out, right, left


def front_code(m: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(common prefix with the row before, the bytes after it) of sorted rows."""
    lcp = np.zeros(len(m), np.uint8)
    differ = m[1:] != m[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return lcp, m[np.arange(m.shape[1]) >= lcp[:, None]].tobytes()


def pack(m: np.ndarray, right: np.ndarray, left: np.ndarray, ids: np.ndarray, counts: np.ndarray, chunks: np.ndarray, docs: np.ndarray, places: np.ndarray) -> bytes:
    """A run as one compressed block. counts: occurrences (chunks, docs, places) of each row."""
    lcp, tails = front_code(m)
    n = np.array([len(m), len(docs)], np.int64)
    parts = [n, lcp, right, left, ids.astype(np.int64), *(x.astype(np.int32) for x in (counts, chunks, docs, places))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([p.tobytes() for p in parts] + [tails]))


class Run:
    """A front-coded run, decoded as it is read."""

    def __init__(self, block: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n, k = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16
        fields = []
        for kind, size in (("u1", n), ("u1", n), ("u1", n), ("<i8", n), ("<i4", n), ("<i4", k), ("<i4", k), ("<i4", k)):
            fields.append(np.frombuffer(raw, kind, size, at))
            at += fields[-1].nbytes
        self.lcp, self.right, self.left, self.ids = (f.tolist() for f in fields[:4])
        self.first = np.concatenate([[0], np.cumsum(fields[4])]).tolist()
        self.chunks, self.docs, self.places = fields[5:]
        self.tails, self.cut, self.n, self.i = raw, at, n, -1
        self.key = b""

    def step(self) -> bool:
        self.i += 1
        if self.i >= self.n:
            return False
        lcp = self.lcp[self.i]
        end = self.cut + WIDTH - lcp
        self.key = self.key[:lcp] + self.tails[self.cut : end]
        self.cut = end
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, Run, int]]:
    """(prefix shared with the suffix before, suffix, run, row) in sorted order.

    A loser tree: inner nodes hold (run, prefix it shares with the winner that beat
    it). On the way up, of two runs the one that shares more with the last output is
    smaller without a look at its bytes; only if both share the same do they compare,
    from there on.
    """
    runs = [r for r in runs if r.step()]
    k = len(runs)
    if not k:
        return
    size = 1
    while size < k:
        size *= 2
    keys: list[bytes | None] = [r.key for r in runs] + [None] * (size - k)
    nodes = [(-1, 0)] * size

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        a, b = build(2 * node), build(2 * node + 1)
        winner, loser = play(a, b)
        nodes[node] = loser
        return winner

    def play(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        x, y = keys[a[0]], keys[b[0]]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h = a[1]
        if h != b[1]:
            return (a, b) if h > b[1] else (b, a)
        if x[h:] == y[h:]:
            return a, (b[0], WIDTH)
        while x[h] == y[h]:
            h += 1
        return (a, (b[0], h)) if x[h] < y[h] else (b, (a[0], h))

    top, shared = build(1) if size > 1 else (0, 0)
    while keys[top] is not None:
        run = runs[top]
        yield shared, keys[top], run, run.i
        if run.step():
            keys[top] = run.key
            now = (top, run.lcp[run.i])
        else:
            keys[top] = None
            now = (top, -1)
        node = (top + size) // 2
        while node:
            x, y = keys[now[0]], keys[nodes[node][0]]
            if y is not None:
                other = nodes[node]
                if x is None or other[1] > now[1]:
                    nodes[node], now = now, other
                elif other[1] == now[1]:
                    now, nodes[node] = play(now, other)
            node //= 2
        top, shared = now


def covered(group: list[tuple[int, bytes, Run, int]]) -> Iterator[tuple[Run, int, int, int]]:
    """(run, row, bytes to the left, bytes to the right) that earlier documents cover
    around the suffixes of one anchor. group: as merged, sharing GRAM bytes or more."""
    # equal contexts together: the earliest document stands for them
    unique: list[list] = []  # key, right, left, id, members, prefix shared with the one before
    for shared, key, run, i in group:
        r, e = run.right[i], run.left[i]
        if shared == WIDTH and unique and unique[-1][1:3] == [r, e]:
            u = unique[-1]
            u[3] = min(u[3], run.ids[i])
            u[4].append((run, i))
        else:
            unique.append([key, r, e, run.ids[i], [(run, i)], min(shared, LENGTH)])
    for _, r, e, least, members, _ in unique:
        if r + e >= LENGTH and len(members) > 1:
            yield from ((run, i, e, r) for run, i in members if run.ids[i] > least)
    if len(unique) == 1:
        return
    # how far right a window can reach: what is shared with a neighbour in the order
    n = len(unique)
    reach = [min(u[1], max(u[5] if j else 0, unique[j + 1][5] if j + 1 < n else 0)) for j, u in enumerate(unique)]
    least_of: dict[tuple[int, bytes], int] = {}
    asked = []
    for u, most in zip(unique, reach, strict=True):
        key, _, e, doc, members, _ = u
        # windows with ``a`` bytes to the left need LENGTH - a to the right
        windows = [(a, key[: LENGTH - a] + key[LENGTH : LENGTH + a]) for a in range(LENGTH - most, e + 1)]
        asked.append(windows)
        for w in windows:
            if least_of.get(w, doc) >= doc:
                least_of[w] = doc
    for u, windows in zip(unique, asked, strict=True):
        doc = u[3]
        hits = [a for a, w in windows if least_of[(a, w)] < doc]
        for lo, hi in _runs(hits):
            yield from ((run, i, hi, LENGTH - lo) for run, i in u[4] if run.ids[i] == doc)


def _runs(hits: list[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of the maximal runs of consecutive numbers."""
    at = 0
    for j in range(1, len(hits) + 1):
        if j == len(hits) or hits[j] != hits[j - 1] + 1:
            yield hits[at], hits[j - 1]
            at = j


SPANS = "chunk int, row int, at int, upto int"


def _spans(chunk: np.ndarray, row: np.ndarray, at: np.ndarray, upto: np.ndarray) -> pa.Table:
    return pa.table({n: pa.array(np.asarray(v), pa.int32()) for n, v in zip(("chunk", "row", "at", "upto"), (chunk, row, at, upto), strict=True)})


def _send(fan: int):
    """BLOCKS of a chunk's shared suffixes, and as part -1 the spans that the chunk
    resolves by itself."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        c = Chunk(docs)
        out: list[tuple[int, bytes]] = []
        chunk = _first(docs, "chunk")
        order = np.argsort(c.hashes, kind="stable")
        h = c.hashes[order]
        doc = c.documents(c.places[order])
        # hashes that other chunks have, or several documents of this one
        far = np.sort(np.concatenate([*map(unpack_hashes, shared.column("block").to_pylist()), np.zeros(0, np.uint64)]))
        wanted = np.zeros(len(h), bool)
        if len(far):
            at = np.minimum(np.searchsorted(far, h), len(far) - 1)
            wanted = far[at] == h
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(first, len(h)))
            ids = c.ids[doc]
            several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
            wanted |= np.repeat(several, size)
        place, h, doc = c.places[order][wanted], h[wanted], doc[wanted]
        m, right, left = contexts(c.data, c.starts[doc], c.ends[doc], place)
        bucket = parts_of(h, fan)
        by = np.argsort(np.ascontiguousarray(m).view(f"S{WIDTH}").ravel(), kind="stable")
        by = by[np.argsort(bucket[by], kind="stable")]
        place, doc, bucket, m, right, left = place[by], doc[by], bucket[by], m[by], right[by], left[by]
        local: list[np.ndarray] = []
        if len(by):
            new = np.concatenate([[True], (m[1:] != m[:-1]).any(1) | (right[1:] != right[:-1]) | (left[1:] != left[:-1]) | (bucket[1:] != bucket[:-1])])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            ids = c.ids[doc]
            least = np.minimum.reduceat(ids, first)
            later = (ids > least[group]) & (right.astype(int) + left >= LENGTH)
            local.append(np.stack([doc[later], place[later] - c.starts[doc[later]] - left[later], place[later] - c.starts[doc[later]] + right[later]]))
            stays = ids == least[group]
            counts = np.add.reduceat(stays.astype(np.int32), first)
            edges = np.flatnonzero(np.concatenate([[True], bucket[first][1:] != bucket[first][:-1]]))
            kept_docs, kept_places = doc[stays], (place - c.starts[doc])[stays]
            upto = np.concatenate([[0], np.cumsum(counts)])
            for lo, hi in zip(edges, np.append(edges[1:], len(first)), strict=True):
                rows = first[lo:hi]
                a, b = upto[lo], upto[hi]
                out.append((int(bucket[rows[0]]), pack(m[rows], right[rows], left[rows], least[lo:hi], counts[lo:hi], np.full(b - a, chunk), kept_docs[a:b], kept_places[a:b])))
        if local and local[0].shape[1]:
            out.append((-1, np.vstack([np.full(local[0].shape[1], chunk), local[0]]).astype(np.int32).tobytes()))
        return _blocks(np.array([b for b, _ in out], np.int64), chunk, [b for _, b in out])

    return run


def _remerge(fan: int, parts: int):
    """BLOCKS of finer parts: the runs of ``fan`` nodes merged into one run for each; of equal
    contexts the earliest document goes on, and the others are resolved (part -1)."""

    def run(table: pa.Table) -> pa.Table:
        if _first(table, "part") < 0:
            return table.select(["part", "node", "block"])
        node = _first(table, "node") // fan
        rows: list[tuple[bytes, int, int, int, Run, int]] = []  # context, right, left, id, and an occurrence
        members: list[list[tuple[Run, int]]] = []
        for shared, key, r, i in merge([Run(b) for b in table.column("block").to_pylist()]):
            what = (key, r.right[i], r.left[i])
            if shared == WIDTH and rows and rows[-1][1:3] == what[1:]:
                rows[-1] = (*what, min(rows[-1][3], r.ids[i]))
                members[-1].append((r, i))
            else:
                rows.append((*what, r.ids[i]))
                members.append([(r, i)])
        spans: list[np.ndarray] = []
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(rows), np.int64)
        for j, ((_, right, left, least), own) in enumerate(zip(rows, members, strict=True)):
            for r, i in own:
                a, b = r.first[i], r.first[i + 1]
                if r.ids[i] == least:
                    kept.append((r.chunks[a:b], r.docs[a:b], r.places[a:b]))
                    counts[j] += b - a
                elif right + left >= LENGTH:
                    spans.append(np.stack([r.chunks[a:b], r.docs[a:b], r.places[a:b] - left, r.places[a:b] + right]))
        if not rows:
            return _blocks(np.zeros(0), node, [])
        m = np.frombuffer(b"".join(x[0] for x in rows), np.uint8).reshape(-1, WIDTH)
        right, left, ids = (np.array([x[k] for x in rows]) for k in (1, 2, 3))
        part = parts_of(gram_hashes(m[:, :GRAM])[:, 0], parts * fan)
        flat = [np.concatenate(x) for x in zip(*kept, strict=True)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        found, blocks = np.unique(part), []
        for p in found.tolist():
            at = np.flatnonzero(part == p)
            of = np.concatenate([np.arange(upto[k], upto[k + 1]) for k in at])
            blocks.append(pack(m[at], right[at].astype(np.uint8), left[at].astype(np.uint8), ids[at], counts[at], *(x[of] for x in flat)))
        if spans:
            found, blocks = np.append(found, -1), [*blocks, np.hstack(spans).astype(np.int32).tobytes()]
        return _blocks(found, node, blocks)

    return run


def spans_of(rows: DataFrame, nodes: int, fan: int, parts: int) -> DataFrame:
    """SPANS of BLOCKS of runs, in as many merge passes as it takes for a part to hold
    ``fan`` runs at most. Resolved spans (part -1) go along, a node's together."""
    group = lambda of: F.when(F.col("part") < 0, F.col("node")).otherwise(of).alias("group")
    while nodes > fan:
        rows = rows.groupBy("part", group(F.floor(F.col("node") / fan))).applyInArrow(_remerge(fan, parts), BLOCKS)
        nodes, parts = blocks_for(nodes, fan), parts * fan
    return rows.groupBy("part", group(F.lit(0))).applyInArrow(_merge_part, SPANS)


def _merge_part(table: pa.Table) -> pa.Table:
    """Spans that one part's merged suffixes remove."""
    blocks = table.column("block").to_pylist()
    if blocks and _first(table, "part") < 0:
        return _spans(*np.hstack([np.frombuffer(b, np.int32).reshape(4, -1) for b in blocks]))
    found: list[tuple[int, int, int, int]] = []
    group: list[tuple[int, bytes, Run, int]] = []

    def close() -> None:
        if len(group) > 1:
            for run, i, left, right in covered(group):
                a, b = run.first[i], run.first[i + 1]
                found.extend((c, d, p - left, p + right) for c, d, p in zip(run.chunks[a:b].tolist(), run.docs[a:b].tolist(), run.places[a:b].tolist(), strict=True))
        group.clear()

    for item in merge([Run(b) for b in blocks]):
        if item[0] < GRAM:
            close()
        group.append(item)
    close()
    return _spans(*(np.array(found, np.int64).reshape(-1, 4).T))


KEPT = "doc_id long, n_bytes long, spans array<struct<at:int,upto:int>>, kept binary"


def _apply(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Each document without the union of its spans."""
    ids = [None if i is None else i for i in docs.column("doc_id").to_pylist()]
    texts = [(t or "").encode() for t in docs.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
    row, at, upto = (spans.column(n).to_numpy() for n in ("row", "at", "upto"))
    by = np.lexsort((at, row))
    row, at, upto = row[by], at[by], upto[by]
    cuts = np.searchsorted(row, np.arange(len(order) + 1)).tolist()
    rows = []
    for k, i in enumerate(order):
        union: list[list[int]] = []
        for a, b in zip(at[cuts[k] : cuts[k + 1]].tolist(), upto[cuts[k] : cuts[k + 1]].tolist(), strict=True):
            if union and a <= union[-1][1]:
                union[-1][1] = max(union[-1][1], b)
            else:
                union.append([a, b])
        edge = [0, *[x for u in union for x in u], len(texts[i])]
        kept = b"".join(texts[i][a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
        rows.append((ids[i], len(texts[i]), [{"at": a, "upto": b} for a, b in union], kept))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("at", pa.int32()), ("upto", pa.int32())])), pa.binary())
    return pa.table({n: pa.array([r[j] for r in rows], kind) for j, (n, kind) in enumerate(zip(("doc_id", "n_bytes", "spans", "kept"), kinds, strict=True))})


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, chunk_bytes: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<at, upto>>, kept binary): one row a document;
    spans are the maximal removed runs in bytes, kept what remains."""
    total = docs.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    chunks = blocks_for(total, chunk_bytes)
    d = docs.select(F.pmod(F.xxhash64(col(doc_id), F.when(col(doc_id).isNull(), F.xxhash64(col(text)))), F.lit(chunks)).cast("int").alias("chunk"), col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    by_chunk = d.groupBy("chunk")
    spans = spans_of(_sent(by_chunk, chunks, fan), chunks, fan, fan)
    return by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(_apply, KEPT)


def _sent(by_chunk, chunks: int, fan: int) -> DataFrame:
    """BLOCKS of the chunks' runs and resolved spans."""
    shared = exchange(by_chunk.applyInArrow(_seen(fan), BLOCKS), chunks, fan, fan).withColumn("chunk", F.col("node").cast("int"))
    return by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_send(fan), BLOCKS)
