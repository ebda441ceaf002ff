"""SimHash near-duplicates through BK-trees over shards.

A fingerprint holds, for each bit, the majority vote of the XXH64 values of a
document's word shingles. Documents with equal fingerprints are one node; nodes
within ``radius`` differing bits are linked, and components follow the links.

Shards: the bits are cut into ``radius + extra`` blocks; two fingerprints within
the radius agree in at least ``extra`` whole blocks (pigeonhole), so each node
goes to one shard for each choice of ``extra`` blocks, keyed by their bits. How
many blocks are fixed grows with the number of nodes, so shards stay small
whatever the size, and no link is lost. For wide radii the shards are random
bands of bits instead, as many as a stated recall needs. In a shard the nodes form a BK-tree:
children hang under the integer Hamming distance to their parent, and a search
follows only edges within ``distance ± radius``.

Hot shards (many nodes that agree in a key) are cut into salted blocks: one tree a
block, sent to every block of the shard (each pair of blocks meets in one task of
bounded size). Tasks report a spanning forest of the links they find, at most one
edge a node, so neither dense groups nor copies are expanded into pairs. Trees go
to the tasks as rows of the shuffle, not as one broadcast: their total size
isn't bounded.

``keep_one`` links by Jaccard similarity: trees of wide fingerprints, sharded by random
bands of bits, propose groups, and the sets of shingles decide each pair of a group.

Cases: null and empty texts have fingerprint zero and link like any other; rows
without doc_id take part with an id after all others (null); repeated rows share
a node; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut, fresh, if_small
from .components import components

SEED = 42
BLOCK = 1 << 16
#: Nodes of a salted block; a task holds two blocks at most.
SHARD = 2048


def _shingles(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words joined, and where its shingles start and end."""
    w = (text or "").encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not w:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(w))
    return b" ".join(w), starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' XXH64 values, ascending."""
    joined, first, last = _shingles(text, shingle)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64))


def set_fingerprint(text: str | None, shingle: int, words: int) -> bytes:
    """Fingerprint in which each distinct shingle votes once, followed by 64 bits of
    hash of the whole set: equal values mean equal sets."""
    h = shingle_set(text, shingle)
    votes = [_set_bits(_mix(h, part) if part else h) if len(h) else np.zeros(64, np.int64) for part in range(words)]
    return np.packbits(2 * np.concatenate(votes) > len(h)).tobytes() + xxhash.xxh64_digest(h.tobytes(), SEED)


def fingerprint(text: str | None, shingle: int, words: int = 1) -> bytes:
    """Big-endian fingerprint of ``words`` * 64 bits. The further 64-bit parts come
    from the hash mixed with odd constants (splitmix64 finalisers)."""
    joined, first, last = _shingles(text, shingle)
    if not first:
        return bytes(8 * words)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64 * words, np.int64)
    for at in range(0, len(first), BLOCK):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)), np.uint64)
        for part in range(words):
            x = h if not part else _mix(h, part)
            votes[64 * part : 64 * part + 64] += _set_bits(x)
    return np.packbits(2 * votes > len(first)).tobytes()


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, from the highest. Eight counters of
    eight bits are added at once, in runs too short for them to overflow."""
    lanes = np.unpackbits(h.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
    runs = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return runs.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)


def _mix(h: np.ndarray, part: int) -> np.ndarray:
    x = h + np.uint64(part * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, text: str = "text", *, shingle: int = 5, words: int = 1, keep: list[str] | None = None, make=fingerprint) -> DataFrame:
    """docs (or the columns ``keep``) plus ``fingerprint`` binary."""
    d = docs.select(*[col(c) for c in (keep if keep is not None else docs.columns)], col(text).alias("\0text"))
    (name,) = fresh(d, "fingerprint")
    schema = T.StructType([*d.schema.fields[:-1], T.StructField(name, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([make(t.as_py(), shingle, words) for t in b.column(b.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], name])

    return d.mapInArrow(run, schema)


class BKTree:
    """Nodes of integers; children keyed by the Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.visited = 0

    def add(self, value: int) -> int:
        """The node of the value; equal values share one."""
        new, at = len(self.values), 0
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            at = self.children[at].setdefault(d, new)
        self.values.append(value)
        self.children.append({})
        return new

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Nodes within the radius: only edges that can lead to one are followed."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            self.visited += 1
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            low, high = d - radius, d + radius
            stack.extend([child for edge, child in self.children[at].items() if low <= edge <= high])


def forest(tree_values: list[int], queries: list[int], radius: int, tail: int = 0) -> list[tuple[int, int]]:
    """Spanning forest of the links between the tree's values and the queries and
    among the tree's values: (tree value, other value) pairs. The last ``tail`` bits of a
    value only tell it from others; they are no part of distances."""
    tree, parent, out = BKTree(), {}, []
    known: list[list[int]] = []  # values of each node of the tree

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(value: int) -> None:
        own = root(value)
        for at in tree.within(value >> tail, radius):
            for other in known[at]:
                a = root(other)
                if a != own:
                    parent[a] = own
                    out.append((other, value))

    for v in tree_values:
        link(v)
        at = tree.add(v >> tail)
        if at == len(known):
            known.append([])
        known[at].append(v)
    for v in queries:
        link(v)
    return out


def choose_blocks(n_nodes: int, bits: int, radius: int, per_shard: int = 256) -> int:
    """``extra``: how many of radius + extra blocks two near values must share, so
    that evenly spread values give shards of at most ``per_shard`` nodes."""
    extra = 1
    while extra < 4 and n_nodes / 2 ** (bits * extra // (radius + extra)) > per_shard:
        extra += 1
    return extra


def links(nodes: DataFrame, *, bits: int, radius: int, bands: list[list[int]] | None = None) -> DataFrame:
    """Links between distinct fingerprints: nodes (fingerprint) -> (a, b) binary."""
    return _sharded(nodes, bits, radius, bands).mapInArrow(_searcher(bits, radius), "a binary, b binary")


def _sharded(nodes: DataFrame, bits: int, radius: int, bands: list[list[int]] | None) -> DataFrame:
    """The nodes (fingerprint) dealt to pairs of blocks of shards, a pair's rows together.

    bands: lists of bit positions to shard by instead of the pigeonhole blocks (for
    radii at which these would be too short); then near pairs that agree in no
    band are missed, with a probability that the caller has chosen.
    """
    if bands is None:
        extra = choose_blocks(nodes.count(), bits, radius)
        edges = np.linspace(0, bits, radius + extra + 1).round().astype(int)
        blocks = [list(range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        bands = [sum(c, []) for c in combinations(blocks, extra)]
    masks = [np.packbits(np.isin(np.arange(bits), b)) for b in bands]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                prints = b.column(0).to_pylist()
                m = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)[:, : bits // 8]
                for i, mask in enumerate(masks):
                    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for row in m & mask]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0)], ["shard", "fingerprint"])

    rows = nodes.select("fingerprint").mapInArrow(shards, "shard long, fingerprint binary")
    counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(counts, "shard")  # loners have no partner
    n_blocks = F.ceil(F.col("n") / F.lit(SHARD)).cast("int")
    rows = rows.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("blocks")).cast("int"))
    # each block meets every block of its shard once: pair (low, high)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fingerprint")

    return rows.repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high")


def _searcher(bits: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, size = None, ([], []), bits // 8
        out: list[tuple[int, int]] = []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for shard, low, high, block, print_ in zip(*cols, strict=True):
                if (shard, low, high) != key:
                    out += forest(*own, radius, 8 * size - bits)
                    key, own, size = (shard, low, high), ([], []), len(print_)
                own[block != low].append(int.from_bytes(print_, "big"))
            if len(out) > 10_000:
                yield _pairs(out, size)
                out = []
        out += forest(*own, radius, 8 * size - bits)
        yield _pairs(out, size)

    return run


def _pairs(out: list[tuple[int, int]], size: int) -> pa.RecordBatch:
    cols = [pa.array([p[i].to_bytes(size, "big") for p in out], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(cols, ["a", "b"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, shingle: int = 5, words: int = 1, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint binary, component_id): one row a document. component_id
    is the smallest id reachable over the links, null only if all are null."""
    d = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    prints = cut(fingerprints(d, shingle=shingle, words=words, keep=["doc_id"]))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    labels = components(nodes, links(nodes, bits=64 * words, radius=radius))
    return prints.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _texts(nodes: DataFrame, docs: DataFrame, every: DataFrame) -> DataFrame:
    """(whole, fingerprint, text) of the nodes that share a candidate component; only
    their texts move, once."""
    # a table of its own, so that a component with many members is joined where they lie
    shared = if_small(cut(every.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("whole")))
    of = nodes.join(every.join(shared, "whole"), "fingerprint").select("whole", "fingerprint", F.col("of.k1").alias("k1"), F.col("of.k2").alias("k2"))
    return cut(docs.select("k1", "k2", "text").join(if_small(cut(of)), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("whole", "fingerprint", "text"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share (a square matrix). Elements that few
    sets hold are counted pair by pair, the others by products of 0/1 matrices."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, element, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    order = np.argsort(element, kind="stable")
    row, df = row[order], times[element[order]]
    out = np.zeros(n * n, np.int64)
    for d in np.unique(df[(df > 1) & (df <= FEW)]).tolist():
        of = row[df == d].reshape(-1, d)
        for i, j in combinations(range(d), 2):
            out += np.bincount(of[:, i] * n + of[:, j], minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    row, column = row[df > FEW], np.cumsum(np.diff(element[order][df > FEW], prepend=-1) > 0) - 1
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _linker(shingle: int, similarity: float):
    """Spanning forests of the pairs of similar texts in each group of rows (whole, u, v,
    fingerprint, side, text): of all its pairs if all rows are of one side, else of
    those between the sides."""

    def solve(held: list[tuple[bytes, bool, np.ndarray]]) -> list[tuple[bytes, bytes]]:
        if len(held) < 2:
            return []
        size, side = np.array([len(h[2]) for h in held]), np.array([h[1] for h in held])
        common = overlaps([h[2] for h in held])
        good = np.triu(common >= similarity * (size[:, None] + size - common) - 1e-9, 1)
        if side.any():
            good &= (side[:, None] | side) & ~(side[:, None] & side)
        parent, out = list(range(len(held))), []
        for i, j in np.argwhere(good).tolist():
            a, b = _root(parent, i), _root(parent, j)
            if a != b and held[i][0] != held[j][0]:
                parent[a] = b
                out.append((held[i][0], held[j][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for *now, print_, side, text in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if now != key:
                    out += solve(held)
                    key, held = now, []
                held.append((print_, side, shingle_set(text, shingle)))
        out += solve(held)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    return run


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


#: Texts of a block that is compared in one task: so many, or of so many bytes.
TEXTS, BYTES = 512, 8 << 20
#: Texts of a large component that every block of it meets.
PIVOTS = 64
#: Elements in so many sets are counted pair by pair; columns of a 0/1 matrix.
FEW, COLUMNS = 16, 4096


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / TEXTS), F.ceil(size / BYTES), F.lit(1)).cast("int")


def _similar(nodes: DataFrame, docs: DataFrame, bits: int, shingle: int, radius: int, similarity: float) -> DataFrame:
    """Components of the nodes (fingerprint, rep, of) by verified links.

    Fingerprints give candidate components; the texts of one meet in one task, where all
    its pairs are verified. A component of more texts than fit one task is cut into
    blocks, each verified within itself and against some pivots of the component,
    which joins nearly all that belong together; then only the texts outside its largest
    verified class meet the blocks again. So a dense group of any size costs a pass or
    two over its texts, and no pair of texts that could change a class is left out.
    """
    first = cut(links(nodes, bits=bits, radius=radius, bands=bands_for(nodes.count(), bits, similarity)))
    every = cut(components(nodes, first).select("fingerprint", F.col("root").alias("whole")))
    texts = _texts(nodes, docs, every)
    narrow = cut(texts.select("whole", "fingerprint", F.octet_length("text").alias("size")))
    blocks = if_small(cut(narrow.groupBy("whole").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks")).where("blocks > 1")))
    some = lambda seed, n: F.pmod(F.xxhash64("fingerprint", F.lit(seed)), n).cast("int")
    place = lambda u, v, side: F.struct(u.alias("u"), v.alias("v"), F.lit(side).alias("side"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)

    def linked(route: DataFrame) -> DataFrame:
        """Links found where the texts meet; route: (fingerprint, to array<u, v, side>)."""
        rows = texts.join(if_small(route.select("fingerprint", "to")), "fingerprint").withColumn("to", F.explode("to"))
        rows = rows.select("whole", "to.u", "to.v", "fingerprint", "to.side", "text").repartition("whole", "u", "v")
        return cut(rows.sortWithinPartitions("whole", "u", "v").mapInArrow(_linker(shingle, similarity), "a binary, b binary"))

    dealt = narrow.join(blocks, "whole", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    pivot = (F.col("blocks") > 1) & (some(4, F.col("blocks") * TEXTS) < PIVOTS)
    own = F.array(place(some(3, F.col("blocks")), F.lit(0), False))
    dealt = cut(dealt.withColumn("to", F.when(pivot, each(F.col("blocks"), lambda u: place(u, F.lit(0), False))).otherwise(own)))
    good = linked(dealt)
    labels = cut(components(nodes, good))
    large = cut(dealt.drop("to").where("blocks > 1").join(labels.select("fingerprint", "root"), "fingerprint"))
    classes = cut(large.groupBy("whole", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    main = classes.groupBy("whole").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outside = classes.join(main, "whole").groupBy("whole").agg(F.first("main").alias("main"), *[F.coalesce(F.sum(F.when(F.col("root") != F.col("main"), F.col(c))), F.lit(0)).alias(c) for c in ("n", "size")])
    outside = if_small(cut(outside.where("n > 0").select("whole", "main", _blocks(F.col("n"), F.col("size")).alias("parts"))))
    if outside.isEmpty():
        return labels
    large = large.join(outside, "whole")
    asks = F.when(F.col("root") != F.col("main"), each(F.col("blocks"), lambda v: place(some(5, F.col("parts")), v, True)))
    meets = each(F.col("parts"), lambda u: place(u, some(3, F.col("blocks")), False))
    route = cut(large.select("fingerprint", F.when(asks.isNull(), meets).otherwise(F.concat(asks, meets)).alias("to")))
    return components(nodes, cut(good.unionByName(linked(route))))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, shingle: int = 5, words: int = 4, radius: int = 56, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each component: that of the smallest id (nulls last,
    then of the smallest hash of the text); of rows that agree in both one stays.

    Links are pairs of documents whose sets of five-word shingles have a Jaccard
    similarity of at least 0.8: fingerprints propose groups, the sets decide. At 0.8
    two 256-bit fingerprints differ in 39 bits on average (5.7 bits standard deviation),
    so the radius lies three deviations above; unrelated ones differ in 128.
    """
    k1, k2, win, win2 = fresh(docs, "k1", "k2", "winner", "winner2")
    hashes = [F.xxhash64(col(doc_id), col(text), F.lit(s)) for s in (0, 1)]
    d = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), hashes[0].alias("k1"), hashes[1].alias("k2"))
    prints = cut(fingerprints(d, shingle=shingle, words=words, keep=["doc_id", "k1", "k2"], make=set_fingerprint))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.min(F.struct("k1", "k2")).alias("of")))
    labels = _similar(nodes, d, 64 * words, shingle, radius, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("w")
    best = prints.join(labels, "fingerprint").groupBy("root").agg(first).select(F.col("w.k1").alias(win), F.col("w.k2").alias(win2))
    out = docs.withColumns({k1: hashes[0], k2: hashes[1]}).join(best, (col(k1) == col(win)) & (col(k2) == col(win2)), "left_semi")
    return out.dropDuplicates([k1, k2]).drop(k1, k2)


#: Wanted probability that a pair at the similarity meets in a band.
RECALL = 0.995


def bands_for(n_nodes: int, bits: int, similarity: float, per_shard: int = 64) -> list[list[int]]:
    """Random bands whose shards hold about ``per_shard`` nodes, as many as needed.

    Sets of Jaccard similarity s have cosine 2s / (1 + s); a bit of their SimHashes
    differs with probability angle / pi, independently to a good approximation.
    """
    width = max(8, math.ceil(math.log2(max(2, n_nodes) / per_shard)))
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return band_bits(bits, width, math.ceil(math.log(1 - RECALL) / math.log1p(-(same**width))))


def band_bits(bits: int, band: int, bands: int, seed: int = 11) -> list[list[int]]:
    """Seeded random bit positions of each band."""
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits, band, replace=False).tolist()) for _ in range(bands)]


__all__ = ["BKTree", "band_bits", "fingerprint", "fingerprints", "forest", "keep_one", "links", "near_duplicates", "set_fingerprint", "shingle_set"]
