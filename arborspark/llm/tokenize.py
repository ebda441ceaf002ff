"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks a text once. For each boundary it keeps the one survivor: the last
piece of the best segmentation that ends there, with its back-pointer. Pieces have a
bounded length, so only the boundaries of the last ``longest`` characters can
still be continued; whenever the back-pointers of all of them meet in one
boundary, the ids before it are committed and the window is dropped. Memory is
bounded by the window, not by the text; while the paths don't meet the window grows
(a run in which every boundary stays open, which usual vocabularies don't have).

Which path survives depends on the model's kind. For unigram models it is the one
with the greatest sum of scores. A byte-pair model has no such sum (its scores are
merge ranks, and adding them does not give its segmentation), so there a piece
may follow another only if merging the two pieces' text gives exactly these two
pieces again. A segmentation whose neighbours are all compatible is the byte-pair
encoding, and each boundary has exactly one survivor. Ties of unigram sums go to
the longer last piece.

Characters outside the vocabulary stand alone and fall back to byte pieces, or to
<unk> where the model has none. Vocabularies are read on the driver from a path
given by the caller and broadcast (their size is the vocabulary's). No piece of
the usual vocabularies has a letter before a word mark, so words are memoised
(a bounded memo); where a vocabulary has such pieces whole texts are searched.

Cases: null encodes to null, an empty text to no ids; a text that holds the word
mark U+2581 decodes to a space there; very long texts and runs without a space
(digits, ideographs, marks) go through the same window; repeated rows encode alike; an empty table stays empty;
extra columns stay.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh

MARK = "▁"
#: Units that a worker remembers (about 400 bytes each, with beginnings of units and pairs of pieces).
MEMO = 250_000
#: Characters of the longest unit that is remembered.
KEPT = 128


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: dict[str, int]
    byte_ids: tuple[int, ...]  # of the 256 byte pieces, or none
    unknown: int
    merges: bool  # byte-pair model
    dummy_prefix: bool
    hidden: frozenset[int]  # control pieces: no text
    digest: str = ""  # of the model file

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model whose normaliser is the identity; others are refused."""
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            raw = f.read()
        m.ParseFromString(raw)
        rule = m.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        sp = spm.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        kinds = [p.type for p in m.pieces]
        bytes_ = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
        return cls(
            tuple(p.piece for p in m.pieces),
            tuple(p.score for p in m.pieces),
            {m.pieces[i].piece: i for i in range(size) if kinds[i] in (1, 4)},
            tuple(bytes_[f"<0x{b:02X}>"] for b in range(256)) if len(bytes_) == 256 else (),
            sp.unk_id(),
            m.trainer_spec.model_type == 2,
            rule.add_dummy_prefix,
            frozenset(i for i in range(size) if kinds[i] in (3,)),
            hashlib.sha256(raw).hexdigest(),
        )


@dataclass
class Encoder:
    """Streaming encoder and decoder; one a Python worker."""

    v: Vocabulary
    most: int = MEMO
    memo: dict[str, bytes] = field(default_factory=dict)
    fits: dict[int, bool] = field(default_factory=dict)
    #: beginnings of units as a tree: (number, next character) -> number; and their survivors
    steps: dict[int, int] = field(default_factory=dict)
    starts: list[tuple[int, int, float]] = field(default_factory=lambda: [(-1, 0, 0.0)])

    def __post_init__(self) -> None:
        inner = [p for p in self.v.normal if len(p) > 1]
        self.longest = max([1, *map(len, self.v.normal)])
        by_word = not any(MARK in p.lstrip(MARK) for p in inner)
        # runs of characters that share no piece with the largest class of characters
        apart = re.escape("".join(self._apart(inner)))
        runs = f"{MARK}*[{apart}]+|" if apart else ""
        self.units = re.compile(f"{runs}{MARK}*[^{MARK}{apart}]+|{MARK}+") if by_word else None
        self.least = min([0.0, *self.v.scores]) - 10
        # pieces from their ends: each character leads to (the piece of these, the tree above)
        above: dict[str, dict] = {"": {}}
        for text in sorted(self.v.normal):
            for k in range(1, len(text) + 1):
                tail = text[len(text) - k :]
                if tail not in above:
                    above[tail] = {}
                    above[tail[1:]][tail[0]] = (self.v.normal.get(tail), above[tail])
        self.endings = above[""]
        #: neighbours inside some piece; between any others a piece always ends
        self.inside = {text[k : k + 2] for text in self.v.normal for k in range(len(text) - 1)}

    @staticmethod
    def _apart(pieces: list[str]) -> list[str]:
        """Characters of pieces outside the largest class, where classes join the characters
        that occur in one piece. No piece spans two classes."""
        root: dict[str, str] = {"\n": "\n"}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        for p in pieces:
            first, *rest = p.lstrip(MARK) or "\n"
            for c in rest:
                root[find(c)] = find(first)
            find(first)
        size = Counter(map(find, list(root)))
        return sorted(c for c in list(root) if find(c) != max(size, key=lambda r: (size[r], r)))

    # -- encoding ---------------------------------------------------------
    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        marked = text.replace(" ", MARK)
        if self.v.dummy_prefix:
            marked = MARK + marked
        if self.units is None:
            return np.fromiter(self.stream(marked), "<i4").tobytes()
        known = self.memo.get
        return b"".join([known(u) or self._unit(u) for u in self.units.findall(marked)])

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit: it is cut where no piece spans two neighbouring characters, as a
        piece always ends there, and the parts go through the streaming search. Units and
        parts of at most ``KEPT`` characters are memoised, so the memo stays bounded."""
        got = self.memo.get(unit)
        if got is None:
            ends = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.inside]
            got = b"".join([self._part(unit[i:j]) for i, j in zip([0, *ends], [*ends, len(unit)], strict=True)])
            self._remember(unit, got)
        return got

    def _part(self, part: str) -> bytes:
        got = self.memo.get(part)
        if got is None:
            ids = list(self.stream(part))
            got = struct.pack(f"<{len(ids)}i", *ids)
            self._remember(part, got)
        return got

    def _remember(self, unit: str, ids: bytes) -> None:
        if len(unit) <= KEPT:
            if len(self.memo) >= self.most:
                self.memo.clear()
            self.memo[unit] = ids

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters, committed as soon as they are certain.

        Until the first commit a boundary's survivor depends on the characters before
        it only, and words share their beginnings, so these survivors are memoised.
        """
        window, n, base = "", 0, 0  # the characters since the last committed boundary
        last: list[int] = [-1]  # for each boundary of the window its last piece
        back: list[int] = [0]
        total: list[float] = [0.0]
        limit = 2 * self.longest
        if len(self.steps) >= self.most * 5 // 8:
            self.steps, self.starts = {}, [(-1, 0, 0.0)]
        steps, starts = self.steps, self.starts
        start = 0  # the memoised beginning that the window is so far; -1 once committed
        for c in chars:
            window += c
            n += 1
            if start < 0:
                best, at, most = self._survivor(window, last, total)
            else:
                key = start << 21 | ord(c)
                start = steps.get(key, 0)
                if not start:
                    start = steps[key] = len(starts)
                    starts.append(self._survivor(window, last, total))
                best, at, most = starts[start]
            last.append(best)
            back.append(at)
            total.append(most)
            if n - base >= limit:
                base = n
                meet = self._meeting(back, n)
                if meet:
                    yield from self._plain(self._path(last, back, meet))
                    n -= meet
                    window, base, start = window[meet:], n, -1
                    last, back, total = last[meet:], [0, *[b - meet for b in back[meet + 1 :]]], [t - total[meet] for t in total[meet:]]
        yield from self._plain(self._path(last, back, n))

    def _survivor(self, window: str, last: list[int], total: list[float]) -> tuple[int, int, float]:
        """(last piece, the boundary before it, sum of scores) of the path that survives at
        the window's end; last, total: the survivors at all boundaries before."""
        node, i, found = self.endings, len(window), []
        while i and (step := node.get(window[i - 1])) is not None:
            i -= 1
            piece, node = step
            if piece is not None:
                found.append((i, piece))
        if self.v.merges:
            fits = self.fits.get
            for i, piece in reversed(found):
                left = last[i]
                if left < 0 or (fit := fits(left << 32 | piece)) or (fit is None and self._compatible(left, piece)):
                    return piece, i, 0.0
        elif found:  # of equal sums the longer last piece
            most, i, piece = max((total[i] + self.v.scores[piece], -i, piece) for i, piece in found)
            return piece, -i, most
        return -2 - ord(window[-1]), len(window) - 1, total[-1] + self.least  # outside the vocabulary: stands alone

    def _meeting(self, back: list[int], n: int) -> int:
        """The last boundary that the paths of all boundaries still open share."""
        open_ = set(range(max(1, n - self.longest + 1), n + 1))
        while len(open_) > 1:
            top = max(open_)
            open_.discard(top)
            open_.add(back[top])
        return open_.pop()

    @staticmethod
    def _path(last: list[int], back: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _plain(self, ids: list[int]) -> Iterator[int]:
        for i in ids:
            if i >= 0:
                yield i
            elif self.v.byte_ids:
                yield from (self.v.byte_ids[b] for b in chr(-2 - i).encode())
            else:
                yield self.v.unknown

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives these two pieces again."""
        key = left << 32 | right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= self.most:
                self.fits.clear()
            got = self.fits[key] = self.merge(self.v.pieces[left] + self.v.pieces[right]) == [self.v.pieces[left], self.v.pieces[right]]
        return got

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging, best rank first and leftmost among equals: the
        definition, used on pairs of pieces only."""
        parts, normal, scores = list(text), self.v.normal, self.v.scores

        def cost(i: int) -> float:
            piece = normal.get(parts[i] + parts[i + 1])
            return math.inf if piece is None else -scores[piece]

        costs = [cost(i) for i in range(len(parts) - 1)]
        while costs and (least := min(costs)) < math.inf:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(i - 1)
            if i < len(costs):
                costs[i] = cost(i)
        return parts

    def decode(self, ids: Iterable[int]) -> str:
        return Decoder.of(self.v).decode(ids)


@dataclass(frozen=True)
class Decoder:
    """The bytes of each piece."""

    text_of: tuple[bytes, ...]
    dummy_prefix: bool

    @classmethod
    def of(cls, v: Vocabulary) -> Decoder:
        text = [b"" if i in v.hidden else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids):
            text[i] = bytes([b])
        if not v.byte_ids:
            text[v.unknown] = " ⁇ ".encode()
        return cls(tuple(text), v.dummy_prefix)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what is made of one at a time stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(shared, memo: int = MEMO) -> Encoder:
    """This worker's encoder of a broadcast vocabulary; memos live as long as it."""
    v = shared.value
    if (v.digest, memo) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[v.digest, memo] = Encoder(v, memo)
    return _ENCODERS[v.digest, memo]


def encode(docs: DataFrame, model_path: str, text: str = "text", *, out: str = "ids", verified: str | None = None, memo: int = MEMO) -> DataFrame:
    """docs plus ``ids`` array<int>, and if a name is given for it a boolean column
    ``verified``: whether the ids decode to the text (null: no ids, true). memo: units that
    a worker remembers; it changes time and memory only."""
    v = Vocabulary.load(model_path)
    shared, plain = (docs.sparkSession.sparkContext.broadcast(x) for x in (v, Decoder.of(v)))
    names = fresh(docs, out, *([verified] if verified else []))
    more = [T.StructField(names[0], T.ArrayType(T.IntegerType(), False)), *[T.StructField(n, T.BooleanType(), False) for n in names[1:]]]
    text_at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared, memo)
        for b in _slices(batches):
            texts = b.column(text_at).to_pylist()
            got = [None if t is None else e.encode(t) for t in texts]
            sizes = np.cumsum([0, *[len(g) // 4 if g else 0 for g in got]])
            values = pa.Array.from_buffers(pa.int32(), int(sizes[-1]), [None, pa.py_buffer(b"".join([g for g in got if g]))])
            made = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=pa.array([g is None for g in got], pa.bool_()))]
            if verified:
                d = plain.value
                made.append(pa.array([g is None or d.decode(np.frombuffer(g, "<i4").tolist()) == t for g, t in zip(got, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def decode(rows: DataFrame, model_path: str, ids: str = "ids", *, out: str = "decoded") -> DataFrame:
    """rows plus ``decoded`` string."""
    shared = rows.sparkSession.sparkContext.broadcast(Decoder.of(Vocabulary.load(model_path)))
    (name,) = fresh(rows, out)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = shared.value
        for b in _slices(batches):
            c = b.column(at)
            values, ends, valid = c.values.to_numpy(zero_copy_only=False), c.offsets.to_pylist(), c.is_valid().to_pylist()
            texts = [text_of.decode(values[x:y].tolist()) if ok else None for x, y, ok in zip(ends[:-1], ends[1:], valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, name])

    return rows.mapInArrow(run, schema)


__all__ = ["Encoder", "Vocabulary", "decode", "encode"]
