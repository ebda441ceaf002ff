"""Line dedup by a segment-partition edit join.

A line is dropped if an equal line, or one within ``edits`` edits (insertion, deletion or
substitution of a character), occurs earlier in the corpus: in a document with
a smaller doc_id, or further up in the same one. Decisions are taken on the
input, so a chain of similar lines does not save its links. Lines shorter than
``min_chars`` take no part in the edit join; with ``short`` their exact repeats go
too if they hold a letter or digit, else they are left alone (blank lines, list
marks, braces).

The join: a line of m characters is cut into edits + 1 segments. Of two lines within
that many edits one segment j of the shorter one occurs unchanged in the longer one,
with at most j edits to its left and edits - j to its right (the first place where the
edits so far are fewer than the segments so far). So each distinct line is
indexed under (m, j, text of segment j), and probes the indexes of its own length and of
lengths up to ``edits`` less with the substrings at the starts that these two bounds
leave: 4 keys a line at one edit, 12 at two. Keys are hashes; lines that share none are never
compared. Pairs from a shared key are verified on what lies left and right of the
segment, each within its own bound, by a banded bit-parallel automaton (one machine
word an error count, one bit a diagonal).

Keys shared by more than ``GROUP`` lines (families that differ in one segment) are not
expanded into pairs. What they leave open is cut into segments again, each open part by its own
bound, and so on, until the groups are small or the part has no more characters than
edits. From there a part is aligned a character a step (equal, replaced, left out on either
side), each step a key, until nothing is open: then all lines of a key are within
``edits`` edits and the earliest decides. So no group is emitted as all its pairs and none is
cut short.

Only DataFrame functions. Lines are known by 128 bits of hash; texts move once, to
their own document's decisions, and candidates' texts are read from that exchange.

Cases: null texts stay null and have no lines; empty texts keep their one empty
line; null ids come after all others; rows that agree in id and text are one
document; a document that loses all its lines keeps an empty text; an empty table
stays empty; very long lines are treated like others; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, fresh

EDITS = 1
MIN_CHARS = 20
GROUP = 100
#: What a line must hold for its exact repeats to go whatever its length.
HOLDS_WORD = r"[\p{L}\p{N}]"


def _h(*parts: Column, seed: int = 0) -> Column:
    return F.xxhash64(*parts, F.lit(seed))


def _documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, k1, k2, text): k1, k2 hash what makes a document."""
    d = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return d.select("doc_id", _h(F.col("doc_id"), F.col("text")).alias("k1"), _h(F.col("doc_id"), F.col("text"), seed=1).alias("k2"), "text")


def _lines(d: DataFrame, min_chars: int, short: bool) -> DataFrame:
    """(h1, h2, first, line): the lines that take part; first orders occurrences."""
    takes_part = F.length("line") >= min_chars
    if short:
        takes_part = takes_part | F.col("line").rlike(HOLDS_WORD)
    e = d.select("doc_id", "k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(takes_part)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "at")
    return e.select(_h(F.col("line")).alias("h1"), _h(F.col("line"), seed=1).alias("h2"), first.alias("first"), "line")


def _window(j: Column | int, bound: Column | int, gap: Column | int) -> tuple:
    """The two lists whose greatest and least bound the shifts of segment j, where ``bound``
    edits are left and the longer part has ``gap`` more characters."""
    return (-j, gap - bound + j), (j, gap + bound - j)


def _probes(edits: int) -> list[tuple[int, int, int]]:
    """(characters less, segment, shift) of a line's keys; the line is indexed itself
    under those without the first and the last."""
    out = []
    for gap in range(edits + 1):
        for j in range(edits + 1):
            low, high = _window(j, edits, gap)
            out += [(gap, j, shift) for shift in range(max(low), min(high) + 1)]
    return out


def _ends(m: Column, bound: Column, j: Column) -> tuple[Column, Column]:
    """Where segment j of m characters starts and ends."""
    return F.floor(m * j / (bound + 1)).cast("int"), F.floor(m * (j + 1) / (bound + 1)).cast("int")


def _segment_keys(line: Column, edits: int) -> list[Column]:
    """The line's keys, in the order of _probes; null where a shift leaves the line."""
    n, out = F.length(line), []
    for gap, j, shift in _probes(edits):
        m = n - gap
        start, end = _ends(m, F.lit(edits), F.lit(j))
        key = _h(m, F.lit(j), F.substr(line, start + shift + 1, end - start))
        out.append(key if 0 <= shift <= gap else F.when((start + shift >= 0) & (end + shift <= n), key))
    return out


def _open_parts(s: Column, m: Column, bound: Column, j: Column, shift: Column) -> Column:
    """What segment j leaves open of a part: array of (s, m, bound), where m is the indexed
    line's length. A side without edits is empty, so it is left out."""
    start, end = _ends(m, bound, j)
    part = lambda text, size, left: F.struct(text.alias("s"), size.cast("int").alias("m"), left.cast("int").alias("bound"))
    sides = F.array(part(F.substr(s, F.lit(1), start + shift), start, j), part(F.substr(s, end + shift + 1), m - end, bound - j))
    return F.filter(sides, lambda p: p["bound"] > 0)


def within(x: Column, y: Column, edits: int, bound: Column | None = None) -> Column:
    """Whether two strings are within ``edits`` edits, or within ``bound`` where that is less: bit d + edits of word e is set
    while the automaton with e errors is alive on diagonal d (place in x - place in y)."""
    band, full = 2 * edits + 1, (1 << 2 * edits + 1) - 1
    bound = F.lit(edits) if bound is None else bound
    gap = F.length(x) - F.length(y)
    both = F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y"))
    start, word = [], 1 << edits
    for _ in range(edits + 1):
        start.append(word)
        word = (word | word << 1) & full

    def run(s: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            c, hit = F.get(s["y"], i), F.lit(0)
            for b in range(band):
                same = F.coalesce(F.get(s["x"], i + (b - edits)) == c, F.lit(False))
                hit = hit.bitwiseOR(F.when(same, 1 << b).otherwise(0))
            return F.transform(F.array(F.struct(state.alias("s"), hit.alias("h"))), lambda t: F.array(*_next(t["s"], t["h"], edits, full)))[0]

        alive = F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(y), F.lit(1)) - 1), F.array(*map(F.lit, start)), step)
        end = F.when(F.length(y) == 0, F.get(F.array(*map(F.lit, start)), bound)).otherwise(F.get(alive, bound))
        return F.shiftrightunsigned(end, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(band)]), gap + edits + 1)) != 0

    return F.when(F.abs(gap) <= edits, F.transform(F.array(both), run)[0]).otherwise(False)


def _next(state: Column, hit: Column, edits: int, full: int) -> list[Column]:
    out: list[Column] = []
    for e in range(edits + 1):
        now = F.get(state, F.lit(e)).bitwiseAND(hit)
        if e:
            old = F.get(state, F.lit(e - 1))
            now = now.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full))
        out.append(now)
    return out


def _groups(rows: DataFrame) -> DataFrame:
    """rows (key, role, ...) plus n, of keys under which lines can meet."""
    n, base = F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == 0).alias("base")
    counts = rows.groupBy("key").agg(n, base).where("n > 1 and base > 0")
    return rows.join(counts.select("key", "n"), "key")


def _later(pairs: DataFrame) -> DataFrame:
    """The lines (h1, h2) that a pair's earlier line drops."""
    a_first = F.col("a.first") < F.col("b.first")
    pick = lambda c: F.when(a_first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return pairs.select(pick("h1"), pick("h2"))


def _met(groups: DataFrame, edits: int) -> DataFrame:
    """Later lines of verified pairs; groups: (key, role, h1, h2, first, parts)."""
    a, b = groups.where("role = 0").alias("a"), groups.alias("b")
    new = (F.col("b.role") == 1) | (F.col("a.first") < F.col("b.first"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & new & ~((F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))))
    near = F.lit(True)
    for k in range(edits):  # a part has an edit at least, so there are no more parts
        x, y = F.get(F.col("a.parts"), F.lit(k)), F.get(F.col("b.parts"), F.lit(k))
        near = near & (x.isNull() | within(x["s"], y["s"], edits, x["bound"]))
    return _later(pairs.where(near))


def _segments(rows: DataFrame) -> DataFrame:
    """rows (..., p, rest) with p cut into segments: under each key another segment is equal."""
    s, m, bound, gap = F.col("p.s"), F.col("p.m"), F.col("p.bound"), F.length("p.s") - F.col("p.m")
    low, high = _window(F.col("j"), bound, gap)
    x = rows.where(F.abs(gap) <= bound).withColumn("j", F.explode(F.sequence(F.lit(0), bound)))
    x = x.withColumn("shift", F.explode(F.sequence(F.greatest(*low), F.least(*high))))
    start, end = _ends(m, bound, F.col("j"))
    x = x.where((start + F.col("shift") >= 0) & (end + F.col("shift") <= F.length(s)))
    key = _h(F.col("key"), F.col("j"), F.substr(s, start + F.col("shift") + 1, end - start))
    role = F.when((F.col("role") == 0) & (F.col("shift") == 0), 0).otherwise(1)
    parts = F.concat("rest", _open_parts(s, m, bound, F.col("j"), F.col("shift")))
    return x.select(key.alias("key"), role.alias("role"), "h1", "h2", "first", parts.alias("parts"))


def _letters(rows: DataFrame) -> DataFrame:
    """rows (..., p, rest) with p aligned by one character: under each key by another step."""
    s, m, bound, base = F.col("p.s"), F.col("p.m"), F.col("p.bound"), F.col("role") == 0
    tail, full = F.substr(s, F.lit(2)), F.length(s) > 0

    def step(name: str, may: Column, text: Column, size: Column, left: Column) -> Column:
        letter = F.substr(s, F.lit(1), F.lit(1)) if name == "equal" else F.lit("")
        closed = (left == 0) | (size == 0)  # then the ends are equal, or are left out on the longer side
        fits = F.when(left == 0, F.length(text) == size).otherwise((size > 0) | (F.length(text) <= left))
        key = _h(F.col("key"), F.lit(name), letter, F.when(left == 0, text).otherwise(F.lit("")))
        more = F.array(F.struct(text.alias("s"), size.cast("int").alias("m"), left.cast("int").alias("bound")))
        parts = F.concat("rest", F.when(closed, F.slice(more, 1, 0)).otherwise(more))
        return F.when(may & fits, F.struct(key.alias("key"), parts.alias("parts")))

    steps = F.array(
        step("end", m == 0, s, m, bound),
        step("equal", (m > 0) & full, tail, m - 1, bound),
        step("replaced", (m > 0) & full, tail, m - 1, bound - 1),
        step("less", m > 0, F.when(base, tail).otherwise(s), m - 1, bound - 1),
        step("more", (m > 0) & (base | full), F.when(base, s).otherwise(tail), m, bound - 1),
    )
    x = rows.withColumn("step", F.explode(F.filter(steps, lambda t: t.isNotNull())))
    return x.select("step.key", "role", "h1", "h2", "first", "step.parts")


def _refine(hot: DataFrame, edits: int) -> list[DataFrame]:
    """Later lines under keys of many lines; hot: (key, role, h1, h2, first, parts)."""
    found = []
    while not hot.isEmpty():
        # nothing open: all indexed lines of a key are near each other and near all that probe it
        closed = hot.where(F.size("parts") == 0)
        base = F.min(F.when(F.col("role") == 0, F.col("first"))).alias("base")
        ends = closed.groupBy("key").agg(base, F.min("first").alias("any"))
        earlier = F.when(F.col("role") == 0, F.col("any")).otherwise(F.col("base"))
        found.append(closed.join(ends, "key").where(earlier < F.col("first")).select("h1", "h2"))

        open_ = hot.where(F.size("parts") > 0).withColumn("p", F.get("parts", F.lit(0))).withColumn("rest", F.slice("parts", F.lit(2), F.size("parts")))
        deeper = _segments(open_.where("p.m > p.bound")).unionByName(_letters(open_.where("p.m <= p.bound")))
        deeper = cut(_groups(deeper))
        found.append(_met(deeper.where(F.col("n") <= GROUP).drop("n"), edits))
        hot = deeper.where(F.col("n") > GROUP).drop("n")
    return found


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, min_chars: int = MIN_CHARS, short: bool = False, edits: int = EDITS) -> DataFrame:
    """(k1, k2, dropped array<int>): for each document that loses lines, their numbers."""
    d = _documents(docs, text, doc_id)
    lines = _lines(d, min_chars, short)
    keys = F.when(F.length("line") >= min_chars, F.array(*_segment_keys(F.col("line"), edits)))  # null: exact repeats only
    known = lines.select("h1", "h2", "first", keys.alias("keys")).groupBy("h1", "h2").agg(F.min("first").alias("first"), F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("times"))
    known = cut(known)
    probes = _probes(edits)
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("tag"))
    rows = known.select("h1", "h2", F.posexplode("keys").alias("tag", "key")).where("key is not null")
    rows = rows.withColumn("role", of([int(gap > 0 or shift != 0) for gap, _, shift in probes]))
    groups = cut(_groups(rows))
    # the texts of the lines that share a key, from their first documents
    wanted = groups.select("h1", "h2").distinct().join(known.select("h1", "h2", "first"), ["h1", "h2"])
    at = wanted.select("h1", "h2", "first", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    texts = at.alias("w").join(d.select("k1", "k2", "text").alias("d"), (F.col("w.k1") == F.col("d.k1")) & (F.col("w.k2") == F.col("d.k2")))
    texts = texts.select("h1", "h2", "first", F.get(F.split("text", "\n", -1), F.col("first.at")).alias("line")).dropDuplicates(["h1", "h2"])
    texts = cut(texts)
    gap, j, shift = map(of, zip(*probes))
    parts = _open_parts(F.col("line"), F.length("line") - gap, F.lit(edits), j, shift)
    open_ = groups.join(texts, ["h1", "h2"]).select("key", "role", "h1", "h2", "first", parts.alias("parts"), "n")
    later = _met(open_.where(F.col("n") <= GROUP).drop("n"), edits)
    for more in _refine(cut(open_.where(F.col("n") > GROUP).drop("n")), edits):
        later = later.unionByName(more)
    later = later.distinct().withColumn("near", F.lit(True))
    fate = known.select("h1", "h2", F.col("first").alias("least"), "times").join(later, ["h1", "h2"], "left").where((F.col("times") > 1) | F.col("near"))
    fate = cut(fate)  # so the last join is one of two tables, whose hot lines can be split
    gone = lines.select("h1", "h2", "first").join(fate, ["h1", "h2"]).where(F.col("near") | (F.col("first") > F.col("least")))
    return gone.groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")).agg(F.collect_set("first.at").alias("dropped"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, min_chars: int = MIN_CHARS, short: bool = False, edits: int = EDITS, dropped: str = "dropped") -> DataFrame:
    """docs with the dropped lines taken out of ``text``, plus ``dropped`` array<int>
    (numbers of the lines taken out, ascending)."""
    gone = decide(docs, text, doc_id, min_chars=min_chars, short=short, edits=edits)
    k1, k2, out, g1, g2 = fresh(docs, "k1", "k2", dropped, "g1", "g2")
    gone = gone.select(F.col("k1").alias(g1), F.col("k2").alias(g2), F.array_sort("dropped").alias(out))
    keyed = docs.withColumns({k1: _h(col(doc_id), col(text)), k2: _h(col(doc_id), col(text), seed=1)})
    joined = keyed.join(gone, (col(k1) == col(g1)) & (col(k2) == col(g2)), "left")
    kept = F.array_join(F.filter(F.split(col(text), "\n", -1), lambda line, i: ~F.array_contains(col(out), i)), "\n")
    new = F.when(col(out).isNull(), col(text)).otherwise(kept)
    return joined.select(*[new.alias(c) if c == text else col(c) for c in docs.columns], F.coalesce(col(out), F.array().cast("array<int>")).alias(out))
