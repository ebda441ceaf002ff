"""License scans: phrases, and an exact set-similarity join of blocks and templates.

A block meets a template if it holds at least ``threshold`` of the template's
distinct tokens. Blocks are the lines and, for notices that wrap, the windows of the
template's length in words that span line breaks. The join is exact and never compares all pairs: template tokens
are ordered by their frequency in the whole corpus, rarest first, and a template of
m tokens that needs c of them can only be met by a block that holds one of its first
m - c + 1 tokens (prefix filter), has at least c vocabulary tokens (length filter)
and still has c of them from its first common token on, in both orders (positional
filter). Survivors are verified by set intersection. The join goes through an index
from tokens to the templates that have them in their prefix, so a block meets only
templates it shares such a token with. This index is bounded by the ``templates`` parameter and
travels as literals, so blocks stay where they are read: no shuffle but that of the token counts.

Only DataFrame functions. Words are runs of letters, digits and non-ASCII
characters after lower-casing A-Z; phrases are found word by word.

Cases: null is an empty text; texts without words have no labels and score 0; very
long texts and lines are scanned whole; repeated rows are scanned alike; an empty
table stays empty; extra columns stay.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

#: Phrases with their labels, and short notices of common licenses.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "released under cc0 1 0 universal public domain dedication"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsl", "distributed under the boost software license version 1 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("artistic", "you may distribute this package under the terms of the artistic license 2 0"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
)
THRESHOLD = 0.9
#: More than a template has tokens.
SPAN = 1 << 12
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a lower-cased text."""
    return F.filter(F.split(text, APART, -1), lambda w: w != "")


def lengths(templates=TEMPLATES) -> list[int]:
    """Words of each template, repeated ones included."""
    return [len(re.findall(r"[^\W_]+", text)) for _, text in templates]


def sets(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int]]:
    """(label, distinct tokens, how many of them a block needs)."""
    out = []
    for label, text in templates:
        tokens = sorted(set(re.findall(r"[^\W_]+", text.lower())))
        out.append((label, tokens, math.ceil(round(threshold * len(tokens), 9))))
    return out


def token_order(docs: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest in the corpus first (one row a vocabulary token)."""
    found = docs.select(F.explode(F.filter(F.split(F.lower(col(text)), APART, -1), lambda w: w.isin(vocabulary))).alias("token"))
    counts = {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def _any_of(tokens: list[str]) -> str:
    """Java pattern for any of the tokens as a whole word, ASCII case aside."""
    return rf"(?i)(?<!{WORD})(?:{'|'.join(map(re.escape, tokens))})(?!{WORD})"


def _let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


class Index:
    """The templates as literals, and for each token's rank the templates (their numbers)
    that have it in their prefix."""

    def __init__(self, indexed: list[tuple[str, list[int], int]], lengths: list[int]) -> None:
        prefix: dict[int, list[int]] = {}
        for k, (_, own, need) in enumerate(indexed):
            for r in own[: len(own) - need + 1]:
                prefix.setdefault(r, []).append(k)
        top = max(prefix, default=-1) + 1
        numbers = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
        self.by_rank = F.array(*[numbers(prefix.get(r, [])) for r in range(top)]).cast("array<array<int>>")
        self.top = top
        self.templates = F.array(*[F.struct(F.lit(label).alias("label"), numbers(own).alias("own"), F.lit(need).alias("need"), F.lit(n).alias("length")) for (label, own, need), n in zip(indexed, lengths, strict=True)])

    def candidates(self, ranks: Column) -> Column:
        """The templates that share a prefix token with a block's ranks."""
        of = F.transform(F.filter(ranks, lambda r: r < self.top), lambda r: F.element_at(self.by_rank, r + 1))
        return F.transform(F.array_sort(F.array_distinct(F.flatten(of))), lambda k: F.element_at(self.templates, k + 1))


def _containment(ranks: Column, t: Column) -> Column:
    """Share of a candidate template in the block, null below what is needed. ranks: the
    block's distinct vocabulary tokens as ranks, ascending, as are the template's own."""
    m = F.size(t["own"])
    first = F.element_at(F.array_intersect(t["own"], ranks), 1)  # rarest common token
    room = F.least(F.size(ranks) - F.array_position(ranks, first), m - F.array_position(t["own"], first)) + 1
    share = F.when(room >= t["need"], F.size(F.array_intersect(t["own"], ranks)))
    return F.when(F.size(ranks) >= t["need"], _let(share, lambda x: F.when(x >= t["need"], x / m)))


def scan(docs: DataFrame, text: str = "text", *, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus n_words long, phrases array<struct<label, word>> in order of place and
    blocks array<struct<label, block, containment>> (block: number of the line, or of
    the first line of a window that spans several and touches no line of that label)."""
    wanted = sets(templates, threshold)
    vocabulary = sorted({t for _, tokens, _ in wanted for t in tokens})
    order = token_order(docs, text, vocabulary)
    rank = {t: i for i, t in enumerate(order)}
    indexed = [(label, sorted(rank[t] for t in tokens), need) for label, tokens, need in wanted]
    rare = sorted({order[r] for _, own, need in indexed for r in own[: len(own) - need + 1]})

    n, place, block, lines, word, token, met = fresh(docs, "n_words", "phrases", "blocks", "lines", "words", "tokens", "met")
    whole = F.coalesce(col(text), F.lit(""))
    phrase_like = "|".join(APART.join(p.split()) for p in phrases)
    said = whole.rlike(rf"(?i)(?<!{WORD})(?:{phrase_like})(?!{WORD})")
    near = whole.rlike(_any_of(rare))
    ranked = F.create_map(*[F.lit(x) for t, r in rank.items() for x in (t, r)])

    def block_ranks(line: Column) -> Column:
        return F.array_sort(F.transform(F.array_distinct(F.filter(F.split(line, APART, -1), lambda w: w.isin(vocabulary))), lambda w: F.element_at(ranked, w)))

    # each layer names what the next one uses more than once, so that it is computed once
    out = docs.select("*", F.regexp_count(whole, F.lit(WORD + "+")).cast("long").alias(n), F.when(said, words(lowered(whole))).alias(word), F.when(near, F.split(lowered(whole), "\n", -1)).alias(lines))
    held = F.transform(F.filter(F.transform(col(lines), lambda x, i: F.struct(i.alias("block"), x.alias("line"))), lambda s: s["line"].rlike(_any_of(rare))), lambda s: F.struct(s["block"].alias("block"), block_ranks(s["line"]).alias("ranks")))
    out = out.withColumns({lines: held, token: _tokens(col(lines), vocabulary, ranked)})
    index = Index(indexed, lengths(templates))
    out = out.withColumn(met, F.flatten(F.transform(col(lines), _met(index))))
    hits = [_places(col(word), p.split(), label) for p, label in phrases.items()]
    empty_p = F.array().cast("array<struct<label:string,word:int>>")
    empty_b = F.array().cast("array<struct<label:string,block:int,containment:double>>")
    every = F.concat(col(met), _wrapped(col(token), col(met), index))
    by_word = lambda a, b: F.when(a["word"] != b["word"], a["word"] - b["word"]).when(a["label"] < b["label"], -1).otherwise(1)
    return out.select(*[col(c) for c in docs.columns], col(n), F.when(F.size(word) > 0, F.array_sort(F.concat(*hits), by_word)).otherwise(empty_p).alias(place), F.coalesce(every, empty_b).alias(block))


def _says(w: Column, phrase: list[str]):
    def test(i: Column) -> Column:
        out = F.lit(True)
        for k, p in enumerate(phrase):
            out = out & F.coalesce(F.get(w, i + k) == p, F.lit(False))
        return out

    return test


def _places(w: Column, phrase: list[str], label: str) -> Column:
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), _says(w, phrase))
    return F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.alias("word")))


def _met(index: Index):
    def of(b: Column) -> Column:
        one = lambda t: F.struct(t["label"].alias("label"), b["block"].alias("block"), _containment(b["ranks"], t).alias("containment"))
        return F.filter(F.transform(index.candidates(b["ranks"]), one), lambda s: s["containment"].isNotNull())

    return of


def _tokens(lines: Column, vocabulary: list[str], ranked: Column) -> Column:
    """array<struct<line, at, rank>>: the vocabulary tokens; at counts all words."""
    flat = F.flatten(F.transform(lines, lambda x, i: F.transform(words(x), lambda w: F.struct(i.alias("line"), w.alias("word")))))
    known = F.filter(F.transform(flat, lambda s, at: F.struct(s["line"].alias("line"), at.alias("at"), s["word"].alias("word"))), lambda s: s["word"].isin(vocabulary))
    return F.transform(known, lambda s: F.struct(s["line"].alias("line"), s["at"].alias("at"), F.element_at(ranked, s["word"]).alias("rank")))


def _wrapped(tokens: Column, met: Column, index: Index) -> Column:
    """Matches in windows of a template's length in words that span lines, the best of each
    first line. Windows start on own tokens; each takes a slice of a template's length, so
    the work grows with the text."""

    def windows(t: Column, own: Column) -> Column:
        length, need = t["length"], t["need"]

        def sized(n: Column) -> Column:
            # a window with enough tokens has the need-th one from its start within its length
            placed = F.transform(n, lambda s, i: F.struct(i.alias("i"), s["at"].alias("at"), s["line"].alias("line")))
            starts = F.filter(placed, lambda s: F.get(n, s["i"] + need - 1)["at"] < s["at"] + length)
            cut = lambda s: F.filter(F.slice(n, s["i"] + 1, length), lambda u: u["at"] < s["at"] + length)
            return F.transform(F.transform(starts, cut), lambda w: F.struct(w[0]["line"].alias("block"), F.array_max(w["line"]).alias("last"), F.size(F.array_distinct(w["rank"])).alias("share")))

        def best(f: Column) -> Column:
            # block and share as one number: the last of a block's numbers is its best
            both = F.array_sort(F.array_distinct(F.transform(f, lambda w: w["block"].cast("long") * SPAN + w["share"])))
            last = lambda k: F.filter(k, lambda x, i: F.coalesce(F.floor(F.get(k, i + 1) / SPAN), F.lit(-1)) != F.floor(x / SPAN))
            return F.transform(_let(both, last), lambda x: F.struct(t["label"].alias("label"), F.floor(x / SPAN).cast("int").alias("block"), ((x % SPAN).cast("int") / F.size(t["own"])).alias("containment")))

        lone = lambda w: ~F.exists(met, lambda b: (b["label"] == t["label"]) & b["block"].between(w["block"], w["last"]))
        return _let(F.filter(_let(own, sized), lambda w: (w["share"] >= need) & (w["last"] > w["block"]) & lone(w)), best)

    def of(ranks: Column) -> Column:
        may = F.filter(index.candidates(ranks), lambda t: F.size(F.array_intersect(t["own"], ranks)) >= t["need"])
        return F.flatten(F.transform(may, lambda t: windows(t, F.filter(tokens, lambda x: F.array_contains(t["own"], x["rank"])))))

    return F.when(tokens.isNotNull(), _let(F.array_sort(F.array_distinct(tokens["rank"])), of))


__all__ = ["PHRASES", "TEMPLATES", "THRESHOLD", "scan", "sets"]
