"""Operators on tables of trees, one Newick string a row.

A tree is small and trees are many, so each row is worked on where it lies, in Arrow
batches; nothing is shuffled, and results that relate trees (splits, distances)
come out as rows for ordinary joins and aggregates. A row that can't be processed
gives its error instead of a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from arborspark.functions.outgroups import canonical
from arborspark.functions.topology import rf
from arborspark.sources import newick


#: Results that make a batch.
ROWS = 10_000


def per_row(rows: DataFrame, columns: str, work: Callable[[dict], list[tuple]], keep: list[str]) -> DataFrame:
    """``work(row)`` gives result tuples; the columns ``keep`` come along, and ``error``."""
    made = _parse_datatype_string(columns)
    kept = StructType([rows.schema[c] for c in keep])
    schema = StructType([*kept.fields, *made.fields, *_parse_datatype_string("error string").fields])
    kinds = [(f.name, f.type) for f in to_arrow_schema(schema)]
    width = len(made.fields)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                (row,) = b.slice(i, 1).to_pylist()
                own = tuple(row[c] for c in keep)
                try:
                    out += [(*own, *r, None) for r in work(row)]
                except (ValueError, KeyError) as e:
                    out.append((*own, *[None] * width, str(e)[:300]))
                if len(out) >= ROWS:  # a tree's results don't wait for the others of its batch
                    yield batch(out)
                    out = []
            yield batch(out)

    return rows.mapInArrow(run, schema)


def edges(trees: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, u, v, bl, taxon): u < v; taxon names the leaf of a leaf edge."""
    def work(row: dict) -> list[tuple]:
        t = newick.parse(row["newick"])
        return [(u, v, x, t.names.get(u) or t.names.get(v)) for u, v, x in t.edges()]

    return per_row(trees, "u int, v int, bl double, taxon string", work, keep)


def problems(trees: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, n_taxa, problem): what keeps a tree from being unrooted and binary."""
    def work(row: dict) -> list[tuple]:
        t = newick.parse(row["newick"], strict=False)
        return [(len(t.names), "; ".join(t.problems()) or None)]

    return per_row(trees, "n_taxa int, problem string", work, keep)


def splits(trees: DataFrame, keep: list[str], within: str | None = None) -> DataFrame:
    """(keep, split array<string>): nontrivial splits as their canonical smaller side;
    ``within`` is a column of taxa to restrict to."""
    def work(row: dict) -> list[tuple]:
        t = newick.parse(row["newick"])
        taxa = set(t.names.values()) & set(row[within]) if within else set(t.names.values())
        return [(list(s),) for s in sorted({canonical(x, taxa) for x in t.splits(taxa)})]

    return per_row(trees, "split array<string>", work, keep)


def split_sizes(trees: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, size int): a row for each nontrivial split, with the size of its smaller side; for
    trees whose members by split (``splits``, quadratic in a tree's height) are too many."""
    return per_row(trees, "size int", lambda r: [(n,) for n in newick.parse(r["newick"]).split_sizes()], keep)


def distances(pairs: DataFrame, keep: list[str], a: str = "newick_a", b: str = "newick_b") -> DataFrame:
    """(keep, rf, nrf, n_common) of two trees a row."""
    return per_row(pairs, "rf int, nrf double, n_common int", lambda r: [rf(newick.parse(r[a]), newick.parse(r[b]))], keep)


def pruned(trees: DataFrame, keep: list[str], remove: str = "remove") -> DataFrame:
    """(keep, newick, anchors map<string, array<string>>): the trees without the leaves of
    a column; an anchor is the smaller side of the edge that a leaf hung from."""
    def work(row: dict) -> list[tuple]:
        t, anchors = newick.parse(row["newick"]).prune(row[remove])
        return [(newick.write(t), [(n, list(canonical(t.beyond(*e), t.names.values()))) for n, e in sorted(anchors.items())])]

    return per_row(trees, "pruned string, anchors map<string, array<string>>", work, keep)


def windows(trees: DataFrame, keep: list[str], leaf: str = "leaf", n: int = 14) -> DataFrame:
    """(keep, place, split array<string>): the edges nearest to a leaf's, as splits."""
    def work(row: dict) -> list[tuple]:
        t = newick.parse(row["newick"])
        u = t.leaf(row[leaf])
        return [(i, list(canonical(t.beyond(*e), t.names.values()))) for i, e in enumerate(t.window(u, next(iter(t.adj[u])), n))]

    return per_row(trees, "place int, split array<string>", work, keep)


def neighbours(trees: DataFrame, keep: list[str], radius: int = 1) -> DataFrame:
    """(keep, move, moved): the Newick text after each move, for all NNI neighbours, or all SPR moves up to a radius."""
    def work(row: dict) -> list[tuple]:
        t = newick.parse(row["newick"])
        if radius <= 1:
            inner = [(u, v) for u, v, _ in t.edges() if u not in t.names and v not in t.names]
            return [(f"nni {u} {v} {k}", newick.write(t.nni(u, v, k))) for u, v in inner for k in (0, 1)]
        return [(f"spr {u} {v} {x} {y}", newick.write(t.spr(u, v, x, y))) for u, v in t.spr_points() for x, y, _ in t.spr_targets(u, v, radius)]

    return per_row(trees, "move string, moved string", work, keep)


def clades(trees: DataFrame, keep: list[str], wanted: str = "wanted") -> DataFrame:
    """(keep, clade array<string>): maximal subtrees of wanted leaves only."""
    return per_row(trees, "clade array<string>", lambda r: [(sorted(c),) for c in newick.parse(r["newick"]).clades_of(set(r[wanted]))], keep)


__all__ = ["clades", "distances", "edges", "neighbours", "per_row", "problems", "pruned", "split_sizes", "splits", "windows"]
