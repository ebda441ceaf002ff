"""State masks of characters, as Column expressions and for local use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit i is state i of the order given; ambiguity codes allow several states.
DNA_ORDER = "ACGT"
AA_ORDER = "ACDEFGHIKLMNPQRSTVWY"
DNA_CODES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
AA_CODES = {**{c: c for c in AA_ORDER}, "B": "DN", "Z": "EQ", "J": "IL", "X": AA_ORDER}
ONLY_AA = "EFIJLOPQZX*"


def table(seq_type: str) -> tuple[dict[str, int], int]:
    """(character -> mask, mask of gaps and unknown characters): all states and the gap bit."""
    order, codes = (DNA_ORDER, DNA_CODES) if seq_type == "DNA" else (AA_ORDER, AA_CODES)
    return {c: sum(1 << order.index(x) for x in states) for c, states in codes.items()}, (1 << len(order) + 1) - 1


def states(seq_type: str) -> int:
    return 4 if seq_type == "DNA" else 20


def mask(char: Column, seq_type: str) -> Column:
    """Mask of one character, whatever its case."""
    codes, gap = table(seq_type)
    pairs = [F.lit(x) for c, m in codes.items() for x in (c, m)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(char)), F.lit(gap))


def masks(seq: Column, seq_type: str) -> Column:
    """array<int> of a sequence's masks."""
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: mask(c, seq_type))


def looks_protein(seq: Column) -> Column:
    return seq.rlike("(?i)[EFIJLOPQZX*]")


def detect(seqs) -> str:
    """Type of local sequences: AA if any holds a character that only proteins have."""
    return "AA" if any(c in ONLY_AA for s in seqs for c in s.upper()) else "DNA"


def encode(seq: str, seq_type: str) -> np.ndarray:
    codes, gap = table(seq_type)
    return np.array([codes.get(c, gap) for c in seq.upper()], np.int64)
