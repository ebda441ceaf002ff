"""Substitution models: transition probabilities and their derivatives.

Every model is reversible with mean rate one and is kept in spectral form
``P(t) = left @ diag(exp(rates * t)) @ right``, small enough to travel inside a task.
The Jukes-Cantor family also has a closed form as Column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchangeabilities (upper triangle by rows) and stationary frequencies
# of Jones, Taylor and Thornton (1992), amino acids in the order ACDEFGHIKLMNPQRSTVWY.
JTT_EXCHANGE = """
56 81 105 15 179 27 36 35 30 54 54 194 57 58 378 475 298 9 11
10 5 78 59 69 17 7 23 31 34 14 9 113 223 42 62 115 209
767 4 130 112 11 26 7 15 528 15 49 16 59 38 31 4 46
5 119 26 12 181 9 18 58 18 323 29 30 32 45 10 7
5 40 89 4 248 43 10 17 4 5 92 12 62 53 536
23 6 27 6 14 81 24 26 137 201 33 47 55 8
16 45 56 33 391 115 597 328 73 46 11 8 573
21 229 479 47 10 9 22 40 245 961 9 32
14 65 263 21 292 646 47 103 14 10 8
388 12 102 72 38 59 25 180 52 24
30 16 43 44 29 226 323 24 18
15 86 45 503 232 16 8 70
164 74 285 118 23 6 10
310 53 51 20 18 24
101 64 17 126 20
477 38 35 63
112 12 21
25 16
71
"""
JTT_FREQUENCIES = (
    0.076748, 0.019803, 0.051544, 0.061830, 0.040126, 0.073152, 0.022944, 0.053761, 0.058676, 0.091904,
    0.023826, 0.042645, 0.050901, 0.040752, 0.051691, 0.068765, 0.058565, 0.066005, 0.014261, 0.032102,
)


@dataclass(frozen=True)
class Model:
    """A reversible model in spectral form."""

    name: str
    pi: np.ndarray
    rates: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def k(self) -> int:
        return len(self.pi)

    def p(self, t: float) -> np.ndarray:
        """Transition probabilities; the identity for t <= 0."""
        if t <= 0:
            return np.eye(self.k)
        return np.maximum((self.left * np.exp(self.rates * t)) @ self.right, 0.0)

    def derivatives(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of P by t."""
        e = np.exp(self.rates * max(t, 1e-10))
        return (self.left * (self.rates * e)) @ self.right, (self.left * (self.rates**2 * e)) @ self.right


def reversible(name: str, exchange: np.ndarray, frequencies) -> Model:
    """Model of a symmetric exchangeability matrix and (unnormalised) frequencies."""
    pi = np.asarray(frequencies, float)
    pi = pi / pi.sum()
    q = exchange * pi
    np.fill_diagonal(q, 0.0)
    q -= np.diag(q.sum(1))
    q /= -(pi * np.diag(q)).sum()
    root = np.sqrt(pi)
    rates, u = np.linalg.eigh(root[:, None] * q / root)
    rates[rates > 1e-12 * rates.min()] = 0.0  # rounding there would be all that long branches have of a slope
    return Model(name, pi, rates, u / root[:, None], u.T * root)


def jukes_cantor(k: int) -> Model:
    return reversible("JC", np.ones((k, k)), np.ones(k))


def jtt() -> Model:
    exchange = np.zeros((20, 20))
    exchange[np.triu_indices(20, 1)] = [float(x) for x in JTT_EXCHANGE.split()]
    return reversible("JTT", exchange + exchange.T, JTT_FREQUENCIES)


def gtr(exchangeabilities, frequencies) -> Model:
    """exchangeabilities in the order AC, AG, AT, CG, CT, GT."""
    if len(exchangeabilities) != 6 or len(frequencies) != 4:
        raise ValueError("GTR needs 6 exchangeabilities and 4 frequencies")
    exchange = np.zeros((4, 4))
    exchange[np.triu_indices(4, 1)] = exchangeabilities
    return reversible("GTR", exchange + exchange.T, frequencies)


def build(name: str, seq_type: str) -> Model:
    """Model by name for an alignment of type ``DNA`` or ``AA``: JTT, JC (or JCK), or
    ``GTR{ac,ag,at,cg,ct,gt/pa,pc,pg,pt}``."""
    if name == "JTT":
        if seq_type != "AA":
            raise ValueError("JTT needs an amino-acid alignment")
        return jtt()
    if name in ("JC", "JCK"):
        return jukes_cantor(20 if seq_type == "AA" else 4)
    if name.startswith("GTR{") and name.endswith("}"):
        if seq_type != "DNA":
            raise ValueError("GTR needs a DNA alignment")
        rates, _, freqs = name[4:-1].partition("/")
        return gtr([float(x) for x in rates.split(",")], [float(x) for x in freqs.split(",")] if freqs else [1.0] * 4)
    raise ValueError(f"unknown model '{name}' (supported: JTT, JC, GTR{{...}})")


def jc_same(t: Column, k: int = 4) -> Column:
    """Probability to end in the state one started in, as a Column."""
    return F.when(t <= 0, 1.0).otherwise((1 + (k - 1) * F.exp(-k * t / (k - 1))) / k)


def jc_other(t: Column, k: int = 4) -> Column:
    """Probability of each other state, as a Column."""
    return F.when(t <= 0, 0.0).otherwise((1 - F.exp(-k * t / (k - 1))) / k)


def jc_slopes(t: Column, k: int = 4) -> tuple[Column, Column, Column, Column]:
    """First derivatives (same, other) and second derivatives (same, other)."""
    at = F.when(t <= 0, F.lit(1e-10)).otherwise(t)
    e, r = F.exp(-k * at / (k - 1)), k / (k - 1)
    return -e, e / (k - 1), r * e, -r * e / (k - 1)
