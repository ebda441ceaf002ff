"""The slope of a branch's log-likelihood as a curve: numbers of a fixed count that add up.

A slope is a sum over patterns, and so is each of its values on a grid of lengths. Blocks of
an alignment give their values once; the sums fix piecewise Chebyshev polynomials in the
logarithm of the length, and a search then takes all its steps on these without another
look at the patterns. How fast a piece's coefficients fall tells how far it can be trusted.
"""

from __future__ import annotations

import numpy as np

from .likelihood import FLOOR
from .models import Model
from .optimize import LEAST, MOST, climbed

PIECES, NODES = 12, 32
#: Values of a curve.
SIZE = PIECES * NODES
#: A piece is trusted if its last coefficients are below this share of its largest one, or
#: if the log-likelihood that they stand for is below a hundredth of this number.
SHARE = 1e-9

_low = np.log(LEAST)
_half = (np.log(MOST) - _low) / PIECES / 2
_angles = np.pi * (np.arange(NODES) + 0.5) / NODES
_middles = _low + _half * (2 * np.arange(PIECES) + 1)
LENGTHS = np.exp(_middles[:, None] + _half * np.cos(_angles)).ravel()
#: Node values to Chebyshev coefficients.
_TO_COEFFICIENTS = np.cos(np.outer(_angles, np.arange(NODES))) * np.where(np.arange(NODES) == 0, 1, 2) / NODES


def _slowest(model: Model) -> float:
    """The slowest rate but zero: every slope falls at least as fast as its exponential, which
    curves leave out so that their tails keep their digits."""
    return float(-model.rates[model.rates < 0].max())


def values(model: Model, s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(branches, SIZE) of sum tables (branches, states, patterns): slopes by the length at
    ``LENGTHS``, without the slowest exponential."""
    rates = model.rates
    like = np.exp(np.outer(LENGTHS, rates)) @ s
    first = (rates * np.exp(np.outer(LENGTHS, np.where(rates < 0, rates + _slowest(model), 0.0)))) @ s
    np.maximum(like, FLOOR, out=like)
    first /= like
    return first @ weights


def best(model: Model, curves: np.ndarray, t: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, sure) that the steps of ``optimize.newton_many`` lead to from ``t`` on curves
    (branches, SIZE); sure: every piece on the way can be trusted."""
    slowest = _slowest(model)
    c = curves.reshape(-1, PIECES, NODES) @ _TO_COEFFICIENTS
    d = np.moveaxis(np.polynomial.chebyshev.chebder(np.moveaxis(c, -1, 0)), 0, -1) / _half
    tail = np.abs(c[..., -3:]).max(-1)
    worth = np.exp(_middles + _half - slowest * np.exp(_middles - _half))  # a slope's most by the logarithm
    trusted = (tail <= share * np.abs(c).max(-1)) | (tail * worth <= share / 100)
    sure = np.ones(len(c), bool)

    def sums(rows: np.ndarray, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece = np.clip(((x - _low) / (2 * _half)).astype(int), 0, PIECES - 1)
        sure[rows] &= trusted[rows, piece]
        angle = np.arccos(np.clip((x - _middles[piece]) / _half, -1.0, 1.0))
        waves = np.cos(angle[:, None] * np.arange(NODES))
        y, bent = (c[rows, piece] * waves).sum(1), (d[rows, piece] * waves[:, :-1]).sum(1)
        fall = np.exp(-slowest * length)
        return fall * y, fall * length * (y + bent - slowest * length * y)

    return climbed(sums, t)[0], sure
