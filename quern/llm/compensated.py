"""Sums and products of matrices in double-double, built on error-free transformations.

A number is held as high + low, low under half a unit of high's last place. A matrix is cut into slices whose entries
have so few bits that the product of two slices is exact in doubles, whatever the order of the sum; the exact
products are added up with two_sum, which keeps what a rounded addition loses. So a product of matrices costs a few
calls of the library's matrix product, and its error is near 2^-100 of a column's largest entries.
"""

from __future__ import annotations

import numpy as np

#: Rows whose products are added by one matrix product; slices are as wide as leaves such a sum exact.
ROWS = 1_024
BITS = (53 - ROWS.bit_length() + 1) // 2
#: Slices of BITS bits: 105 bits below a column's largest entry.
SLICES = 5


def two_sum(a, b):
    """The rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high, low, more_high, more_low=0.0):
    """The sum of two double-doubles."""
    s, e = two_sum(high, more_high)
    return fast_two_sum(s, e + (low + more_low))


def fast_two_sum(a, b):
    """two_sum where |a| >= |b|."""
    s = a + b
    return s, b - (s - a)


def quotient(high, low, n: int):
    """A double-double by a whole number under 2^53."""
    first = high / n
    p, e = two_product(first, float(n))
    return fast_two_sum(first, ((high - p) - e + low) / n)


def two_product(a, b):
    """The rounded product and its error, by halves of 26 bits."""
    halves = lambda x: (t := x * 134217729.0) - (t - x)
    a1, b1 = halves(a), halves(b)
    a2, b2 = a - a1, b - b1
    p = a * b
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """The matrix as SLICES matrices of BITS bits a column each, from its leading bits on."""
    _, top = np.frexp(np.abs(high).max(axis=0, initial=0))
    out = []
    for i in range(1, SLICES + 1):
        unit = np.ldexp(1.5, 52 + top - BITS * i)
        part = (high + unit) - unit
        high, low = two_sum(high - part, low)
        out.append(part)
    return out


class Sums:
    """Column sums of a matrix that comes in parts."""

    def __init__(self, dim: int):
        self.high, self.low = np.zeros(dim), np.zeros(dim)

    def add(self, x: np.ndarray) -> None:
        for first in range(0, len(x), ROWS):
            for part in slices(x[first : first + ROWS], np.zeros(1)):
                self.high, self.low = add(self.high, self.low, part.sum(axis=0))


class Products:
    """The sum of row^T row of a matrix that comes in parts, as double-double."""

    def __init__(self, dim: int):
        self.high, self.low = np.zeros((dim, dim)), np.zeros((dim, dim))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        for first in range(0, len(high), ROWS):
            cut = slices(high[first : first + ROWS], low[first : first + ROWS])
            for i in range(SLICES):
                for j in range(i, SLICES - i):
                    p = cut[i].T @ cut[j]
                    self.high, self.low = add(self.high, self.low, p)
                    if i != j:
                        self.high, self.low = add(self.high, self.low, p.T)
