"""Volume-delay functions as column expressions.

``v`` and ``c`` are both vehicles per hour. A capacity of zero or less gives the
free-flow time; a negative load counts as zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def vc_ratio(load: Column, capacity: Column, scale: float = 1.0) -> Column:
    """Volume over capacity; 0 without capacity."""
    c = capacity * F.lit(float(scale))
    return F.when(c > 0, F.greatest(load, F.lit(0.0)) / c).otherwise(F.lit(0.0))


def power(r: Column, beta: float) -> Column:
    """``r`` to the power ``beta``; by squaring for small whole exponents, so that the
    last bits don't depend on a library's pow."""
    if beta != int(beta) or not 0 <= beta <= 16:
        return F.pow(r, F.lit(float(beta)))
    out, base, n = None, r, int(beta)
    while n:
        if n & 1:
            out = base if out is None else out * base
        base, n = base * base, n >> 1
    return F.lit(1.0) if out is None else out


@dataclass(frozen=True)
class Bpr:
    """t = ff (1 + alpha (v / c) ^ beta)."""

    alpha: float = 0.15
    beta: float = 4.0
    scale: float = 1.0

    def __post_init__(self):
        if self.scale <= 0:
            raise ValueError("the capacity scale has to be positive")

    def cost(self, freeflow: Column, load: Column, capacity: Column) -> Column:
        return freeflow * (1.0 + self.alpha * power(vc_ratio(load, capacity, self.scale), self.beta))

    def marginal(self, freeflow: Column, load: Column, capacity: Column) -> Column:
        """What one more vehicle costs all of them."""
        return freeflow * (1.0 + self.alpha * (self.beta + 1.0) * power(vc_ratio(load, capacity, self.scale), self.beta))


@dataclass(frozen=True)
class Linear:
    """t = ff (1 + slope v / c)."""

    slope: float = 0.15
    scale: float = 1.0

    def __post_init__(self):
        if self.scale <= 0:
            raise ValueError("the capacity scale has to be positive")

    def cost(self, freeflow: Column, load: Column, capacity: Column) -> Column:
        return freeflow * (1.0 + self.slope * vc_ratio(load, capacity, self.scale))
