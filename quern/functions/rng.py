"""Randomness as a function of values: the same draw on any partitioning, and in any engine that has md5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, *keys: Column) -> Column:
    """In (0, 1), fixed by the seed, the tag and the keys."""
    h = F.md5(F.concat_ws("|", F.lit(f"{seed}|{tag}"), *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)


def normal(seed: int, tag: str, *keys: Column) -> Column:
    """Standard normal, by the Box-Muller transform of two uniforms."""
    a, b = uniform(seed, f"{tag}|a", *keys), uniform(seed, f"{tag}|b", *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(a)) * F.cos(F.lit(2 * math.pi) * b)


def race(u: Column, weight: Column) -> Column:
    """Key of an exponential race: the m smallest keys are m successive weighted draws without replacement."""
    return -F.ln(u) / weight
