"""Repeatable pseudo-randomness: the same seed and key always give the same value.

A retried task, a lost executor or a different partitioning therefore never
changes a sample or a random ranking, which ``rand()`` cannot promise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A hex string whose order is an arbitrary but fixed shuffle of the keys."""
    text = [F.lit(str(seed))] + [p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *text))


def uniform(seed: int, *parts: Column) -> Column:
    """A uniform double in [0, 1) with 32 random bits, fixed by seed and key."""
    bits = F.conv(F.substring(shuffle_key(seed, *parts), 1, 8), 16, 10)
    return bits.cast("double") / F.lit(4294967296.0)
