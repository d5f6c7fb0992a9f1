"""Seeded draws: a key's place in a random order that no layout can change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """The md5 of seed and key; sorting by it is a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def cell(drawn: Column, digits: int) -> Column:
    """One of ``16 ** digits`` equal slices of the draw order."""
    return F.conv(F.substring(drawn, 1, digits), 16, 10).cast("int")
