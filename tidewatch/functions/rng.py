"""Random draws as a function of (seed, name, place, number): the same on every engine, machine and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, name: str, *at: Column | int) -> Column:
    """Uniform in [0, 1): the first 32 bits of the MD5 of the parts, joined by colons."""
    parts = [F.lit(str(seed)), F.lit(name), *((a if isinstance(a, Column) else F.lit(a)).cast("string") for a in at)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def below(u: Column, n: Column | int) -> Column:
    """A whole number under ``n`` from a draw."""
    return F.floor(u * n).cast("long")
