"""Multiplicative hashes of vertex ids as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of the hashes.
GOLDEN, PRIME = 2654435769, 2654435761
_MOD = 1 << 32


def _multiply(x: Column, factor: int) -> Column:
    """x * factor mod 2^32, without leaving 64 bits: the high half of x times 2^32 vanishes, its low 16 bits are split off."""
    x = F.pmod(x.cast("long"), F.lit(_MOD))
    high, low = F.shiftright(x, 16), F.pmod(x, F.lit(1 << 16))
    return F.pmod(F.pmod(high * F.lit(factor), F.lit(1 << 16)) * F.lit(1 << 16) + low * F.lit(factor), F.lit(_MOD))


def golden_hash(x: Column) -> Column:
    return _multiply(x, GOLDEN)


def prime_hash(x: Column) -> Column:
    return _multiply(x, PRIME)


def parity_hash(x: Column) -> Column:
    return F.pmod(x.cast("long"), F.lit(2))
