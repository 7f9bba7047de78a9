"""Counter-based random numbers: each is a hash of a seed, a stream and an id, so the same whatever the partitioning, and in any engine with md5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of a hash that make one number; they fit a double's mantissa.
DIGITS = 13


def digest(seed: int, stream: str, *ids: Column) -> Column:
    """Hex digest of seed, stream and ids (as text, null as empty)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *(F.coalesce(i.cast("string"), F.lit("")) for i in ids)))


def uniform(seed: int, stream: str, *ids: Column) -> Column:
    """DOUBLE in [0, 1)."""
    return F.conv(F.substring(digest(seed, stream, *ids), 1, DIGITS), 16, 10).cast("bigint").cast("double") * F.lit(2.0 ** (-4 * DIGITS))


def normal(seed: int, stream: str, *ids: Column) -> Column:
    """Standard normal by Box and Muller's transform of two uniform numbers."""
    u, v = uniform(seed, f"{stream}/r", *ids), uniform(seed, f"{stream}/a", *ids)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def choice(seed: int, stream: str, values: tuple[str, ...], *ids: Column, shares: list[float] | None = None) -> Column:
    """One of values, alike or by shares that add up to 1."""
    u = uniform(seed, stream, *ids)
    if shares is None:
        return F.get(F.array(*map(F.lit, values)), F.floor(u * F.lit(float(len(values)))).cast("int"))
    out, upto = F.lit(values[-1]), math.fsum(shares)
    for value, share in zip(reversed(values[:-1]), reversed(shares[1:]), strict=True):
        upto -= share
        out = F.when(u < F.lit(upto), F.lit(value)).otherwise(out)
    return out
