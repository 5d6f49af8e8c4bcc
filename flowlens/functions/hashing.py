"""Hash keys that give rows a seeded order which no engine, partition count or row order can change."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(keys: list[str], seed: int) -> Column:
    """``md5(key|key|...|seed)`` as 32 hex digits."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def unit_interval(hash_hex: Column) -> Column:
    """First 13 hex digits of a hash as a double in [0, 1)."""
    return F.conv(F.substring(hash_hex, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
