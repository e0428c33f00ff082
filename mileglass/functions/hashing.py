"""Engine-neutral hashes for repeatable sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(key: Column, seed: int, hex_digits: int = 8) -> Column:
    """The first hex digits of md5("<seed>:<key>") as a bigint.

    Depends on the key alone, so unlike a Bernoulli sample it gives the same
    rows under any partitioning.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def hash_fraction(key: Column, fraction: float, seed: int) -> Column:
    """True for about ``fraction`` of the keys, in steps of 1/10000."""
    return md5_number(key, seed) % 10000 < round(fraction * 10000)
