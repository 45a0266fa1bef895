"""Randomness as a function of (seed, key).

``md5(seed | key)`` orders rows and picks slots, so a draw never depends on
partitioning, retries or the order in which tasks run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int | str | Column, *cols: Column) -> Column:
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", first.cast("string"), *[c.cast("string") for c in cols]))


def leading_number(digest: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as BIGINT."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def unit(digest: Column) -> Column:
    """A digest as a number in [0, 1)."""
    return leading_number(digest).cast("double") / F.lit(4294967296.0)


def slot(seed: int | str | Column, n: Column | int, *cols: Column) -> Column:
    """A number in 0..n-1 drawn from (seed, cols).

    48 bits of the digest, so that every row of a very large pool can be drawn.
    """
    size = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(leading_number(shuffle_key(seed, *cols), 12), size.cast("bigint"))


def uniform(seed: int | str | Column, low: float, high: float, *cols: Column) -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * unit(shuffle_key(seed, *cols))
