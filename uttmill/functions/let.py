"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row.

    An expression used inside a lambda is computed again for every element, also if a
    column of an earlier ``select`` stands for it, as the optimizer merges projections.
    A lambda variable is a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
