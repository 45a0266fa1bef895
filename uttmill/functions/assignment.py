"""Cheapest assignment of rows to columns of small cost tables, by shortest augmenting paths.

A table of r rows and c columns (r <= c) costs r * r * c steps, so twelve speakers are as
little a matter as two.  Among equally cheap assignments the first in dictionary order counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cheapest(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each row, row prices, column prices) of a square table of whole numbers.

    Rows join one after the other; each takes the shortest path of price differences to a free
    column and moves the rows along that path.  ``cost - row - column`` is never negative
    and is zero where a row has its column.
    """
    n = len(cost)
    row_price, col_price = np.zeros(n, np.int64), np.zeros(n, np.int64)
    row_of, col_of = np.full(n, -1), np.full(n, -1)
    for start in range(n):
        far = np.full(n, np.iinfo(np.int64).max // 2)
        came, done = np.full(n, -1), np.zeros(n, dtype=bool)
        seen, row, reached = [start], start, 0
        while True:
            through = reached + cost[row] - row_price[row] - col_price
            nearer = ~done & (through < far)
            far[nearer], came[nearer] = through[nearer], row
            col = int(np.where(done, np.iinfo(np.int64).max, far).argmin())
            reached, done[col] = far[col], True
            if row_of[col] < 0:
                break
            row = row_of[col]
            seen.append(row)
        for r in seen:
            row_price[r] += reached - (0 if r == start else far[col_of[r]])
        col_price[done] -= reached - far[done]
        while True:
            row_of[col] = row = came[col]
            col_of[row], col = col, col_of[row]
            if row == start:
                break
    return col_of, row_price, col_price


def _first_of_equals(tight: np.ndarray, col_of: np.ndarray, rows: int) -> np.ndarray:
    """The first assignment in dictionary order within the pairs that may be used (``tight``).

    A row tries smaller columns; the row that had one has to find another by a path over rows that are not settled yet.
    """
    row_of = np.empty_like(col_of)
    row_of[col_of] = np.arange(len(col_of))

    def moved(row: int, banned: set[int], free: int, settled: int) -> bool:
        for col in np.flatnonzero(tight[row]):
            if int(col) in banned:
                continue
            banned.add(int(col))
            other = row_of[col]
            if col == free or (other > settled and moved(other, banned, free, settled)):
                col_of[row], row_of[col] = col, row
                return True
        return False

    for row in range(rows):
        for col in np.flatnonzero(tight[row, : col_of[row]]):
            other = row_of[col]
            if other < row:
                continue
            old = col_of[row]
            if moved(other, {int(col)}, old, row):
                col_of[row], row_of[col] = col, row
                break
    return col_of


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row, first in dictionary order among the cheapest; at most as many rows as columns."""
    rows, cols = cost.shape
    square = np.zeros((cols, cols), dtype=np.int64)
    square[:rows] = cost
    col_of, row_price, col_price = cheapest(square)
    tight = square - row_price[:, None] - col_price[None, :] == 0
    return _first_of_equals(tight, col_of, rows)[:rows]


def best_assignment(costs: Column) -> Column:
    """STRUCT<assignment, total> of a column ARRAY<ARRAY<BIGINT>>, row by row; null for a null, empty or ragged table."""

    @F.pandas_udf("struct<assignment:array<bigint>,total:bigint>")
    def solve(tables: pd.Series) -> pd.DataFrame:
        out = []
        for table in tables:
            rows = [] if table is None else [np.asarray(r, dtype=np.int64) for r in table if r is not None]
            if not rows or len(rows) > len(rows[0]) or any(len(r) != len(rows[0]) for r in rows):
                out.append((None, None))
                continue
            cost = np.stack(rows)
            found = assign(cost)
            out.append((found.tolist(), int(cost[np.arange(len(cost)), found].sum())))
        return pd.DataFrame(out, columns=["assignment", "total"]).astype({"total": "Int64"})

    return solve(costs)
