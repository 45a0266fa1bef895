"""Alignment counts of two token arrays.

Spark has an edit distance but no alignment counts.  The Arrow function below is
the one helper: a step advances the tables of costs of many pairs by one reference
token, and only a band of one row of each is kept, as wide as the distance of the pairs
asks for.  It sees whole token lists.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import REPORT_WEIGHTS

_COUNTS = "struct<corr:bigint,sub:bigint,del:bigint,ins:bigint>"


#: pairs whose tables of costs advance together, and the tokens they have at most; a longer pair goes alone
PAIRS = 256
TOKENS = 1 << 19
#: diagonals on either side of a group's own that the first band has
FIRST_BAND = 16


def _band(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, low: int, high: int, weights: Sequence[int]):
    """(cost, substitutions) of pairs, along paths whose column - row stays within ``low``..``high``.

    A cell is one integer: cost, room for a place, substitutions.  Costs are whole numbers, and an
    insertion run ending at j started at some k <= j: the running minimum of
    (cost - ins*k, -k, substitutions) finds all runs of a row.  One step
    advances all pairs by one reference token; a pair whose reference is over keeps its row.
    Place b of row i is column i + low + b, so the cell above left has the same place.
    """
    w_sub, w_del, w_ins = weights
    pairs, width, rows = len(n), high - low + 1, left.shape[1]
    before, at = max(0, -low), np.arange(width, dtype=np.int64)
    # more than any path costs
    never = w_del * rows + w_ins * (rows + width) + w_sub + 1
    sub_bits = int(rows + 1).bit_length()
    bits = sub_bits + int(width).bit_length()
    subs_only, cost_only = (1 << sub_bits) - 1, ~((1 << bits) - 1)
    # the hypotheses with as many empty tokens before and behind as the band sees
    wide = np.full((pairs, before + right.shape[1] + rows + width), -2, dtype=np.int64)
    wide[:, before : before + right.shape[1]] = right
    # columns below 0 are never reached; what lies behind the last column reaches nothing that counts
    cells = np.repeat((np.where(low + at >= 0, w_ins * (low + at), never) << bits)[None, :], pairs, axis=0)
    run = (w_ins * at) << bits
    start, changed, lost = ((width - at) << sub_bits) - run, (w_sub << bits) + 1, w_del << bits
    shortest = int(n.min(initial=0))
    for i in range(rows):
        seen = i + low + before
        new = (wide[:, seen : seen + width] != left[:, i : i + 1]) * np.int64(changed)
        new += cells
        down = cells[:, 1:] + lost
        np.copyto(new[:, :-1], down, where=down < (new[:, :-1] & cost_only))
        new += start
        np.minimum.accumulate(new, axis=1, out=new)
        new &= cost_only | subs_only
        new += run
        if i >= shortest:
            new = np.where((i >= n)[:, None], cells, new)
        cells = new
    last = cells[np.arange(pairs), m - n - low]
    return last >> bits, last & subs_only


def align_all(refs: list[np.ndarray], hyps: list[np.ndarray], weights: Sequence[int]) -> np.ndarray:
    """Rows (corr, sub, del, ins) of the cheapest alignments; ties go to match-or-sub, del, ins.

    Only a band of diagonals is filled.  A path that leaves it has so many insertions and
    deletions more than the lengths ask for; if the cost found is below what these cost, no such path is as
    cheap and the result is that of the whole table.  The other pairs get a band of twice the width, or
    the one that their cost so far shows to be enough.
    """
    w_sub, w_del, w_ins = weights
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (refs, hyps))
    left, right = (np.full((len(refs), int(k.max(initial=0))), fill, dtype=np.int64) for k, fill in ((n, -1), (m, -2)))
    for table, side in ((left, refs), (right, hyps)):
        for row, tokens in zip(table, side):
            row[: len(tokens)] = tokens
    total, sub = np.zeros(len(refs), np.int64), np.zeros(len(refs), np.int64)
    todo, reach = np.arange(len(refs)), FIRST_BAND
    while len(todo):
        k, l = n[todo], m[todo]
        shift = l - k
        low, high = min(0, int(shift.min())) - reach, max(0, int(shift.max())) + reach
        if high - low > l.max() // 2:  # as good as the whole table
            low, high = -int(k.max()), int(l.max())
        cost, subs = _band(left[todo, : k.max()], right[todo, : l.max()], k, l, low, high, weights)
        above = np.where(high >= l, np.inf, w_ins * (high + 1) + w_del * (high + 1 - shift))
        below = np.where(-low >= k, np.inf, w_del * (1 - low) + w_ins * (shift + 1 - low))
        sure = cost < np.minimum(above, below)
        total[todo[sure]], sub[todo[sure]] = cost[sure], subs[sure]
        if not sure.all():
            # the cost found is a bound: a band that wide is sure to do
            enough = int(cost[~sure].max()) // (w_ins + w_del) + 1
            reach = enough if enough <= 8 * reach else 4 * reach
        todo = todo[~sure]
    # rest = w_del*del + w_ins*ins and del - ins = n - m
    rest = total - w_sub * sub
    ins = (rest - w_del * (n - m)) // (w_del + w_ins)
    dele = ins + n - m
    return np.stack([n - sub - dele, sub, dele, ins], axis=1)


def align_counts(ref: np.ndarray, hyp: np.ndarray, weights: Sequence[int]) -> tuple[int, int, int, int]:
    """(corr, sub, del, ins) of one pair."""
    return tuple(int(x) for x in align_all([ref], [hyp], weights)[0])


def _alike(n: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """Pairs in groups of at most ``PAIRS`` whose references differ in length by a quarter, and whose diagonals are close."""
    step = np.floor(np.log(n + 1) / np.log(1.25)).astype(np.int64)
    shift = (m - n) // (2 * FIRST_BAND)
    order = np.lexsort((shift, step))
    new = (np.diff(step[order]) != 0) | (np.diff(shift[order]) != 0)
    parts = np.split(order, np.flatnonzero(new) + 1)
    # the tables of a group are as wide as its longest pair
    sizes = [min(PAIRS, max(1, TOKENS // int((n + m)[part].max(initial=1) or 1))) for part in parts]
    return [part[i : i + size] for part, size in zip(parts, sizes) for i in range(0, len(part), size)]


def coded_tokens(refs: pa.Array, hyps: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Two lists of token arrays as numbers, equal for equal tokens; null is empty.  No token becomes a Python object."""
    sides = [x.cast(pa.list_(pa.large_string())) for x in (refs, hyps)]
    tokens = pa.concat_arrays([x.flatten() for x in sides])
    codes = tokens.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in sides]).astype(np.int64)
    parts = np.split(codes, np.cumsum(lengths)[:-1]) if len(lengths) else []
    return parts[: len(refs)], parts[len(refs) :]


def edit_counts(ref: Column, hyp: Column, weights: Sequence[int] = REPORT_WEIGHTS) -> Column:
    """corr, sub, del and ins of two ARRAY<STRING> columns; null is empty."""
    weights = tuple(int(w) for w in weights)

    @F.arrow_udf(_COUNTS)
    def counts(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        left, right = coded_tokens(refs, hyps)
        n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
        out = np.zeros((len(refs), 4), dtype=np.int64)
        for part in _alike(n, m):
            out[part] = align_all([left[k] for k in part], [right[k] for k in part], weights)
        return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(4)], names=["corr", "sub", "del", "ins"])

    return counts(ref, hyp)
