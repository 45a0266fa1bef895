"""Clipped n-gram matches of two token arrays.

The Arrow function below is the one helper: it counts the n-grams of many pairs at once, where
their rows are, so that no n-gram becomes a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .edits import coded_tokens

#: tokens whose n-grams are counted together; a longer pair is counted by itself
TOKENS = 1 << 18


def _matches(codes: list[np.ndarray], n: np.ndarray, m: np.ndarray, max_n: int) -> np.ndarray:
    """Rows (matched, ref, hyp) per order, of pairs whose tokens follow each other: all references, then all hypotheses."""
    lengths, pairs = np.concatenate([n, m]), len(n)
    row = np.repeat(np.concatenate([np.arange(pairs)] * 2), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(row))
    is_ref = np.arange(len(row)) < n.sum()
    code = pd.factorize(np.concatenate(codes) if codes else np.zeros(0, np.int64))[0].astype(np.int64)
    symbols = int(code.max(initial=0)) + 1
    out = np.zeros((pairs, max_n, 3), dtype=np.int64)
    # a gram is a number: that of the gram without its last token, or at first the pair, and the last token
    at, gram = np.arange(len(row)), row
    for k in range(max_n):
        inside = left[at] > k
        at = at[inside]
        gram, distinct = pd.factorize(gram[inside].astype(np.int64) * symbols + code[at + k])
        ref = is_ref[at]
        r, h = np.bincount(gram[ref], minlength=len(distinct)), np.bincount(gram[~ref], minlength=len(distinct))
        owner = np.zeros(len(distinct), dtype=np.int64)
        owner[gram] = row[at]
        for i, count in enumerate((np.minimum(r, h), r, h)):
            out[:, k, i] = np.bincount(owner, weights=count, minlength=pairs)
    return out.reshape(pairs, -1)


def gram_matches(ref: Column, hyp: Column, max_n: int) -> Column:
    """ARRAY<BIGINT> of two ARRAY<STRING> columns: matched, ref and hyp n-grams of the order 1, then 2, …; null is empty."""
    width = 3 * max_n

    @F.arrow_udf("array<bigint>")
    def counts(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        left, right = coded_tokens(refs, hyps)
        n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
        out = np.zeros((len(n), width), dtype=np.int64)
        part = np.cumsum(n + m) // TOKENS
        for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                out[rows] = _matches([left[i] for i in rows] + [right[i] for i in rows], n[rows], m[rows], max_n)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * width, pa.int32()), pa.array(out.reshape(-1)))

    return counts(ref, hyp)
