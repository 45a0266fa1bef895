"""Removal of repeated word windows: Rabin-Karp hashes of every window, counted by Spark.

Every window of ``width`` consecutive words of a document has a rolling hash (64 bits, and
further bits of a second hash choose the bucket that counts it). Spark deals the hashes to
buckets by value; a hash that two windows anywhere have marks both as repeated, the first
one included. Overlapping repeated windows merge into maximal removal intervals.

Null texts have no words. Texts with fewer words than a window lose nothing. Rows that
repeat, ids too, are documents of their own, so their windows repeat. Columns besides the
id and the text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .texts import U, Words, covered, pieces, runs, window_hashes

WINDOW_WORDS = 35
PIECE_BYTES = 1 << 20
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept string"


def _windows(words: Words, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows start, their hashes, and their buckets."""
    whole = words.whole(width)
    one = window_hashes(words.hashes(0), width, 0)[whole]
    two = window_hashes(words.hashes(1), width, 1)[whole]
    return np.flatnonzero(whole), one, (two >> U(20)) % U(buckets)


def _outbox(texts: list[bytes], width: int, buckets: int, span: int) -> C.Outbox:
    parts = [_windows(Words(texts[a:b]), width, buckets)[1:] for a, b in pieces(texts, PIECE_BYTES)]
    return C.Outbox(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64), span)


def remove_repeated_windows(
    docs: DataFrame,
    width: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = C.CHUNK_BYTES,
    bucket_keys: int = C.BUCKET_KEYS,
) -> DataFrame:
    """Per document: words, words removed, removal intervals (word positions, last included), kept text.

    Kept words are joined by one space. Every occurrence of a repeated window goes.
    """
    rows, size = C.in_any_chunks(docs, id_col, text_col, chunk_bytes)
    buckets = max(1, -(-size // (6 * bucket_keys)))
    span = C.span_of(buckets)

    def emit(chunk, table):
        _, texts = C.in_order(table)
        yield from _outbox(texts, width, buckets, span).rows(chunk, 0)

    def cut(key, left, right):
        table, texts = C.in_order(left)
        outbox = _outbox(texts, width, buckets, span)
        repeated = (outbox.answers(C.blobs_of(right, 0)) > 0) | (outbox.counts[outbox.inverse] > 1)
        out, done = [], 0
        for a, b in pieces(texts, PIECE_BYTES):
            words = Words(texts[a:b])
            starts = np.flatnonzero(words.whole(width))
            goes = covered(starts[repeated[done : done + len(starts)]], width, len(words.starts))
            done += len(starts)
            out.append(_kept(words, goes))
        parts = [pa.concat_arrays(column) for column in zip(*out)]
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), *parts], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    found = C.answered(C.sent(rows, emit), lambda _, arrays: C.shared_keys(arrays), {0: 1}, span, size // chunk_bytes)
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, RESULT)


def _kept(words: Words, goes: np.ndarray) -> list[pa.Array]:
    """The columns of the result for some texts; ``goes``: the words to remove."""
    n = len(words.counts)
    removed = np.r_[0, np.cumsum(goes)]
    lost = removed[words.last] - removed[words.first]
    owner = words.owner()
    # intervals, cut where a text ends
    firsts, lasts = [], []
    edge = np.ones(len(goes) + 1, dtype=bool)
    if len(goes):
        edge[1:-1] = owner[1:] != owner[:-1]
    starts, ends = runs(goes)
    if len(starts):
        borders = np.flatnonzero(edge)
        inner = borders[np.searchsorted(starts, borders, side="left") > np.searchsorted(ends, borders, side="right")]
        starts = np.union1d(starts, inner)
        ends = np.union1d(ends, inner)
        firsts, lasts = starts, ends
    firsts, lasts = np.asarray(firsts, dtype=np.int64), np.asarray(lasts, dtype=np.int64)
    holder = owner[firsts] if len(firsts) else np.empty(0, dtype=np.int64)
    base = words.first[holder]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(holder, np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(firsts - base), pa.array(lasts - base - 1)], names=["first", "last"]),
    )
    # kept words with one space after each but the last of a text
    stay = np.flatnonzero(~goes)
    edges = np.zeros(len(words.b) + 2, dtype=np.int32)
    edges[words.starts[stay]] += 1
    np.subtract.at(edges, words.ends[stay] + 1, 1)
    mask = np.cumsum(edges[: len(words.b)]) > 0
    if len(stay):
        final = np.r_[owner[stay][1:] != owner[stay][:-1], True]
        mask[words.ends[stay[final]]] = False
    b = np.where(words.space, np.uint8(32), words.b)[mask]
    at = np.r_[0, np.cumsum(mask)]
    offsets = np.r_[at[words.text_starts], at[-1] if n else 0].astype(np.int32)
    text = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b.tobytes()))
    return [pa.array(words.counts.astype(np.int64)), pa.array(lost.astype(np.int64)), spans, text]
