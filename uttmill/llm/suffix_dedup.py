"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``width`` bytes only, most significant digit
first, and a suffix leaves the sort as soon as its group decides it. Groups that are still
equal after the last digit are exactly the repeated windows.

The digits:

1. The smallest hash of the 32-byte strings in the window (with its place in the window).
   Consecutive suffixes have the same one, so a *run* of about 35 suffixes is one entry. A
   run whose digit no other run has is unique: all its suffixes leave.
2. All the bytes that the windows of the run cover. Runs equal in them are equal in every
   suffix: all but the first are repeats and leave. Firsts stay only while their group of
   the first digit still holds another string.
3. All ``width`` bytes of each single suffix of the runs that are left.

Groups are compared as in ``chunks``: chunks follow the order of ids, so the first chunk
that has a string holds the earlier start.

Null texts are empty. Texts shorter than ``width`` bytes lose nothing. Rows that repeat,
ids too, are documents of their own, ordered by text; equal ones in any order, which changes
no result but that of their swap. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .texts import SYMBOLS, U, covered, laid_out, mixed, pieces, powers, runs, window_hashes

WINDOW_BYTES = 100
DIGIT_BYTES = 32
PIECE_BYTES = 1 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
LOW32 = U(0xFFFFFFFF)


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every ``k`` consecutive values."""
    size, part = 1, values
    while 2 * size <= k:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    if size < k:
        part = np.minimum(part[: len(part) - (k - size)], part[k - size :])
    return part


class Runs:
    """The runs of suffixes of some texts."""

    def __init__(self, texts: list[bytes], width: int, digit: int):
        self.width = width
        self.b, self.text_starts, self.text_ends = laid_out(texts)
        n = len(self.b) - width + 1
        empty = np.empty(0, dtype=np.int64)
        self.first, self.last, self.digit, self.content = empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        if n <= 0:
            return
        grams = mixed(window_hashes(SYMBOLS[0][self.b], digit, 0))
        packed = grams & ~LOW32
        packed |= np.arange(len(grams), dtype=np.uint64)
        place = (smallest(packed, width - digit + 1) & LOW32).astype(np.int64)
        # suffixes too short for a window have no entry
        fits = np.zeros(n, dtype=bool)
        for s, e in zip(self.text_starts, self.text_ends - width + 1):
            if e > s:
                fits[s:e] = True
        starts = np.flatnonzero(fits)
        if not len(starts):
            return
        place = place[starts]
        new = np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]
        self.first = starts[new]
        self.last = starts[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]
        at = place[new]
        self.digit = grams[at]
        up, down = powers(1, len(self.b) + 1)
        sums = np.empty(len(self.b) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(SYMBOLS[1][self.b] * up[: len(self.b)], out=sums[1:])
        whole = (sums[self.last + width] - sums[self.first]) * down[self.first]
        self.content = mixed(whole + ((at - self.first).astype(np.uint64) << U(32)) + (self.last - self.first).astype(np.uint64))

    def starts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes of the chosen runs, and the position of each one's run among them."""
        lengths = (self.last - self.first + 1)[chosen]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        begin = np.cumsum(lengths) - lengths
        return self.first[chosen][owner] + np.arange(len(owner)) - begin[owner], owner

    def window_keys(self, starts: np.ndarray) -> np.ndarray:
        """Two hashes of the bytes of each window."""
        out = np.empty((len(starts), 2), dtype=np.uint64)
        if len(starts):
            for which in (0, 1):
                h = window_hashes(SYMBOLS[which][self.b], self.width, which)
                out[:, which] = mixed(h[starts])
        return out


def remove_repeated_bytes(
    docs: DataFrame,
    width: int = WINDOW_BYTES,
    digit: int = DIGIT_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = C.CHUNK_BYTES,
    bucket_keys: int = C.BUCKET_KEYS,
) -> DataFrame:
    """Per document: bytes, bytes removed, removed spans (end exclusive), and the bytes that stay.

    A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a
    document with a smaller id, or in the same one further left.
    """
    digit = min(digit, width)
    rows, size = C.in_chunks(docs, id_col, text_col, chunk_bytes)
    buckets = max(1, -(-size // (24 * bucket_keys)))
    span, chunks = C.span_of(buckets), size // chunk_bytes

    def parts_of(texts):
        for a, b in pieces(texts, PIECE_BYTES):
            yield Runs(texts[a:b], width, digit)

    def digits(parts):
        """Outboxes of the first two digits, and which occurrences of a run the chunk itself shows to be repeats."""
        digit_of = np.concatenate([p.digit for p in parts])
        both = np.stack([np.concatenate([p.content for p in parts]), digit_of], axis=1)
        content = C.Outbox(both, (mixed(both[:, 0] ^ both[:, 1]) % U(buckets)).astype(np.int64), span)
        # one entry for each first digit: its only string, or 0 if the chunk has several
        own = both[content.firsts]
        one = C.Outbox(own[:, 1].copy(), np.zeros(len(own), dtype=np.int64))
        string = np.where(one.counts > 1, U(0), own[one.firsts, 0])
        pair = np.stack([own[one.firsts, 1], string], axis=1)
        first = C.Outbox(pair, (mixed(pair[:, 0].copy()) % U(buckets)).astype(np.int64), span)
        return digit_of, content, own, one, first

    def emit_digits(chunk, table):
        _, texts = C.in_order(table)
        parts = list(parts_of(texts))
        if parts and sum(len(p.first) for p in parts):
            _, content, _, _, first = digits(parts)
            yield from content.rows(chunk, 1)
            yield from first.rows(chunk, 2)

    def decide(kind, arrays):
        if kind != 2:
            return C.later_keys(arrays)
        # does a first digit have several strings?
        order, new, sizes = C.grouped([a[:, :1] for a in arrays])
        strings = np.concatenate(arrays)[order, 1]
        begin = np.flatnonzero(new)
        several = (np.minimum.reduceat(strings, begin) != np.maximum.reduceat(strings, begin)) | (strings[begin] == 0)
        out = np.empty(len(order), dtype=np.uint8)
        out[order] = several[np.cumsum(new) - 1]
        return np.split(out, np.cumsum(sizes)[:-1])

    def judged(parts, right):
        """Per run: 0 unique, 1 repeat, 2 undecided."""
        _, content, own, one, first = digits(parts)
        repeat = (content.answers(C.blobs_of(right, 1)) > 0) | ~content.local_first()
        several = first.answers(C.blobs_of(right, 2)) > 0
        # from first digits back to their strings, then to all runs
        open_string = several[one.inverse]
        verdict = np.where(repeat, 1, np.where(open_string[content.inverse], 2, 0)).astype(np.uint8)
        return verdict

    def windows(parts, verdict):
        keys, done = [], 0
        for p in parts:
            left = np.flatnonzero(verdict[done : done + len(p.first)] == 2)
            done += len(p.first)
            keys.append(p.window_keys(p.starts(left)[0]))
        keys = np.concatenate(keys)
        return C.Outbox(keys[:, 0].copy(), ((keys[:, 1] >> U(20)) % U(buckets)).astype(np.int64), span)

    def emit_windows(chunk, table, right):
        _, texts = C.in_order(table)
        parts = list(parts_of(texts))
        if parts and sum(len(p.first) for p in parts):
            verdict = judged(parts, right)
            yield chunk, 4, -1 - chunk, verdict.tobytes()
            yield from windows(parts, verdict).rows(chunk, 3)

    def cut(key, left, right):
        table, texts = C.in_order(left)
        parts = list(parts_of(texts))
        verdict, late = np.empty(0, dtype=np.uint8), np.empty(0, dtype=bool)
        if parts and sum(len(p.first) for p in parts):
            verdict = np.frombuffer(C.blobs_of(right, 4)[-1 - key[0].as_py()], dtype=np.uint8)
            outbox = windows(parts, verdict)
            late = (outbox.answers(C.blobs_of(right, 3)) > 0) | ~outbox.local_first()
        out, done, seen = [], 0, 0
        for p in parts:
            mine = verdict[done : done + len(p.first)]
            done += len(p.first)
            single = p.starts(np.flatnonzero(mine == 2))[0]
            goes = single[late[seen : seen + len(single)]]
            seen += len(single)
            whole = p.starts(np.flatnonzero(mine == 1))[0]
            out.append(_kept(p, covered(np.concatenate([goes, whole]), width, len(p.b))))
        names = ["doc_id", "n_bytes", "n_removed", "removed", "kept"]
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), *[pa.concat_arrays(c) for c in zip(*out)]], names=names)

    one = C.answered(C.sent(rows, emit_digits), decide, {1: 2, 2: 2}, span, chunks)
    two = C.answered(C.sent_again(rows, one, emit_windows), decide, {3: 1}, span, chunks)
    return rows.groupBy("chunk").cogroup(two.groupBy("chunk")).applyInArrow(cut, RESULT)


def _kept(part: Runs, goes: np.ndarray) -> list[pa.Array]:
    n = len(part.text_starts)
    removed = np.r_[0, np.cumsum(goes)]
    lost = removed[part.text_ends] - removed[part.text_starts]
    starts, ends = runs(goes)
    if len(starts):  # spans end where a text ends
        inner = part.text_starts[part.text_starts < part.text_ends]
        inner = inner[np.searchsorted(starts, inner, side="left") > np.searchsorted(ends, inner, side="right")]
        starts, ends = np.union1d(starts, inner), np.union1d(ends, inner)
    holder = np.searchsorted(part.text_ends, starts, side="right")
    base = part.text_starts[holder] if len(starts) else starts
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(holder, np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"]),
    )
    stays = ~goes
    at = np.r_[0, np.cumsum(stays)]
    offsets = np.r_[at[part.text_starts], at[-1]].astype(np.int32)
    kept = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(part.b[stays].tobytes())])
    return [pa.array((part.text_ends - part.text_starts).astype(np.int64)), pa.array(lost.astype(np.int64)), spans, kept]
