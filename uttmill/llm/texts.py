"""Whole texts as numpy arrays inside a task: words, their hashes, and hashes of windows.

All hashes are polynomials modulo 2**64 over random 64-bit symbols; they say the same for
the same content in every task and every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: bytes of text that a task turns into Python objects at a time
PORTION_BYTES = 4 << 20
#: white space that ends a word: space, and tab to carriage return
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: one random symbol per byte value, for two independent hashes
SYMBOLS = np.random.default_rng(20240229).integers(1, 2**64, size=(2, 256), dtype=np.uint64)
BASES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse modulo 2**64."""
    kept = _powers.get(which)
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 20)
        base = BASES[which]
        inverse = U(pow(int(base), -1, 2**64))
        pair = []
        for factor in (base, inverse):
            row = np.full(size, factor, dtype=np.uint64)
            row[0] = 1
            pair.append(np.multiply.accumulate(row))
        kept = (pair[0], pair[1])
        if size <= 1 << 22:  # those of a very long text are not kept
            _powers[which] = kept
    return kept


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the bytes of each span [start, end)."""
    up, down = powers(which, len(b) + 1)
    sums = np.empty(len(b) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(SYMBOLS[which][b] * up[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64))


def window_hashes(t: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every ``k`` consecutive symbols; ``len(t) - k + 1`` of them."""
    n = len(t) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = int(BASES[which])
    part, size, out, done = t, 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = part
            else:
                # the windows so far, followed by ``size`` further symbols
                m = len(part) - done
                out = out[:m] * U(pow(base, size, 2**64)) + part[done : done + m]
            done += size
        if done == k:
            return out[:n]
        m = len(part) - size
        part = part[:m] * U(pow(base, size, 2**64)) + part[size : size + m]
        size *= 2


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def portions(batches, column: int, most: int = PORTION_BYTES):
    """Record batches of about ``most`` bytes in a text column; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def pieces(texts: list[bytes], most: int):
    """Consecutive texts of about ``most`` bytes, as (first, last) positions; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def laid_out(texts: list[bytes], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts behind each other, ``gap`` before and after each; their starts and ends."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    b = np.frombuffer(gap + gap.join(texts) + gap if texts else b"", dtype=np.uint8)
    starts = np.cumsum(lengths + len(gap)) - lengths
    return b, starts, starts + lengths


class Words:
    """The words of some texts: ``b`` bytes, ``starts``/``ends`` of words, ``first``/``last`` word of each text."""

    def __init__(self, texts: list[bytes]):
        self.b, self.text_starts, self.text_ends = laid_out(texts, b"\n")
        space = SPACES[self.b]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.last = np.searchsorted(self.starts, self.text_ends)
        self.counts = self.last - self.first
        self.space = space

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.b, self.starts, self.ends, which)

    def owner(self) -> np.ndarray:
        """The position of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def whole(self, k: int) -> np.ndarray:
        """Which windows of ``k`` words lie within one text."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        owner = self.owner()
        return owner[:n] == owner[k - 1 :]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that starts at one of ``starts``."""
    edges = np.zeros(n + 1, dtype=np.int32)
    edges[starts] += 1
    np.subtract.at(edges, starts + width, 1)
    return np.cumsum(edges[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true as starts and ends (exclusive)."""
    padded = np.zeros(len(mask) + 2, dtype=np.int8)
    padded[1:-1] = mask
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
