"""Counting quotient filters over packed n-grams of word ids, without loss.

An n-gram of ids of ``width`` bits is packed into two halves of equal size. A Feistel network
permutes them, so every n-gram has exactly one place in a key space that is filled evenly, and comes
back from it. The leading bits of a key are its *slab* (the part of the key space that one filter
covers), the next ones its *quotient*, and all others its *remainder*, which is kept in full: the
filter is a lossless multiset. Entries stand in the order of their keys. As in a counting
quotient filter the quotients are not stored: a bit per quotient says whether it occurs, and a bit per
entry whether it is the last of its quotient. Counters take a byte; larger ones stand
in a list of their own.
"""

from __future__ import annotations

import numpy as np

from .texts import U, mixed

ROUNDS = 4
#: counters from here on stand in the list of large ones
LARGE = 255


def low(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


class Space:
    """The key space of n-grams of ``n`` ids below 2 ** ``width``; width at most 32, n at most 4."""

    def __init__(self, n: int, width: int):
        self.n, self.width = n, width
        self.half = -(-n * width // 2)
        if self.half > 64:
            raise ValueError("ids of more than 32 bits")

    def packed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the n-grams in the rows of ``ids``."""
        whole = [ids[:, i].astype(np.uint64) for i in range(self.n)]
        high, low_half, room = np.zeros(len(ids), U), np.zeros(len(ids), U), self.half
        for word in whole:
            if room >= self.width:  # into the high half
                high = (high << U(self.width)) | word
                room -= self.width
            elif room > 0:  # over both
                rest = self.width - room
                high = (high << U(room)) | (word >> U(rest))
                low_half = word & low(rest)
                room = 0
            else:
                low_half = (low_half << U(self.width)) | word
        return high << U(room) if room else high, low_half

    def unpacked(self, high: np.ndarray, low_half: np.ndarray) -> np.ndarray:
        at = [(self.half - self.width * (i + 1)) for i in range(self.n)]
        used = sum(a < 0 for a in at)  # ids that reach into the low half
        out = np.empty((len(high), self.n), dtype=np.int64)
        for i, a in enumerate(at):
            if a >= 0:
                word = high >> U(a)
            else:
                after = self.width * (self.n - 1 - i)
                word = low_half >> U(after) if after < 64 else np.zeros_like(low_half)
                if a > -self.width:  # its first bits end the high half
                    word = (high << U(-a)) | (word & low(-a))
            out[:, i] = (word & low(self.width)).astype(np.int64)
        return out

    def permuted(self, high: np.ndarray, low_half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = low(self.half)
        for r in range(ROUNDS):
            high, low_half = low_half, high ^ (mixed(low_half + U(r + 1)) & mask)
        return high, low_half

    def restored(self, high: np.ndarray, low_half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = low(self.half)
        for r in reversed(range(ROUNDS)):
            high, low_half = low_half ^ (mixed(high + U(r + 1)) & mask), high
        return high, low_half

    def keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.permuted(*self.packed(ids))

    def ids(self, high: np.ndarray, low_half: np.ndarray) -> np.ndarray:
        return self.unpacked(*self.restored(high, low_half))

    def counted(self, high: np.ndarray, low_half: np.ndarray, counts: np.ndarray | None = None):
        """Keys in order, each once, with the sums of their counts."""
        if 2 * self.half <= 64:
            whole = (high << U(self.half)) | low_half
            if counts is None:
                whole.sort()
            else:  # sorted runs behind each other: a merge
                order = np.argsort(whole, kind="stable")
                whole, counts = whole[order], counts[order]
            first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(whole) else np.empty(0, np.int64)
            kept = whole[first]
            keys = (kept >> U(self.half), kept & low(self.half))
        else:
            order = np.lexsort((low_half, high))
            high, low_half = high[order], low_half[order]
            counts = None if counts is None else counts[order]
            new = (high[1:] != high[:-1]) | (low_half[1:] != low_half[:-1])
            first = np.flatnonzero(np.r_[True, new]) if len(high) else np.empty(0, np.int64)
            keys = (high[first], low_half[first])
        if counts is None:
            sums = np.diff(np.r_[first, len(high)])
        else:
            sums = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
        return *keys, sums.astype(np.int64)

    def slabs(self, high: np.ndarray, bits: int) -> np.ndarray:
        """The slab of each key, by its first ``bits`` bits."""
        bits = min(bits, self.half)
        return (high >> U(self.half - bits)).astype(np.int64) if bits else np.zeros(len(high), dtype=np.int64)

    def filters(self, high: np.ndarray, low_half: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
        """(slab, filter) of keys in order, each once."""
        slabs = self.slabs(high, bits)
        cuts = np.flatnonzero(np.r_[True, slabs[1:] != slabs[:-1]]) if len(slabs) else np.empty(0, np.int64)
        ends = np.r_[cuts[1:], len(slabs)]
        return [(int(slabs[s]), self.stored(high[s:e], low_half[s:e], counts[s:e], bits)) for s, e in zip(cuts, ends)]

    def stored(self, high, low_half, counts, bits: int) -> bytes:
        bits = min(bits, self.half)
        n = len(high)
        q = min(self.half - bits, max(0, n - 1).bit_length())
        rest = self.half - bits - q
        quotients = ((high >> U(rest)) & low(q)).astype(np.int64) if rest < 64 else np.zeros(n, np.int64)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[quotients] = True
        ends = np.ones(n, dtype=bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        many = counts >= LARGE
        return b"".join(
            [
                np.array([n, bits, q, int(many.sum())], dtype=np.int64).tobytes(),
                np.packbits(occupied).tobytes(),
                np.packbits(ends).tobytes(),
                _bytes(high & low(rest), rest),
                _bytes(low_half, self.half),
                np.minimum(counts, LARGE).astype(np.uint8).tobytes(),
                counts[many].astype(np.int64).tobytes(),
            ]
        )

    def loaded(self, slab: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys and counts of a filter."""
        n, bits, q, many = (int(x) for x in np.frombuffer(blob, dtype=np.int64, count=4))
        rest, at = self.half - bits - q, 32

        def part(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(blob, dtype=np.uint8, count=size, offset=at - size)

        occupied = np.flatnonzero(np.unpackbits(part(-(-(1 << q) // 8)), count=1 << q)).astype(np.uint64)
        ends = np.unpackbits(part(-(-n // 8)), count=n).astype(np.int64)
        quotients = occupied[np.cumsum(ends) - ends]
        below = _numbers(part(n * -(-rest // 8)), n, rest)
        low_half = _numbers(part(n * -(-self.half // 8)), n, self.half)
        counts = part(n).astype(np.int64)
        counts[counts == LARGE] = np.frombuffer(blob, dtype=np.int64, count=many, offset=at)
        prefix = U(slab << (self.half - bits)) if bits else U(0)
        return prefix | (quotients << U(rest) if rest < 64 else U(0)) | below, low_half, counts


def _bytes(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each value in whole bytes, one plane per byte."""
    size = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _numbers(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    size = -(-bits // 8)
    out[:, :size] = raw.reshape(size, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)
