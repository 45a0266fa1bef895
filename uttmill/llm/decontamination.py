"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A document leaks an item if some stretch of its words is within ``share`` of the item's
length in word edits (exact edit distance). Words are lower case; ASCII punctuation ends them.

1. *Sieve.* An item with e allowed edits is cut into e + 1 pieces. A stretch within e edits keeps
   one piece whole, so a place that is not e places or less from where some item would start
   by a whole piece cannot begin a leak. The sieve only says where windows begin, not of which item.
2. *Embedding.* From each place left the CGK random walk embeds the item-sized windows, of all item lengths
   at once: at each step it writes the word under a pointer and moves on
   if a random bit of (walk, step, word) says so; what lies behind the size of the window is no word.
   Few edits become few differing places.
3. *Bit sampling.* A repetition samples ``SAMPLED`` places of a walk, and the words there are the bucket. The
   items of a length lie in the buckets of their embeddings, and a window meets those in its own. The number of
   repetitions of a length is that which finds ``recall`` of simulated items with the largest allowed number of edits
   (``MOST_TIMES`` at most, which shares far above a fifth may ask for).
4. *Verification.* Candidates are verified by the exact edit distance to the best stretch around them.

Items are broadcast in blocks of at most ``BLOCK_BYTES``; larger benchmarks take several
passes. Items under ``min_words`` words are not searched, as they say too little.

Null and empty texts and items match nothing. A null item id is reported as null. Rows that
repeat are each reported. Extra columns stay in ``drop_leaks`` whatever their names. An
empty table of documents or items gives no leaks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import U, Words, mixed, pieces, portions, window_hashes

SHARE = 0.2
MIN_WORDS = 5
RECALL = 0.99
SAMPLED = 4
WALKS = 8
#: simulated items of a length, and repetitions at most
SIMULATED = 300
MOST_TIMES = 256
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 4 << 20
WINDOW_BLOCK = 1024
SIEVE_BITS = 22
#: A-Z become a-z is left to str.lower; ASCII characters that are no letter or digit end words
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    return b"" if text is None else text.lower().encode("utf-8", "surrogatepass").translate(PLAIN)


def embed(windows: np.ndarray, walk: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The CGK embedding of each row of word hashes by the random bits of a walk: the word of each step, and where the pointer stood."""
    n, k = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    out, where = np.empty((n, steps), dtype=np.uint64), np.empty((n, steps), dtype=np.int64)
    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    for step in range(steps):
        out[:, step] = word = padded[rows, at]
        where[:, step] = at
        bit = mixed(word ^ U((walk * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F + 1) % 2**64)) >> U(63)
        at = np.minimum(at + bit.astype(np.int64), k)
    return out, where


def places(n_words: int, times: int) -> np.ndarray:
    """The sampled places of each repetition for windows of so many words; behind 2n steps the walk has passed most windows."""
    return np.random.default_rng(n_words).integers(0, 2 * n_words, size=(times, SAMPLED))


def buckets(windows: np.ndarray, n_words: int, sampled: np.ndarray, walks: list | None = None) -> np.ndarray:
    """The bucket of each window of ``n_words`` words in each repetition.

    ``windows`` may be longer; ``walks`` are their embeddings, if these are known.
    """
    out = np.empty((len(windows), len(sampled)), dtype=np.uint64)
    for walk in range(WALKS):
        words, where = walks[walk] if walks else embed(windows, walk, 2 * n_words)
        own = sampled[walk::WALKS]
        seen = np.where(where[:, own] < n_words, words[:, own], U(0))
        key = np.zeros(seen.shape[:2], dtype=np.uint64)
        for k in range(SAMPLED):
            key = mixed(key * U(31) + seen[:, :, k])
        out[:, walk::WALKS] = key
    # a bucket belongs to its repetition and length
    return mixed(out ^ mixed(np.arange(1, len(sampled) + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(n_words))[None, :])


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many random edits."""
    out = words.tolist()
    for _ in range(edits):
        at, kind, new = int(rng.integers(len(out) + 1)), int(rng.integers(3)), int(rng.integers(1, 2**63))
        if kind == 0 or at == len(out) or not out:
            out.insert(at, new)
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out[at] = new
    return np.array(out, dtype=np.uint64)


def repetitions(n_words: int, share: float = SHARE, recall: float = RECALL) -> int:
    """How many repetitions find ``recall`` of the items of so many words at the most edits that ``share`` allows.

    Lengths go up in steps of a quarter, as longer items need more. Equal windows share all buckets.
    """
    if int(share * n_words + 1e-9) == 0:
        return WALKS
    n = 4
    while n < n_words:
        n = max(n + 1, n * 5 // 4)
    # a simulation is a sample: it is to find more than is asked for
    return _simulated(n, int(share * n + 1e-9), 1 - (1 - recall) / 3)


@lru_cache(maxsize=4096)
def _simulated(n_words: int, edits: int, recall: float) -> int:
    """The repetitions that find ``recall`` of simulated items of so many words, edited so often, in text around them."""
    rng = np.random.default_rng([n_words, edits])
    sampled = places(n_words, MOST_TIMES)
    items = rng.integers(1, 2**63, size=(SIMULATED, n_words), dtype=np.uint64)
    windows = np.empty((SIMULATED, 2 * edits + 1, n_words), dtype=np.uint64)
    for item, own in zip(items, windows):
        line = np.concatenate([rng.integers(1, 2**63, size=edits, dtype=np.uint64), edited(item, edits, rng), rng.integers(1, 2**63, size=n_words + 2 * edits, dtype=np.uint64)])
        for shift in range(2 * edits + 1):
            own[shift] = line[shift : shift + n_words]
    mine = buckets(items, n_words, sampled)
    theirs = buckets(windows.reshape(-1, n_words), n_words, sampled).reshape(SIMULATED, 2 * edits + 1, MOST_TIMES)
    met = (theirs == mine[:, None, :]).any(axis=1)
    first = np.sort(np.where(met.any(axis=1), met.argmax(axis=1), MOST_TIMES))
    needed = int(first[min(SIMULATED - 1, math.ceil(recall * SIMULATED) - 1)]) + 1
    return min(MOST_TIMES, -(-needed // WALKS) * WALKS)


def best_end(item: np.ndarray, text: np.ndarray, free_start: bool) -> tuple[int, int]:
    """The smallest edit distance of the item to a stretch of the text, and where that ends.

    The stretch starts anywhere (``free_start``) or at the first word.
    """
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64) if free_start else steps.copy()
    for word in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Item:
    ident: object
    words: np.ndarray
    edits: int
    piece: int


class Benchmark:
    """The items of a block, ready for search."""

    def __init__(self, rows: list[tuple[object, str | None]], share: float, min_words: int, recall: float):
        self.items: list[Item] = []
        texts = [plain(t) for _, t in rows]
        words = Words(texts)
        hashes = words.hashes()
        offsets: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for (ident, _), s, e in zip(rows, words.first, words.last):
            own = hashes[s:e]
            if len(own) < min_words:
                continue
            edits = int(share * len(own) + 1e-9)
            piece = len(own) // (edits + 1)
            for p in range(edits + 1):
                at = p * piece
                key = int(window_hashes(own[at : at + piece], piece)[0])
                offsets.setdefault(piece, {}).setdefault(key, set()).add((at, edits))
            self.items.append(Item(ident, own, edits, piece))
        self.widest = max((len(i.words) for i in self.items), default=1)
        #: of each length: the sampled places, the buckets of its items in order, and whose they are
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(i.words) for i in self.items}):
            own = np.array([k for k, i in enumerate(self.items) if len(i.words) == n])
            sampled = places(n, repetitions(n, share, recall))
            keys = buckets(np.stack([self.items[k].words for k in own]), n, sampled)
            order = np.argsort(keys, axis=None, kind="stable")
            self.lengths[n] = (sampled, keys.reshape(-1)[order], np.repeat(own, keys.shape[1])[order])
        #: of each size of pieces: the pieces in order, the offsets of each from the start of an item, and a sieve for them
        self.pieces: dict[int, tuple[np.ndarray, list[np.ndarray], np.ndarray]] = {}
        for piece, found in offsets.items():
            keys = np.array(sorted(found), dtype=np.uint64)
            shifts = [np.unique(np.concatenate([np.arange(-e, e + 1) - at for at, e in sorted(found[int(k)])])) for k in keys]
            sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
            sieve[(keys >> U(64 - SIEVE_BITS)).astype(np.int64)] = True
            self.pieces[piece] = (keys, shifts, sieve)

    def starts(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Rows (text, place) where windows may begin, each once; a place may lie before its text."""
        found = [np.empty((0, 2), dtype=np.int64)]
        for piece, (keys, shifts, sieve) in self.pieces.items():
            windows = window_hashes(hashes, piece)
            maybe = np.flatnonzero(sieve[(windows >> U(64 - SIEVE_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(keys, windows[maybe]), len(keys) - 1)
            same = keys[at] == windows[maybe]
            place, key = maybe[same], at[same]
            text = np.searchsorted(words.last, place, side="right")
            whole = place + piece <= words.last[text]
            place, key, text = place[whole], key[whole], text[whole]
            for k in np.unique(key).tolist():
                mine = np.flatnonzero(key == k)
                start = place[mine][:, None] + shifts[k][None, :]
                found.append(np.stack([np.repeat(text[mine], start.shape[1]), start.reshape(-1)], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def candidates(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Rows (text, item, window start) of the windows that share a bucket with an item, each once."""
        starts = self.starts(words, hashes)
        found = [np.empty((0, 3), dtype=np.int64)]
        for at in range(0, len(starts), WINDOW_BLOCK):
            text, start = starts[at : at + WINDOW_BLOCK].T
            # windows may hang over the ends of the text; what is outside is no word
            index = start[:, None] + np.arange(self.widest)
            inside = (index >= words.first[text][:, None]) & (index < words.last[text][:, None])
            windows = np.where(inside, hashes[np.clip(index, 0, len(hashes) - 1)], U(0))
            walks = [embed(windows, walk, 2 * self.widest) for walk in range(WALKS)]
            for n, (sampled, keys, owners) in self.lengths.items():
                own = buckets(windows, n, sampled, walks)
                low, high = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
                row, time = np.nonzero(high > low)
                for k in range(int((high - low).max(initial=0))):
                    some = low[row, time] + k < high[row, time]
                    item = owners[low[row, time][some] + k]
                    found.append(np.stack([text[row[some]], item, start[row[some]]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, end, distance) of every leak; those of one item in a text do not overlap."""
        if not self.items:
            return []
        words = Words(texts)
        hashes = words.hashes()
        near = self.candidates(words, hashes)
        out = []
        # windows of one item that overlap are one region, of bounded length
        begin, done, last_key = 0, 0, None
        for i in range(1, len(near) + 1):
            text, at, start = near[begin].tolist()
            item = self.items[at]
            n = len(item.words)
            if i < len(near) and near[i, 0] == text and near[i, 1] == at and near[i, 2] <= min(near[i - 1, 2] + n, start + 2 * n):
                continue
            first = int(words.first[text])
            if (text, at) != last_key:
                done, last_key = first, (text, at)
            low = max(done, start - item.edits)
            high = min(int(words.last[text]), int(near[i - 1, 2]) + n + item.edits)
            count = len(out)
            self._verify(item, hashes, low, high, out, (text, at), first)
            done = max([done, *(first + leak[3] for leak in out[count:])])
            begin = i
        return out

    def _verify(self, item: Item, hashes: np.ndarray, low: int, high: int, out: list, key: tuple[int, int], first: int) -> None:
        """Adds the best stretch of a region, then what is left and right of it."""
        todo = [(low, high)]
        while todo:
            low, high = todo.pop()
            if high - low < len(item.words) - item.edits:
                continue
            distance, end = best_end(item.words, hashes[low:high], True)
            if distance > item.edits:
                continue
            _, length = best_end(item.words[::-1], hashes[low : low + end][::-1], False)
            start, end = low + end - length, low + end
            out.append((*key, start - first, end - first, distance))
            todo += [(low, start), (end, high)]


def blocks_of(items: DataFrame, id_col: str, text_col: str, share: float, min_words: int, recall: float) -> Iterator[Benchmark]:
    """The items in blocks of bounded size; each block is read to the driver by itself."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 64), F.lit(0))).head()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for block in range(blocks):
        found = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield Benchmark(sorted((tuple(r) for r in found), key=lambda r: (str(r[0]), r[1] or "")), share, min_words, recall)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    share: float = SHARE,
    min_words: int = MIN_WORDS,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, item_words) of every leak."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    kinds = {"doc_id": rows.schema["doc_id"].dataType.simpleString(), "item_id": items.schema[item_col].dataType.simpleString()}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, first_word long, n_words long, distance long, item_words long"
    found = None
    for benchmark in blocks_of(items, item_col, item_text_col, share, min_words, recall):
        shared = context.broadcast(benchmark)

        def run(batches, shared=shared):
            for batch in portions(batches, 1, 2 * PIECE_BYTES):
                texts = [plain(t) for t in batch.column(1).to_pylist()]
                ids, out = batch.column(0), []
                for a, b in pieces(texts, PIECE_BYTES):
                    for text, at, start, end, distance in shared.value.leaks(texts[a:b]):
                        item = shared.value.items[at]
                        out.append((a + text, item.ident, start, end - start, distance, len(item.words)))
                if out:
                    where, idents, *numbers = zip(*out)
                    columns = [ids.take(pa.array(where)), pa.array(idents), *[pa.array(c, pa.int64()) for c in numbers]]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "first_word", "n_words", "distance", "item_words"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    share: float = SHARE,
    min_words: int = MIN_WORDS,
    recall: float = RECALL,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows that leak no item, all columns; no row is shuffled."""
    place, context = docs.columns.index(text_col), docs.sparkSession.sparkContext
    for benchmark in blocks_of(items, item_col, item_text_col, share, min_words, recall):
        shared = context.broadcast(benchmark)

        def run(batches, shared=shared):
            for batch in portions(batches, place, 2 * PIECE_BYTES):
                texts = [plain(t) for t in batch.column(place).to_pylist()]
                clean = np.ones(len(texts), dtype=bool)
                for a, b in pieces(texts, PIECE_BYTES):
                    for text, *_ in shared.value.leaks(texts[a:b]):
                        clean[a + text] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
