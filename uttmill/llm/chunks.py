"""Passes over a corpus in which the keys of many windows are compared.

A key per row would make the shuffle many times the corpus. Here the documents are dealt
into *chunks* of a few megabytes, in the order of their ids where that matters. A pass sends the keys of a
chunk, sorted and each once, as one binary row to each *bucket* of the key space; the
bucket compares the keys of all chunks and answers each chunk with one code per key, in
the order in which the keys came. The chunk makes its keys again to read the answer, so
neither keys nor answers carry positions.

Both sizes are fixed (``CHUNK_BYTES``, ``BUCKET_KEYS``) and their numbers grow with the
corpus. A key that all documents share comes once from each chunk, so no bucket holds more
than its own keys and one entry per chunk of a shared one.

A row per chunk and bucket would shrink with every growth of the corpus. Beyond ``SINGLE`` buckets keys go by
a *junction*: a chunk sends one row to each of about sqrt(buckets) spans of buckets; a junction holds
what about sqrt(chunks) consecutive chunks send to one span, and sends one row to each bucket of the span, and the
answers come back the same way. With c chunks, b buckets and k keys in a chunk there are c * sqrt(b) rows on the first leg and
sqrt(c) * b on the second, of k / sqrt(b) and k * c / (sqrt(c) * b) keys: some hundred at 10 TB, where one leg would have 0.2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 19
RANGES = 128
#: buckets that a chunk sends to by itself
SINGLE = 1024
SCHEMA = "chunk long, kind int, bucket long, keys binary"
ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary())])


def in_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES):
    """The rows as (chunk, doc_id, text), and the bytes of all texts.

    Chunks follow the order of the ids, null first. At most ``RANGES`` quantiles of the
    ids are read to the driver; between two of them the ids are cut evenly.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    inner = [i / RANGES for i in range(RANGES + 1)]
    found = rows.agg(
        F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("size"),
        F.percentile_approx("doc_id", F.lit(inner), F.lit(20 * RANGES)).alias("ids"),
    ).head()
    ids = sorted(set(found.ids or []))
    size = int(found.size)
    each = max(1, -(-size // (chunk_bytes * max(1, len(ids) - 1))))
    needed = max(1, -(-size // chunk_bytes))
    if len(ids) < 2:
        return rows.select(F.lit(0).cast("long").alias("chunk"), "doc_id", "text"), size
    lows, highs = F.lit(ids[:-1]), F.lit(ids[1:])
    value = F.col("doc_id")
    below = F.size(F.filter(lows, lambda low: low <= value))
    at = F.greatest(F.lit(1), F.least(F.lit(len(ids) - 1), below))
    low, high = F.element_at(lows, at), F.element_at(highs, at)
    inside = F.least(F.lit(each - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - low) * each / (high - low))))
    fine = (at - 1) * each + inside
    chunk = F.floor(fine * needed / (each * (len(ids) - 1))) if each == 1 else fine
    return rows.select(F.coalesce(chunk, F.lit(0)).cast("long").alias("chunk"), "doc_id", "text"), size


def in_any_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES):
    """As ``in_chunks``, for passes in which no chunk comes before another: dealt by a hash of id and text.

    Null, repeated and uneven ids make no large chunk; rows equal in id and text lie together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0])
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // chunk_bytes))))
    return rows.select(chunk.cast("long").alias("chunk"), "doc_id", "text"), size


def table_of(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)] if rows else [pa.array([], t) for t in ARROW.types], schema=ARROW)


def in_order(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The rows of a chunk by id, null first, then text; and the texts as UTF-8."""
    table = table.combine_chunks()
    order = pc.sort_indices(
        table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"
    )
    table = table.take(order).combine_chunks()
    return table, [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]


def span_of(buckets: int) -> int:
    """How many consecutive buckets a chunk sends one row to."""
    return 1 if buckets <= SINGLE else ceil(buckets / ceil(sqrt(buckets)))


def packed(numbers: np.ndarray, sizes: np.ndarray, content: bytes) -> bytes:
    """Parts behind each other, after their numbers and sizes."""
    head = np.array([len(numbers)], dtype=np.int64).tobytes()
    return b"".join([head, np.asarray(numbers, dtype=np.int64).tobytes(), np.asarray(sizes, dtype=np.int64).tobytes(), content])


def unpacked(blob: bytes) -> list[tuple[int, bytes]]:
    """(number, content) of each part."""
    n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
    numbers, sizes = np.frombuffer(blob, dtype=np.int64, count=2 * n, offset=8).reshape(2, n)
    ends = 8 + 16 * n + np.cumsum(sizes)
    return [(int(k), blob[e - s : e]) for k, s, e in zip(numbers, sizes.tolist(), ends.tolist())]


class Outbox:
    """The keys of one kind that a chunk sends, and the way back from the answers."""

    def __init__(self, keys: np.ndarray, buckets: np.ndarray, span: int = 1):
        """``keys``: one row of 64-bit numbers per occurrence, in order; ``buckets``: a function of the key."""
        self.span = span
        keys = keys[:, None] if keys.ndim == 1 else keys
        order = np.lexsort(keys.T) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
        lined = keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (lined[1:] != lined[:-1]).any(axis=1)
        #: the first occurrence of each different key, in order of keys
        self.firsts = order[new]
        group = np.cumsum(new) - 1
        self.inverse = np.empty(len(keys), dtype=np.int64)
        self.inverse[order] = group
        self.counts = np.bincount(group, minlength=len(self.firsts))
        home = buckets[self.firsts]
        self.turn = np.argsort(home, kind="stable")
        self.keys = lined[new][self.turn]
        home = home[self.turn]
        self.cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else np.empty(0, dtype=np.int64)
        self.homes = home[self.cuts]

    def rows(self, chunk: int, kind: int) -> list[tuple[int, int, int, bytes]]:
        ends = np.r_[self.cuts[1:], len(self.keys)] if len(self.cuts) else self.cuts
        if self.span == 1:
            return [(chunk, kind, int(h), self.keys[s:e].tobytes()) for h, s, e in zip(self.homes, self.cuts, ends)]
        out, junctions = [], self.homes // self.span
        for j in np.unique(junctions).tolist():
            own = np.flatnonzero(junctions == j)
            first, last = own[0], own[-1]
            sizes = (ends[own] - self.cuts[own]) * self.keys.itemsize * self.keys.shape[1]
            out.append((chunk, kind, j, packed(self.homes[own], sizes, self.keys[self.cuts[first] : ends[last]].tobytes())))
        return out

    def answers(self, blobs: dict[int, bytes]) -> np.ndarray:
        """The code of every occurrence, from the bucket's answer to its key."""
        if not len(self.homes):
            return np.empty(0, dtype=np.uint8)
        # buckets stand in order, so those of a span are neighbours
        homes = self.homes if self.span == 1 else np.unique(self.homes // self.span)
        got = np.frombuffer(b"".join(blobs[int(h)] for h in homes), dtype=np.uint8)
        codes = np.empty(len(got), dtype=np.uint8)
        codes[self.turn] = got
        return codes[self.inverse]

    def local_first(self) -> np.ndarray:
        """Which occurrences are the first of their key in the chunk."""
        mask = np.zeros(len(self.inverse), dtype=bool)
        mask[self.firsts] = True
        return mask


def blobs_of(table: pa.Table, kind: int) -> dict[int, bytes]:
    part = table.filter(pc.equal(table["kind"], kind))
    return dict(zip(part["bucket"].to_pylist(), part["keys"].to_pylist()))


def sent(docs: DataFrame, emit: Callable[[int, pa.Table], Iterable[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Rows of keys made by ``emit(chunk, rows of the chunk)``."""

    def run(key, table):
        return table_of(list(emit(key[0].as_py(), table)))

    return docs.groupBy("chunk").applyInArrow(run, SCHEMA)


def sent_again(docs: DataFrame, codes: DataFrame, emit) -> DataFrame:
    """As ``sent``, with the answers of the pass before: ``emit(chunk, rows, answers)``."""

    def run(key, left, right):
        return table_of(list(emit(key[0].as_py(), left, right)))

    return docs.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(run, SCHEMA)


def answered(
    keys: DataFrame, decide: Callable[[int, list[np.ndarray]], list[np.ndarray]], widths: dict[int, int], span: int = 1, chunks: int = 1
) -> DataFrame:
    """The answer of each bucket to each chunk, by ``decide(kind, arrays of keys by chunk)``.

    ``widths``: numbers per key of each kind; other kinds go through as they are. ``span``: that of the
    outboxes; with more than one bucket the keys go by junctions of about sqrt(``chunks``) chunks.
    """
    if span > 1:
        return _by_junctions(keys, decide, widths, span, max(1, ceil(sqrt(chunks))))

    def run(key, table):
        kind = key[0].as_py()
        if kind not in widths:
            return table
        table = table.combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[("chunk", "ascending")]))
        arrays = [np.frombuffer(k, dtype=np.uint64).reshape(-1, widths[kind]) for k in table["keys"].to_pylist()]
        answers = [a.astype(np.uint8).tobytes() for a in decide(kind, arrays)]
        return pa.table([table["chunk"], table["kind"], table["bucket"], pa.array(answers, pa.binary())], schema=ARROW)

    return keys.groupBy("kind", "bucket").applyInArrow(run, SCHEMA)


def _by_junctions(keys: DataFrame, decide, widths: dict[int, int], span: int, together: int) -> DataFrame:
    mine = F.col("kind").isin(*widths)
    sent = keys.where(mine).withColumn("junction", F.floor(F.col("chunk") / together))

    def in_line(table: pa.Table) -> tuple[list[int], list[list[tuple[int, bytes]]]]:
        """The chunks in order, and what each sends to which bucket."""
        table = table.take(pc.sort_indices(table, sort_keys=[("chunk", "ascending")]))
        return table["chunk"].to_pylist(), [unpacked(blob) for blob in table["keys"].to_pylist()]

    def forward(key, table):
        kind, junction = key[0].as_py(), key[2].as_py()
        chunks, parts = in_line(table)
        to: dict[int, list[tuple[int, bytes]]] = {}
        for chunk, own in zip(chunks, parts):
            for bucket, content in own:
                to.setdefault(bucket, []).append((chunk, content))
        return table_of(
            [
                (junction, kind, bucket, packed([c for c, _ in got], [len(x) for _, x in got], b"".join(x for _, x in got)))
                for bucket, got in to.items()
            ]
        )

    def answer(key, table):
        kind, bucket = key[0].as_py(), key[1].as_py()
        junctions, parts = in_line(table)
        arrays = [np.frombuffer(x, dtype=np.uint64).reshape(-1, widths[kind]) for own in parts for _, x in own]
        codes = [a.astype(np.uint8).tobytes() for a in decide(kind, arrays)]
        out, done = [], 0
        for junction, own in zip(junctions, parts):
            mine = codes[done : done + len(own)]
            done += len(own)
            out.append((junction, kind, bucket, packed([c for c, _ in own], [len(x) for x in mine], b"".join(mine))))
        return table_of(out)

    def back(key, left, right):
        kind, place = key[0].as_py(), key[1].as_py()
        chunks, parts = in_line(left)
        codes = {b: dict(unpacked(blob)) for b, blob in zip(right["bucket"].to_pylist(), right["keys"].to_pylist())}
        return table_of([(chunk, kind, place, b"".join(codes[b][chunk] for b, _ in own)) for chunk, own in zip(chunks, parts)])

    forwarded = sent.groupBy("kind", "bucket", "junction").applyInArrow(forward, SCHEMA)
    answers = forwarded.groupBy("kind", "bucket").applyInArrow(answer, SCHEMA).withColumn("place", F.floor(F.col("bucket") / span))
    home = sent.groupBy("kind", "bucket", "junction").cogroup(answers.groupBy("kind", "place", "chunk")).applyInArrow(back, SCHEMA)
    return home.unionByName(keys.where(~mine))


def grouped(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys of several chunks: the order by (key, chunk), where a key begins in it, and the sizes of the arrays."""
    sizes = np.array([len(a) for a in arrays])
    keys = np.concatenate(arrays)
    order = np.lexsort(keys.T) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
    lined = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (lined[1:] != lined[:-1]).any(axis=1)
    return order, new, sizes


def shared_keys(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """1 where another chunk has the key too, else 0."""
    order, new, sizes = grouped(arrays)
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1
    out = np.empty(len(order), dtype=np.uint8)
    out[order] = many[group]
    return np.split(out, np.cumsum(sizes)[:-1])


def later_keys(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """1 where an earlier chunk has the key too, else 0."""
    order, new, sizes = grouped(arrays)
    out = np.empty(len(order), dtype=np.uint8)
    out[order] = ~new
    return np.split(out, np.cumsum(sizes)[:-1])
