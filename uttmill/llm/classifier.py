"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

The score of a text is linear terms plus all pairwise interactions, each the product of two
vectors of ``RANK`` numbers. The sum over pairs is half the square of the sum less the sum
of squares, so scoring takes one pass over the features that a text has.

Features: its words, hashed into ``WORD_SLOTS`` slots (counts with unit length), statistics
of its structure, and numeric metadata columns; never labels, language, source or id.

The machine is fitted on at most ``SAMPLE_ROWS`` labelled rows (those whose id has the
smallest digest), made into features on the executors; the fitted machine has a fixed size
and goes to every task. Every row of the table is scored. Rows whose CRC-32 of the id is
divisible by ``FOLDS`` are held out and never fitted on.

Null and empty texts have no words and zero statistics, and are scored like any other. Null
ids count as the empty id. Null labels are no labels; of several labels of an id the largest
counts. Without labels every score is 0.5. Null or missing metadata is 0. Rows that repeat
stay rows. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import duplicate_lines, per_text, repeated_words
from .texts import U, Words, encoded, pieces, portions

WORD_SLOTS = 1 << 15
RANK = 8
SAMPLE_ROWS = 8192
FOLDS = 5
THRESHOLD = 0.3
PIECE_BYTES = 1 << 20
EPOCHS = 12
BATCH = 256
RATE = 0.02
DECAY_WORDS = 1e-3
DECAY = 1e-5
STATISTICS = (
    "log_words", "chars_per_word", "upper", "digits", "symbols", "bars", "marks", "non_ascii", "short_lines",
    "log_lines", "duplicate_lines", "repeated", "distinct",
)


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(b"#*$%&<>{}[]=_^~\\@")
_BAR = _table(b"|")
_MARK = _table(b"!?")
_LINE = _table(b"\n")


@dataclass(frozen=True)
class Features:
    """Sparse word features in rows of ``starts``, and dense ones."""

    starts: np.ndarray
    slots: np.ndarray
    values: np.ndarray
    dense: np.ndarray


def features(texts: list[bytes], metadata: np.ndarray) -> Features:
    """Features of some texts; ``metadata``: a row of numbers for each."""
    n = len(texts)
    words = Words(texts)
    hashes = words.hashes()
    owner = words.owner()
    keys = owner.astype(np.uint64) * U(WORD_SLOTS) + (hashes >> U(40)) % U(WORD_SLOTS)
    keys.sort()
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.r_[edge, len(keys)]).astype(np.float32)
    holder = (keys[edge] // U(WORD_SLOTS)).astype(np.int64)
    norm = np.sqrt(np.bincount(holder, weights=counts * counts, minlength=n))
    values = counts / np.maximum(norm[holder], 1e-9).astype(np.float32)
    starts = np.searchsorted(holder, np.arange(n + 1))
    count = words.counts
    some = np.maximum(count, 1)
    size = np.maximum(per_text(~words.space, words), 1)
    lines = per_text(_LINE[words.b], words)
    part = lambda table: per_text(table[words.b], words) / size
    dense = np.stack(
        [
            np.log1p(count),
            size / some,
            part(_UPPER),
            part(_DIGIT),
            part(_SYMBOL),
            part(_BAR),
            part(_MARK),
            per_text(words.b > 127, words) / size,
            lines / some,
            np.log1p(lines),
            np.array([duplicate_lines(t) for t in texts], dtype=np.float64) / (lines + 1),
            repeated_words(words, hashes) / some,
            np.diff(starts) / some,
        ],
        axis=1,
    )
    dense[count == 0] = 0
    return Features(starts, (keys[edge] % U(WORD_SLOTS)).astype(np.int32), values, np.c_[dense, np.log1p(np.maximum(metadata, 0))].astype(np.float32))


@dataclass
class Machine:
    """Weights of word slots first, then of dense features; dense ones are standardized."""

    bias: float
    linear: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def dense(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -4, 4).astype(np.float32)

    def sums(self, f: Features, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The raw score of each row, and its sum of vectors."""
        n = len(f.starts) - 1
        v = self.vectors[f.slots] * f.values[:, None]
        total, squares, line = np.zeros((n, RANK), np.float32), np.zeros((n, RANK), np.float32), np.zeros(n, np.float32)
        some = np.flatnonzero(np.diff(f.starts))
        if len(some):
            at = f.starts[:-1][some]
            total[some] = np.add.reduceat(v, at, axis=0)
            squares[some] = np.add.reduceat(v * v, at, axis=0)
            line[some] = np.add.reduceat(self.linear[f.slots] * f.values, at)
        own = self.vectors[WORD_SLOTS:]
        total += dense @ own
        squares += (dense * dense) @ (own * own)
        raw = self.bias + line + dense @ self.linear[WORD_SLOTS:] + 0.5 * (total * total - squares).sum(axis=1)
        return raw, total

    def scores(self, f: Features) -> np.ndarray:
        raw, _ = self.sums(f, self.dense(f.dense))
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def fit(f: Features, labels: np.ndarray, seed: int = 9) -> Machine:
    """Adam over batches; the order of rows and the start are fixed by the seed."""
    n, width = f.dense.shape
    rng = np.random.default_rng(seed)
    spread = f.dense.std(axis=0) if n else np.ones(width, np.float32)
    machine = Machine(
        0.0,
        np.zeros(WORD_SLOTS + width, np.float32),
        rng.normal(0, 0.02, (WORD_SLOTS + width, RANK)).astype(np.float32),
        f.dense.mean(axis=0) if n else np.zeros(width, np.float32),
        np.where(spread > 1e-6, spread, 1).astype(np.float32),
    )
    if not n:
        machine.vectors[:] = 0
        return machine
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    machine.bias = float(np.log(share / (1 - share)))
    dense = machine.dense(f.dense)
    params = [np.array([machine.bias], np.float32), machine.linear, machine.vectors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for b in range(0, n, BATCH):
            rows = order[b : b + BATCH]
            lengths = (f.starts[1:] - f.starts[:-1])[rows]
            owner = np.repeat(np.arange(len(rows)), lengths)
            at = f.starts[rows][owner] + np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]
            part = Features(np.r_[0, np.cumsum(lengths)], f.slots[at], f.values[at], f.dense[rows])
            machine.bias = float(params[0][0])
            raw, total = machine.sums(part, dense[rows])
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30)))) - labels[rows]).astype(np.float32) / len(rows)
            g_linear, g_vectors = np.zeros_like(machine.linear), np.zeros_like(machine.vectors)
            pull = error[owner] * part.values
            g_linear[:WORD_SLOTS] = np.bincount(part.slots, weights=pull, minlength=WORD_SLOTS)
            for k in range(RANK):
                g = pull * (total[owner, k] - machine.vectors[part.slots, k] * part.values)
                g_vectors[:WORD_SLOTS, k] = np.bincount(part.slots, weights=g, minlength=WORD_SLOTS)
            own = machine.vectors[WORD_SLOTS:]
            g_linear[WORD_SLOTS:] = error @ dense[rows]
            g_vectors[WORD_SLOTS:] = dense[rows].T @ (error[:, None] * total) - own * (error @ (dense[rows] ** 2))[:, None]
            for g, p in ((g_linear, machine.linear), (g_vectors, machine.vectors)):
                g[:WORD_SLOTS] += DECAY_WORDS * p[:WORD_SLOTS]
                g[WORD_SLOTS:] += DECAY * p[WORD_SLOTS:]
            step += 1
            for p, m, s, g in zip(params, first, second, (np.array([error.sum()], np.float32), g_linear, g_vectors)):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    machine.bias = float(params[0][0])
    return machine


def remainder(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def _metadata(docs: DataFrame, cols: Sequence[str]) -> Column:
    have = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in docs.columns else F.lit(0.0) for c in cols]
    return F.array(*have).cast("array<double>")


def _rows(batch, text_at: int, meta_at: int):
    texts = encoded(batch.column(text_at).to_pylist())
    meta = np.array(batch.column(meta_at).to_pylist(), dtype=np.float64).reshape(len(texts), -1)
    for a, b in pieces(texts, PIECE_BYTES):
        yield a, b, features(texts[a:b], meta[a:b])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: Sequence[str] = ("n_chars",),
    sample_rows: int = SAMPLE_ROWS,
    folds: int = FOLDS,
) -> Machine:
    """Fits on at most ``sample_rows`` rows: one of each of so many labelled ids that are not held out.

    Of several rows with one id that with the smallest digest of its text counts.
    """
    key = F.col(id_col)
    chosen = labels.where(key.isNotNull() & F.col(label_col).isNotNull() & (remainder(key, folds) != 0))
    chosen = chosen.groupBy(key.alias("label_id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = chosen.orderBy(F.md5(F.col("label_id").cast("string")), "label_id").limit(sample_rows)  # the bounded sample
    rows = docs.select(key.alias("label_id"), F.col(text_col).cast("string").alias("text"), _metadata(docs, metadata).alias("meta"))
    rows = rows.join(F.broadcast(chosen), "label_id").select(F.col("label_id").cast("string").alias("id"), "label", "text", "meta")
    digest = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("digest")
    rows = rows.groupBy("id").agg(F.min(F.struct(digest, "text", "meta", "label")).alias("one")).select("id", "one.label", "one.text", "one.meta")

    def run(batches):
        for batch in portions(batches, 2):
            for a, b, f in _rows(batch, 2, 3):
                blobs = [
                    [f.slots[s:e].tobytes() for s, e in zip(f.starts, f.starts[1:])],
                    [f.values[s:e].tobytes() for s, e in zip(f.starts, f.starts[1:])],
                    [row.tobytes() for row in f.dense],
                ]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *[pa.array(x, pa.binary()) for x in blobs]], names=["id", "label", "slots", "parts", "dense"])

    found = rows.mapInArrow(run, "id string, label double, slots binary, parts binary, dense binary").collect()
    found.sort(key=lambda r: (r.id, bytes(r.dense)))
    width = len(STATISTICS) + len(metadata)
    lengths = [len(r.slots) // 4 for r in found]
    f = Features(
        np.r_[0, np.cumsum(lengths)].astype(np.int64),
        np.frombuffer(b"".join(r.slots for r in found), dtype=np.int32),
        np.frombuffer(b"".join(r.parts for r in found), dtype=np.float32),
        np.frombuffer(b"".join(r.dense for r in found), dtype=np.float32).reshape(-1, width),
    )
    return fit(f, np.array([r.label for r in found], dtype=np.float64))


def scored(
    docs: DataFrame,
    machine: Machine,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: Sequence[str] = ("n_chars",),
    threshold: float = THRESHOLD,
    folds: int = FOLDS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _metadata(docs, metadata).alias("meta")
    )
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(batches):
        for batch in portions(batches, 1):
            parts = [shared.value.scores(f) for _, _, f in _rows(batch, 1, 2)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
