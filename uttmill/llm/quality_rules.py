"""Quality rules on tokeniser fertility.

A public vocabulary shows how natural a text is to it: characters per token, the share of
its bytes that a vocabulary with byte fallback does not know, and the entropy of its
tokens. Each language, or script where the language has no band of its own, has a band of
allowed values; a text outside of it is rejected. Two base rules come first: too few words,
and too many words in repeated three-word windows.

A word is measured with one space before it, by the rank file of a byte-level vocabulary
(``VOCABULARY``); words over ``LONG_WORD`` characters in parts of that length, whole. Byte
fallback is what the characters without a piece in ``PIECES`` need.

The bands are wide: they stand for what no prose of the language reaches, so clean texts
stay. They are parameters.

Null and empty texts have no words, all measures 0, and fail the base rules. An unknown or
null language takes the band of the most frequent script, then the default. Rows that
repeat stay rows. Extra columns go through ``keep_by_quality`` unchanged, whatever their
names, and are not read by ``quality``. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import U, Words, covered, encoded, mixed, pieces, portions, window_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: the public split pattern of the rank file (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
CACHED_WORDS = 200_000
PIECE_BYTES = 1 << 20
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Allowed characters per token, byte-fallback share, and token entropy in bits."""

    min_chars: float
    max_chars: float = 9.0
    max_fallback: float = 0.3
    min_entropy: float = 4.5
    max_entropy: float = 15.0


BANDS = {
    "en": Band(1.9),
    "de": Band(2.0),
    "fr": Band(1.75),
    "es": Band(1.75),
    "Latin": Band(1.6),
    "Cyrillic": Band(1.2),
    "Greek": Band(0.8),
    "Arabic": Band(0.8),
    "Hebrew": Band(0.8),
    "Devanagari": Band(0.5, max_fallback=1.0),
    "Hangul": Band(0.4, max_fallback=1.0),
    "Kana": Band(0.4, max_fallback=1.0),
    "Han": Band(0.3, max_fallback=1.0),
    "": Band(0.2, max_fallback=1.0),
}
#: first and last code point of the letters of a script
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7A3),
)


@dataclass(frozen=True)
class Rules:
    min_words: int = MIN_WORDS
    repeat_percent: int = REPEAT_PERCENT
    vocabulary: str = VOCABULARY
    pieces: str = PIECES
    pattern: str = PATTERN
    bands: tuple[tuple[str, Band], ...] = tuple(BANDS.items())

    def band(self, lang: str | None, text: bytes) -> Band:
        bands = dict(self.bands)
        if lang in bands and lang:
            return bands[lang]
        points = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        counts = [(int(((points >= low) & (points <= high)).sum()), -i) for i, (_, low, high) in enumerate(SCRIPTS)]
        most, place = max(counts)
        return bands.get(SCRIPTS[-place][0] if most else "", bands[""])


class Fertility:
    """The vocabularies of a task, and the tokens of the words it has met."""

    def __init__(self, vocabulary: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        known = sentencepiece.SentencePieceProcessor(model_file=model)
        #: code points that have a piece of their own
        self.known = np.zeros(0x110000, dtype=bool)
        for i in range(known.get_piece_size()):
            piece = known.id_to_piece(i)
            if len(piece) == 1:
                self.known[ord(piece)] = True
        self.cache: dict[bytes, np.ndarray] = {}

    def tokens(self, word: bytes) -> np.ndarray:
        found = self.cache.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            parts = [text[i : i + LONG_WORD] for i in range(0, len(text), LONG_WORD)]
            ids = self.encoding.encode_ordinary(" " + parts[0])
            for part in parts[1:]:
                ids += self.encoding.encode_ordinary(part)
            found = np.array(ids, dtype=np.uint32)
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            if len(word) <= LONG_WORD:
                self.cache[word] = found
        return found

    def unknown_bytes(self, text: bytes) -> int:
        """UTF-8 bytes of the characters outside ASCII that have no piece."""
        if text.isascii():
            return 0
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        points = points[points > 127]
        points = points[~self.known[points]]
        return int(2 * len(points) + (points > 0x7FF).sum() + (points > 0xFFFF).sum())


@lru_cache(maxsize=2)
def fertility(vocabulary: str, pattern: str, model: str) -> Fertility:
    return Fertility(vocabulary, pattern, model)


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, byte_fallback_share double, token_entropy double, base_failed boolean, kept boolean"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def per_text(mask: np.ndarray, words: Words) -> np.ndarray:
    """True bytes of each text."""
    sums = np.r_[0, np.cumsum(mask)]
    return sums[words.text_ends] - sums[words.text_starts]


def repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text, the words in three-word windows found twice or more in it."""
    whole = words.whole(3)
    starts = np.flatnonzero(whole)
    owner = words.owner()
    keys = mixed(window_hashes(hashes, 3, 0)[whole] + owner[starts].astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    lined = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = lined[1:] == lined[:-1]
    twice = order[same[1:] | same[:-1]]
    goes = covered(starts[twice], 3, len(words.starts))
    sums = np.r_[0, np.cumsum(goes)]
    return sums[words.last] - sums[words.first]


def measures(texts: list[bytes], langs: list[str | None], rules: Rules) -> dict[str, np.ndarray]:
    """All measures and verdicts of some texts."""
    meter = fertility(rules.vocabulary, rules.pattern, rules.pieces)
    words = Words(texts)
    n = len(texts)
    hashes = words.hashes()
    begins = (words.b & 0xC0) != 0x80
    chars = per_text(begins & ~words.space, words)
    repeated = repeated_words(words, hashes)
    # tokens of each different word, then of each text
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    raw = words.b.tobytes()
    lists = [meter.tokens(raw[s:e]) for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist())]
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    pool = np.concatenate(lists) if lists else np.empty(0, dtype=np.uint32)
    at = np.cumsum(lengths) - lengths
    per_word = lengths[inverse] if len(lengths) else np.empty(0, dtype=np.int64)
    owner = words.owner()
    n_tokens = np.bincount(owner, weights=per_word, minlength=n).astype(np.int64)
    begin = np.repeat(at[inverse] - (np.cumsum(per_word) - per_word), per_word) if len(lists) else np.empty(0, dtype=np.int64)
    tokens = pool[begin + np.arange(len(begin))]
    marked = np.repeat(owner, per_word).astype(np.uint64) * U(meter.size) + tokens
    marked.sort()
    edge = np.flatnonzero(np.r_[True, marked[1:] != marked[:-1]]) if len(marked) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.r_[edge, len(marked)])
    holder = (marked[edge] // U(meter.size)).astype(np.int64)
    some = np.maximum(n_tokens, 1)
    entropy = np.log2(some) - np.bincount(holder, weights=counts * np.log2(np.maximum(counts, 1)), minlength=n) / some
    size = per_text(~words.space, words)
    fallback = np.array([meter.unknown_bytes(t) for t in texts], dtype=np.float64) / np.maximum(size, 1)
    fertile = chars / some
    failed = (words.counts < rules.min_words) | (100 * repeated > rules.repeat_percent * words.counts)
    kept = np.zeros(n, dtype=bool)
    for i in np.flatnonzero(~failed):
        band = rules.band(langs[i], texts[i])
        kept[i] = (
            band.min_chars <= fertile[i] <= band.max_chars
            and fallback[i] <= band.max_fallback
            and band.min_entropy <= entropy[i] <= band.max_entropy
        )
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": chars.astype(np.int64),
        "n_symbols": per_text(_SYMBOL[words.b], words).astype(np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": repeated.astype(np.int64),
        "n_tokens": n_tokens,
        "chars_per_token": fertile,
        "byte_fallback_share": fallback,
        "token_entropy": np.maximum(entropy, 0.0),
        "base_failed": failed,
        "kept": kept,
    }


def _measured(texts: list[str | None], langs: list[str | None], rules: Rules) -> dict[str, np.ndarray]:
    whole = encoded(texts)
    parts = [measures(whole[a:b], langs[a:b], rules) for a, b in pieces(whole, PIECE_BYTES)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _lang(docs: DataFrame, lang_col: str | None):
    return F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")


def quality(
    docs: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """doc_id and all measures and verdicts of each row."""

    def run(batches):
        for batch in portions(batches, 1):
            found = _measured(batch.column(1).to_pylist(), batch.column(2).to_pylist(), rules)
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], names=["doc_id", *found])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _lang(docs, lang_col).alias("lang"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def keep_by_quality(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows that the rules keep, all columns."""
    places = [docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None]

    def run(batches):
        for batch in portions(batches, places[0]):
            langs = [None] * len(batch) if places[1] is None else batch.column(places[1]).to_pylist()
            found = _measured(batch.column(places[0]).to_pylist(), langs, rules)
            if found:
                yield batch.filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, docs.schema)
