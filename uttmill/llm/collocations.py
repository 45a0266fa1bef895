"""Phrase collocation mining with counting quotient filters.

A text is cut into pieces at punctuation and line ends, a piece into words; phrases lie within a
piece. Words that occur ``least`` times in their language get an id, which is enough: a phrase
that is frequent has frequent words and frequent parts only. The n-grams of ids of two to four words
are packed, permuted and counted in quotient filters (``quotient_filter.py``), without loss.

1. Words are counted in portions of text and summed by Spark; the frequent ones of each language
   are numbered by (hash bucket, rank in it).
2. Documents are dealt into *chunks* of one language and about ``CHUNK_BYTES``. The different words
   of a chunk are joined to the numbered words, so no vocabulary is broadcast, and come back to
   their chunk, which makes one sorted filter for each n and each *slab* of the key space.
3. The filters of a slab are merged. A language has as many slabs as chunks. Beyond ``2 ** FAN_BITS``
   of either, merging goes in rounds: chunks that share a residue first, for slabs of ``FAN_BITS``
   further bits each time, so rows never shrink as their number grows.
4. What occurs ``least`` times leaves the filters as rows; scores, containment and the first
   phrases of each language are joins and aggregates over these.

The score of a phrase at a cut is floor(SCALE * a / (l + r)) in exact arithmetic (decimal products);
the lowest cut counts, ties to the earliest. A phrase is dropped if it lies inside a longer
frequent one that holds ``INSIDE`` percent of its occurrences.

Null languages are ``und``, null and empty texts have no words. Equal rows are rows. Ids and other
columns are not read, whatever their names. An empty table gives an empty result. Rows must
come in the same order when the input is read again, as files do. A task holds one
chunk, or a longer text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .order import BROADCAST_STARTS as BROADCAST_ROWS
from .order import places
from .quotient_filter import Space
from .texts import portions

LONGEST = 4
LEAST = 30
PER_LANG = 2000
SCALE = 2_000_000
INSIDE = 80
CHUNK_BYTES = 8 << 20
#: bits of the slab number that one round of merging adds
FAN_BITS = 8
#: bits of the hash bucket in a word id
BUCKET_BITS = 10
FILTERS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("slab", pa.int64()), ("chunk", pa.int64()), ("filter", pa.binary())])
FILTERS_DDL = "lang string, n int, slab long, chunk long, filter binary"

#: byte values: 0 in a word (A to Z in lower case), space or tab, what ends a piece
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, and the piece each belongs to."""
    raw = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts if t).translate(FOLD)
    b = np.frombuffer(raw, dtype=np.uint8)
    kind = KIND[b]
    inside = kind == 0
    edges = np.diff(np.r_[False, inside, False].view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    pieces = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(b) else np.empty(0, np.int32)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    data = np.ascontiguousarray(b[inside])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return words, pieces


def prepared(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")
    ).where(F.octet_length("text") > 0)


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of all words; the null word has the number of all words of the language."""

    def run(batches):
        for batch in portions(batches, 1, CHUNK_BYTES):
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                words, _ = words_of(batch.column(1).filter(pc.equal(langs.indices, i)).to_pylist())
                found = pc.value_counts(words)
                values = pa.concat_arrays([found.field("values").cast(pa.string()), pa.nulls(1, pa.string())])
                counts = pa.concat_arrays([found.field("counts"), pa.array([len(words)], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), values, counts], names=["lang", "word", "f"])

    return rows.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(counts: DataFrame) -> DataFrame:
    """(lang, word, f, id): ids differ within a language and stay small."""
    return counts.withColumn("_bucket", F.expr(f"pmod(xxhash64(word), {1 << BUCKET_BITS})")).selectExpr(
        "lang", "word", "f",
        f"(row_number() OVER (PARTITION BY lang, _bucket ORDER BY word) - 1) * {1 << BUCKET_BITS} + _bucket AS id",
    )


def slab_bits(chunks: int) -> int:
    """Bits of the slab numbers of a language with so many chunks."""
    return max(0, chunks - 1).bit_length()


def chunk_words(lang: str, chunk: int, table: pa.Table) -> pa.Table:
    found = pc.unique(words_of(table["text"].to_pylist())[0]).cast(pa.string())
    return pa.table([pa.array([lang] * len(found), pa.string()), pa.array([chunk] * len(found), pa.int64()), found], names=["lang", "chunk", "word"])


def chunk_filters(lang: str, chunk: int, chunks: int, texts: pa.Table, known: pa.Table, width: int, longest: int) -> list[tuple]:
    """Rows of FILTERS: the n-grams of the known words of a chunk."""
    words, pieces = words_of(texts["text"].to_pylist())
    at = pc.index_in(words, value_set=known["word"].combine_chunks().cast(pa.large_string()))
    ids = np.full(len(words), -1, dtype=np.int64)
    there = np.asarray(at.is_valid())
    ids[there] = known["id"].to_numpy()[np.asarray(at.drop_null())]
    first = min(FAN_BITS, slab_bits(chunks))
    linked = (ids[:-1] >= 0) & (ids[1:] >= 0) & (pieces[:-1] == pieces[1:])
    rows, whole = [], linked
    for n in range(2, longest + 1):
        if n > 2:
            whole = whole[:-1] & linked[n - 2 :]
        starts = np.flatnonzero(whole)
        space = Space(n, width)
        grams = np.stack([ids[starts + i] for i in range(n)], axis=1)
        keys = space.counted(*space.keys(grams))
        rows += [(lang, n, slab, chunk, blob) for slab, blob in space.filters(*keys, first)]
    return rows


def merged(n: int, slab: int, blobs: list[bytes], width: int):
    """Keys and counts of several filters of a slab, in order."""
    space = Space(n, width)
    parts = [space.loaded(slab, blob) for blob in blobs]
    return space, space.counted(*(np.concatenate(p) for p in zip(*parts)))


def as_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FILTERS)], schema=FILTERS)


def frequent_grams(rows: DataFrame, vocabulary: DataFrame, least: int, longest: int, chunk_bytes: int) -> DataFrame:
    """(lang, ids, f) of the n-grams of two or more words that occur ``least`` times."""
    sizes = rows.groupBy("lang").agg(F.ceil(F.sum(F.octet_length("text")) / F.lit(chunk_bytes)).alias("chunks"))
    sizes = cut_lineage(sizes)
    found = sizes.agg(F.count(F.lit(1)).alias("langs"), F.max("chunks").alias("most")).head()
    width = max(1, int(vocabulary.agg(F.max("id")).head()[0] or 0).bit_length())
    if width > 32:
        raise ValueError("more frequent words than ids of 32 bits")
    rounds = max(1, -(-slab_bits(int(found.most or 0)) // FAN_BITS))
    sizes = F.broadcast(sizes) if found.langs <= BROADCAST_ROWS else sizes
    dealt = rows.withColumn("_row", F.xxhash64(F.monotonically_increasing_id())).join(sizes, "lang")
    dealt = dealt.selectExpr("lang", "chunks", "pmod(_row, chunks) AS chunk", "text")

    def tell(key, table):
        return chunk_words(key[0].as_py(), key[1].as_py(), table)

    wanted = dealt.groupBy("lang", "chunk").applyInArrow(tell, "lang string, chunk long, word string")
    known = wanted.join(vocabulary.select("lang", "word", "id"), ["lang", "word"])

    def count(key, texts, ids):
        if not texts.num_rows:
            return as_table([])
        return as_table(chunk_filters(key[0].as_py(), key[1].as_py(), texts["chunks"][0].as_py(), texts, ids, width, longest))

    filters = dealt.groupBy("lang", "chunk").cogroup(known.groupBy("lang", "chunk")).applyInArrow(count, FILTERS_DDL)
    for turn in range(1, rounds):
        filters = _rounded(filters.join(sizes, "lang"), turn, width)

    def leave(key, table):
        space, (high, low_half, counts) = merged(key[1].as_py(), key[2].as_py(), table["filter"].to_pylist(), width)
        often = counts >= least
        ids = space.ids(high[often], low_half[often])
        lists = pa.ListArray.from_arrays(np.arange(0, ids.size + 1, space.n, dtype=np.int32), pa.array(ids.reshape(-1), pa.int64()))
        return pa.table([pa.array([key[0].as_py()] * len(ids), pa.string()), lists, pa.array(counts[often], pa.int64())], names=["lang", "ids", "f"])

    return filters.groupBy("lang", "n", "slab").applyInArrow(leave, "lang string, ids array<long>, f long")


def _rounded(filters: DataFrame, turn: int, width: int) -> DataFrame:
    """Filters whose slabs have ``turn`` * FAN_BITS bits, merged by residue of the chunk and cut into finer slabs.

    As many residues are kept apart as slabs are still to come of each, so a merge holds about one chunk.
    """
    left = f"greatest(0, ceil(log2(greatest(chunks, 1))) - {turn * FAN_BITS})"
    apart = filters.selectExpr("lang", "n", "slab", f"pmod(chunk, shiftleft(1L, cast({left} AS int))) AS chunk", "chunks", "filter")

    def finer(key, table):
        lang, n, slab, chunk = (k.as_py() for k in key)
        bits = min((turn + 1) * FAN_BITS, slab_bits(table["chunks"][0].as_py()))
        space, keys = merged(n, slab, table["filter"].to_pylist(), width)
        return as_table([(lang, n, s, chunk, blob) for s, blob in space.filters(*keys, bits)])

    return apart.groupBy("lang", "n", "slab", "chunk").applyInArrow(finer, FILTERS_DDL)


def scored(grams: DataFrame, vocabulary: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, ids, key, a, k, l, r, score) at the lowest cut of each phrase."""
    known = grams.selectExpr("lang", "array_join(ids, ' ') AS key", "f").union(vocabulary.selectExpr("lang", "cast(id AS string)", "f"))
    cuts = grams.selectExpr("lang", "ids", "f AS a", "explode(sequence(1, size(ids) - 1)) AS k")
    sides = cuts.selectExpr(
        "lang", "ids", "a", "k",
        "explode(array(named_struct('left', true, 'key', array_join(slice(ids, 1, k), ' ')), "
        "named_struct('left', false, 'key', array_join(slice(ids, k + 1, size(ids) - k), ' ')))) AS side",
    ).select("lang", "ids", "a", "k", "side.*")
    parts = sides.join(known, ["lang", "key"]).groupBy("lang", "ids", "a", "k").agg(
        F.expr("max(CASE WHEN left THEN f END) AS l"), F.expr("max(CASE WHEN NOT left THEN f END) AS r")
    )
    score = f"(cast({scale} AS decimal(18, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))"
    lowest = parts.groupBy("lang", "ids", "a").agg(F.expr(f"min(struct({score} AS score, k, l, r)) AS cut"))
    return lowest.selectExpr("lang", "ids", "array_join(ids, ' ') AS key", "a", "cut.*")


def outermost(phrases: DataFrame, grams: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Without phrases that mostly occur in one longer frequent phrase."""
    parts = grams.where(F.size("ids") > 2).selectExpr("lang", "f", "ids", "explode(sequence(2, size(ids) - 1)) AS n")
    parts = parts.selectExpr("lang", "f", "ids", "n", "explode(sequence(1, size(ids) - n + 1)) AS i")
    longer = parts.selectExpr("lang", "array_join(slice(ids, i, n), ' ') AS key", "f").groupBy("lang", "key").agg(F.max("f").alias("longer"))
    percent = f"cast(longer AS decimal(20, 0)) * 100 >= cast(a AS decimal(20, 0)) * {inside}"
    return phrases.join(longer, ["lang", "key"], "left").where(f"longer IS NULL OR NOT ({percent})").drop("longer")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    per_lang: int = PER_LANG,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The first ``per_lang`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    rows = prepared(docs, text_col, lang_col)
    counts = cut_lineage(word_counts(rows).where((F.col("f") >= least) | F.col("word").isNull()))
    vocabulary = cut_lineage(numbered(counts.where(F.col("word").isNotNull())))
    grams = cut_lineage(frequent_grams(rows, vocabulary, least, longest, chunk_bytes))
    phrases = outermost(scored(grams, vocabulary), grams)
    spelled = (
        phrases.select("lang", "key", F.posexplode("ids").alias("i", "id"))
        .join(vocabulary.select("lang", "id", "word"), ["lang", "id"])
        .groupBy("lang", "key")
        .agg(F.expr("array_join(transform(array_sort(collect_list(struct(i, word))), w -> w.word), ' ') AS phrase"))
    )
    phrases = cut_lineage(phrases.join(spelled, ["lang", "key"]).select("lang", "phrase", "a", "l", "r", "score"))
    first = places(phrases, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]).where(F.col("pos") < per_lang)
    total = counts.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    return first.join(total, "lang").selectExpr("lang", "pos + 1 AS rank", "phrase", "a", "l", "r", "n", "score")
