"""Filters, key joins and unions of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, strip
from ..sources.readers import assert_unique
from .ranking import HOT_ROWS, keep_last

# ---- filters and projections


def text_fallback(df: DataFrame, raw: str, normalized: str, out: str = "text") -> DataFrame:
    """The raw text, or the normalized one where raw is empty; rows with neither go."""
    chosen = F.when(F.col(raw) == "", F.col(normalized)).otherwise(F.col(raw))
    return df.withColumn(out, chosen).where(F.col(out) != "")


def exclude_ids(df: DataFrame, column: str, ids: Sequence | DataFrame) -> DataFrame:
    """Rows whose id is not in a list, or not in a one-column table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.withColumnRenamed(ids.columns[0], column), column, "left_anti")
    return df.where(~F.col(column).isin(list(ids)))


def duration_filter(df: DataFrame, samples: str, min_s: float = 0.1, max_s: float = 20.0, rate: int = 16000) -> DataFrame:
    """Strictly between the two bounds, which are whole samples."""
    return df.where((F.col(samples) > int(min_s * rate)) & (F.col(samples) < int(max_s * rate)))


def frame_filter(df: DataFrame, shape: str, min_s: float = 0.1, max_s: float = 20.0, shift_ms: float = 10) -> DataFrame:
    """As ``duration_filter`` for a ``frames,dim`` shape text."""
    frames = F.split(F.col(shape), ",")[0].cast("bigint")
    return df.where((frames > int(min_s / shift_ms * 1000)) & (frames < int(max_s / shift_ms * 1000)))


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(strip(F.col(text)) != "")


def replicate_keys(df: DataFrame, n: int, utt: str = "utt") -> DataFrame:
    """Each row n times, under the keys utt-1 .. utt-n."""
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return copies.withColumn(utt, F.concat(F.col(utt), F.lit("-"), F.col("_copy").cast("string"))).drop("_copy")


def lm_text(tables: dict[str, DataFrame], utt: str = "utt", text: str = "text") -> DataFrame:
    """(utt, text) of several text tables.

    The part of the table name after ``text`` becomes a key suffix, runs of white
    space collapse, rows without text go.
    """
    parts = [
        drop_empty_text(df, text).select(
            F.concat(F.col(utt), F.lit(name.replace("text", "", 1))).alias("utt"),
            F.regexp_replace(strip(F.col(text)), f"{WS}+", " ").alias("text"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def dummy_source(df: DataFrame, key: str, out: str = "source") -> DataFrame:
    """A placeholder source per key; ``key`` is the recording where there are segments."""
    return df.select(F.col(key).alias("utt"), F.lit("<DUMMY>").alias(out))


def scale_by_speed(factor: Column, utt: Column, speaker: Column, samples: Column) -> list[Column]:
    """utt, spk and samples at a speed factor; factor 1 changes nothing."""
    same = factor == F.lit(1.0)
    prefix = F.concat(F.lit("sp"), factor.cast("string"), F.lit("-"))
    return [
        F.when(same, utt).otherwise(F.concat(prefix, utt)).alias("utt"),
        F.when(same, speaker).otherwise(F.concat(prefix, speaker)).alias("spk"),
        F.when(same, samples).otherwise(F.floor(samples / factor)).cast("bigint").alias("samples"),
    ]


def speed_union(df: DataFrame, factors: Sequence[float] = (0.9, 1.0, 1.1)) -> DataFrame:
    """The table at every speed, read once: a literal array is exploded per row."""
    rest = [c for c in df.columns if c not in ("utt", "spk", "samples")]
    spread = df.withColumn("_factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    return spread.select(
        *scale_by_speed(F.col("_factor"), F.col("utt"), F.col("spk"), F.col("samples")), *rest
    )


# ---- joins


def semi_filter(df: DataFrame, keys: DataFrame, on: str = "utt") -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def intersect_manifests(tables: dict[str, DataFrame], on: str = "utt") -> DataFrame:
    """Utterances that every table has, one column per table.

    One union and one aggregation: a single shuffle however many tables there are.
    """
    names = list(tables)
    parts = [
        df.select(on, *[(F.col(df.columns[1]) if n == m else F.lit(None)).cast(df.schema[1].dataType if n == m else tables[n].schema[1].dataType).alias(n) for n in names], F.lit(m).alias("_from"))
        for m, df in tables.items()
    ]
    # first value that is not null; absence in a table is seen in _from
    whole = reduce(DataFrame.unionByName, parts).groupBy(on).agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in names],
        *[F.max(F.col("_from") == n).alias(f"_has_{n}") for n in names],
    )
    everywhere = reduce(lambda a, b: a & b, [F.col(f"_has_{n}") for n in names])
    return whole.where(everywhere).select(on, *names)


def strict_join(df: DataFrame, table: DataFrame, on: str, on_missing: str = "error") -> DataFrame:
    """Lookup of every row's key in ``table`` (unique on ``on``).

    A missing key raises while the job runs, naming the key, or drops the row.  The
    check is a filter behind the join: no second pass, and no projection removes it.
    """
    if on_missing == "drop":
        return df.join(table, on)
    marked = df.join(table.withColumn("_found", F.lit(True)), on, "left")
    shown = F.coalesce(F.col(on).cast("string"), F.lit("null"))
    error = F.raise_error(F.concat(F.lit(f"no entry for {on} "), shown)).cast("boolean")
    return marked.where(F.when(F.col("_found"), F.lit(True)).otherwise(error)).drop("_found")


def translation_pairs(
    source: DataFrame, target: DataFrame, manifest: DataFrame, utt_of: Column, on_missing: str = "error"
) -> DataFrame:
    """(utt, text, value): target sentences on source recordings.

    ``source`` (id, pos, audio) and ``target`` (id, pos, text): the last row of an id
    wins on both sides.  ``utt_of`` builds the key from ``audio``; it must resolve in
    ``manifest`` (utt, value).
    """
    recordings = keep_last(source.select("id", "pos", "audio"), ["id"], F.col("pos")).select("id", "audio")
    sentences = keep_last(target.select("id", "pos", "text"), ["id"], F.col("pos")).select("id", "text")
    pairs = sentences.join(recordings, "id").select(utt_of.alias("utt"), "text")
    return strict_join(pairs, manifest, "utt", on_missing)


def attach_sentence_audio(
    pairs: DataFrame, audio: DataFrame, columns: Sequence[str], on_missing: str = "error"
) -> DataFrame:
    """One ``<column>_audio`` per sentence column, looked up by sentence text in (sentence, audio)."""
    for column in columns:
        lookup = audio.select(F.col("sentence").alias(column), F.col("audio").alias(f"{column}_audio"))
        pairs = strict_join(pairs, lookup, column, on_missing)
    return pairs


def attach_labels(rows: DataFrame, labels: DataFrame, on_missing: str = "error") -> DataFrame:
    """Labels (idx number, label) on rows keyed by ``idx`` as text."""
    return strict_join(rows, labels.select(F.col("idx").cast("string").alias("idx"), "label"), "idx", on_missing)


def pair_ref_hyp(refs: DataFrame, hyps: DataFrame, on: str = "utt") -> DataFrame:
    """(utt, spk, ref, hyp, label, has_ref, has_hyp): pairs by key, gaps visible."""
    left = refs.select(on, "spk", "ref").withColumn("has_ref", F.lit(True))
    right = hyps.select(on, "hyp").withColumn("has_hyp", F.lit(True))
    return left.join(right, on, "full_outer").select(
        on,
        "spk",
        "ref",
        "hyp",
        F.concat(F.lit("("), F.coalesce("spk", F.lit("")), F.lit("-"), F.col(on), F.lit(")")).alias("label"),
        F.coalesce("has_ref", F.lit(False)).alias("has_ref"),
        F.coalesce("has_hyp", F.lit(False)).alias("has_hyp"),
    )


def segments_to_utts(segments: DataFrame, recordings: DataFrame, rate: int = 16000) -> DataFrame:
    """(utt, recording, source, first, last): sample ranges of (utt, recording, start, end)."""
    joined = strict_join(segments, recordings.select("recording", "source"), "recording")
    return joined.select(
        "utt",
        "recording",
        "source",
        (F.col("start") * rate).cast("bigint").alias("first"),
        (F.col("end") * rate).cast("bigint").alias("last"),
    )


def fill_failed(
    expected: DataFrame, hyps: DataFrame, nbest: int, text: str, token: str, token_id: int, score: float
) -> DataFrame:
    """One row per expected utterance and rank; what was not decoded gets the defaults.

    An utterance with fewer hypotheses than ranks keeps only those it has.
    """
    decoded = hyps.select("utt").distinct()
    failed = (
        expected.select("utt")
        .join(decoded, "utt", "left_anti")
        .withColumn("nbest", F.explode(F.sequence(F.lit(1), F.lit(nbest))))
        .select(
            "utt",
            "nbest",
            F.lit(text).alias("text"),
            F.array(F.lit(token)).alias("token"),
            F.array(F.lit(token_id)).alias("token_int"),
            F.lit(float(score)).alias("score"),
        )
    )
    kept = hyps.where(F.col("nbest") <= nbest).select("utt", "nbest", "text", "token", "token_int", "score")
    return kept.join(expected.select("utt"), "utt", "left_semi").unionByName(failed)


# ---- set operations


def combine(tables: Sequence[DataFrame], utt: str = "utt", check: bool = True) -> DataFrame:
    """Union of tables; a key in two of them is an error."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return assert_unique(whole, [utt], "utterance") if check else whole


def sentence_pool(pairs: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Distinct sentences of several columns per group."""
    return pairs.select(group, F.explode(F.array(*columns)).alias("sentence")).distinct()
