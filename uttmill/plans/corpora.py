"""Whole preparations: several corpora to one manifest, and the instruction set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import source_command, utt_id_clip, utt_id_parliament, utt_id_read_speech, year_of
from ..functions.text import json_unquote, strip, tokenize, valid_target
from ..operators.manifests import combine, drop_empty_text, exclude_ids, semi_filter, strict_join, text_fallback
from ..operators.ranking import HOT_ROWS
from ..operators.sampling import budgeted_diverse_sample, deal_targets
from ..operators.vocabulary import digest_of, tokens_to_ids
from ..sources.readers import assert_unique, read_allowlist, read_clip_tsv, read_durations
from ..sources.writers import write_manifest

# Read commands of the corpora.
READ_SPEECH_COMMAND = "sox --norm=-1 %s -r 16k -t wav -c 1 -b 16 -e signed - |"
CLIP_COMMAND = "ffmpeg -i %s/clips/%s -f wav -ar 16000 -ab 16 -ac 1 - |"
PARLIAMENT_COMMAND = 'ffmpeg -i "%s/%s/%s.ogg" -f wav -ar 16000 -ab 16 -ac 1 - |'
# Sentence ids that are left out of read speech.
EXCLUDED_SENTENCE_IDS = (10,)

_COLUMNS = ["dset", "utt", "spk", "source", "text"]


def read_speech(df: DataFrame, dset: str, exclude: Sequence[int] = EXCLUDED_SENTENCE_IDS) -> DataFrame:
    """(path, text, id, lang) rows as a manifest; each utterance is its own speaker."""
    kept = exclude_ids(df, "id", exclude)
    utt = utt_id_read_speech(F.col("lang"), F.col("path"))
    return kept.select(
        F.lit(dset).alias("dset"),
        utt.alias("utt"),
        utt.alias("spk"),
        source_command(READ_SPEECH_COMMAND, F.col("path")).alias("source"),
        "text",
    )


def clips(df: DataFrame, dset: str, allowed: DataFrame) -> DataFrame:
    """(folder, clip, text) rows as a manifest of the allowed utterances."""
    utt = utt_id_clip(F.col("clip"))
    rows = df.select(
        F.lit(dset).alias("dset"),
        utt.alias("utt"),
        utt.alias("spk"),
        source_command(CLIP_COMMAND, F.col("folder"), F.col("clip")).alias("source"),
        "text",
    )
    return semi_filter(rows, allowed)


def parliament(df: DataFrame, dset: str, folder: str) -> DataFrame:
    """(id, speaker_id, raw_text, normalized_text) rows as a manifest."""
    return text_fallback(df, "raw_text", "normalized_text").select(
        F.lit(dset).alias("dset"),
        utt_id_parliament(F.col("speaker_id"), F.col("id")).alias("utt"),
        F.col("speaker_id").alias("spk"),
        source_command(PARLIAMENT_COMMAND, F.lit(folder), year_of(F.col("id")), F.col("id")).alias("source"),
        "text",
    )


def subsample_clips(
    spark: SparkSession, durations: str, folder: str, out: str, hours: float, seed: int, name: str = "train.tsv"
) -> DataFrame:
    """The ids of a text-diverse sample of at most ``hours`` per language, written to ``out`` and returned.

    Every clip of ``<folder>/<lang>/<name>`` needs a duration in the table ``durations``.
    """
    listed = strict_join(read_clip_tsv(spark, folder, name), read_durations(spark, durations), "clip")
    sample = budgeted_diverse_sample(listed, "lang", "text", "seconds", hours * 3600, seed, "clip")
    utts = sample.select(utt_id_clip(F.col("clip")).alias("utt"), F.lit("").alias("value"))
    write_manifest(utts, out)
    return read_allowlist(spark, out)


def prepare_corpora(parts: Sequence[DataFrame], check: bool = True) -> DataFrame:
    """One manifest (dset, utt, spk, source, text); a data set is a column, not a folder."""
    whole = combine([drop_empty_text(p.select(*_COLUMNS)) for p in parts], check=False)
    return assert_unique(whole, ["dset", "utt"], "utterance") if check else whole


def build_instruction_set(
    rows: DataFrame,
    utts: DataFrame,
    vocab: DataFrame,
    utt_order: str,
    level: str = "word",
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(dealt, leftover) from generated targets.

    ``rows`` (shard, line, text, prefix, postfix, output), the last three as JSON
    literals; ``utts`` (utt, text, <utt_order>, …).  Invalid targets go, the rest is
    dealt over the utterances, and prefix, postfix and output become token ids.
    """
    unquoted = rows.select(
        F.col("shard").alias("_shard"),
        F.col("line").alias("_line"),
        strip(F.col("text")).alias("text"),
        *[tokenize(json_unquote(F.col(c)), level).alias(c) for c in ("prefix", "postfix", "output")],
    )
    columns = ["prefix", "postfix", "output"]
    valid = unquoted.where(valid_target(*[F.col(c) for c in columns])).withColumn("_digest", digest_of(columns))
    # targets are dealt by their digests; tokens are moved only to become ids, and to those left over
    dealt, leftover = deal_targets(utts, valid.drop(*columns), utt_order, ("_shard", "_line"), hot_rows)
    arrays = valid.select("_digest", *columns)
    ids = tokens_to_ids(dealt.drop("_shard", "_line"), vocab, columns, arrays=arrays)
    leftover = leftover.drop("_shard", "_line").join(arrays.dropDuplicates(["_digest"]), "_digest").drop("_digest")
    return ids, leftover
