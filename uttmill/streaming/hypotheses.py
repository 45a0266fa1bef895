"""Scoring of hypothesis files as the decoding jobs finish them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.evaluation import scored_pairs


def score_arriving(
    spark: SparkSession,
    folder: str,
    schema: str,
    refs: DataFrame,
    out: str,
    progress: str,
    levels: tuple[str, ...] = ("word",),
    cleaner: str | None = "whisper_basic",
):
    """A streaming query that adds the counts of every new hypothesis file to ``out``.

    Each row is scored on its own against the static references, so there is no state;
    the progress folder makes every file count once, also after a restart.  Start it
    again after more jobs have finished, or leave out the trigger to keep it running.
    """
    arriving = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    pairs = arriving.select("utt", F.col("text").alias("hyp")).join(refs.select("utt", "spk", "ref"), "utt")
    return (
        scored_pairs(pairs, levels, cleaner, cleaner)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
