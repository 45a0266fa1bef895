"""Writers.  Every record carries its key, so nothing relies on line alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chance import slot
from ..functions.text import json_quote


def write_manifest(df: DataFrame, path: str, value: str = "value", utt: str = "utt") -> None:
    """``utt value`` lines, sorted by utterance across the files of the folder."""
    (
        df.select(utt, value)
        .orderBy(utt)
        .select(F.concat_ws(" ", F.col(utt), F.when(F.col(value) != "", F.col(value))).alias("value"))
        .write.mode("errorifexists")
        .text(path)
    )


def _filed(df: DataFrame, folder: str, files: int) -> DataFrame:
    """Rows together that go to one of the ``files`` files of a folder, so that not every task writes to every folder."""
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c != folder]), F.lit(files))
    return df.repartition(F.col(folder), part)


def write_shards(
    df: DataFrame, path: str, n: int, key: str, columns: list[str], seed: int = 0, files: int = 8
) -> None:
    """JSON-quoted columns, one record per line, in ``n`` shard folders of ``files`` files.

    A shard is a slot of the key, so one very frequent key would fill one shard.
    """
    sharded = df.withColumn("shard", slot(seed, n, F.col(key))).select(
        "shard", key, *[json_quote(F.col(c)).alias(c) for c in columns]
    )
    (
        _filed(sharded, "shard", files)
        .write.mode("errorifexists")
        .partitionBy("shard")
        .json(path)
    )


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_templates(df: DataFrame, path: str, per_file: int = 10_000) -> None:
    """(pos, prefix, postfix), numbered from 0, as JSON lists of ``[prefix, postfix]`` pairs.

    A list holds ``per_file`` pairs, one to a line, in a folder of its own; the folders follow each other in order.
    """
    last = df.agg(F.max("pos")).scalar()
    pair = F.to_json(F.array("prefix", "postfix"))
    line = F.concat(
        F.when(F.col("pos") % per_file == 0, "[").otherwise(","),
        pair,
        F.when((F.col("pos") % per_file == per_file - 1) | (F.col("pos") == last), "]").otherwise(""),
    )
    listed = df.select(F.lpad(F.floor(F.col("pos") / per_file).cast("string"), 12, "0").alias("list"), "pos", line.alias("value"))
    listed.repartition("list").sortWithinPartitions("list", "pos").select("list", "value").write.mode("errorifexists").partitionBy("list").text(path)


def write_nbest(df: DataFrame, path: str, files: int = 8) -> None:
    """Hypotheses, one folder of ``files`` files per rank."""
    _filed(df, "nbest", files).write.mode("errorifexists").partitionBy("nbest").parquet(path)


def merge_shards_sorted(spark: SparkSession, path: str, key: str = "utt") -> DataFrame:
    """The outputs of all jobs below a folder, sorted by key."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path).orderBy(key)


def write_eval_rows(df: DataFrame, path: str, files: int = 8) -> None:
    """(task, pos, ref, hyp) as JSON lines, one folder of ``files`` files per task."""
    _filed(df.select("task", "pos", "ref", "hyp"), "task", files).write.mode("errorifexists").partitionBy("task").json(path)


def result_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, line): a Markdown table; ``df`` holds one row per score and is report-sized."""
    header = df.sparkSession.createDataFrame(
        [(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "pos int, line string"
    )
    body = df.select(
        F.lit(2).alias("pos"),
        F.concat(
            F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")
        ).alias("line"),
    )
    return header.unionAll(body)


def write_result_table(df: DataFrame, columns: list[str], path: str) -> None:
    result_table(df, columns).orderBy("pos", "line").select("line").write.mode("errorifexists").text(path)
