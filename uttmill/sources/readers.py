"""Readers of the text formats a corpus comes in.

Absence is the empty string, never null.  Duplicate keys fail in the plan, not
through a scan on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import numbers
from ..functions.text import _WS_CHARS, WS, strip
from ..operators.ranking import keep_last

# Delimiter and element type of the number-sequence formats.
NUMBER_FORMATS = {
    "text_int": (" ", "bigint"),
    "text_float": (" ", "double"),
    "csv_int": (",", "bigint"),
    "csv_float": (",", "double"),
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, split as Spark splits it."""
    return spark.read.parquet(path)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "key") -> DataFrame:
    """``df`` itself; a key that occurs twice raises while the job runs, naming the key.

    The check is a filter of the plan: nothing runs before the caller's action, and no
    projection removes it.
    """
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    shown = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    error = F.raise_error(F.concat(F.lit(f"duplicate {what}: "), shown)).cast("boolean")
    return df.withColumn("_times", times).where(F.when(F.col("_times") == 1, F.lit(True)).otherwise(error)).drop("_times")


def _key_and_value(line: Column) -> tuple[Column, Column]:
    stripped = strip(line)
    return (
        F.regexp_extract(stripped, rf"(?s)^({_NOT_WS}+)", 1),
        F.regexp_extract(stripped, rf"(?s)^{_NOT_WS}+{WS}+(.*)$", 1),
    )


_NOT_WS = "[^" + WS[1:]


def read_manifest(spark: SparkSession, path: str | list[str], check: bool = True) -> DataFrame:
    """(utt, value): one ``key value`` line per utterance."""
    utt, value = _key_and_value(F.col("value"))
    df = spark.read.text(path).select(utt.alias("utt"), value.alias("value"))
    return assert_unique(df, ["utt"], "utterance") if check else df


def read_multi(spark: SparkSession, path: str, return_unsplit: bool = False, check: bool = True) -> DataFrame:
    """(utt, values[, unsplit]): the value split on white space; ``[""]`` if there is none."""
    df = read_manifest(spark, path, check).select(
        "utt", F.split("value", f"{WS}+").alias("values"), F.col("value").alias("unsplit")
    )
    return df if return_unsplit else df.drop("unsplit")


def read_num_seq(spark: SparkSession, path: str, loader_type: str = "csv_int", check: bool = True) -> DataFrame:
    """(utt, seq): a number sequence per utterance."""
    if loader_type not in NUMBER_FORMATS:
        raise ValueError(f"unknown number format: {loader_type}")
    delimiter, kind = NUMBER_FORMATS[loader_type]
    return read_manifest(spark, path, check).select("utt", numbers(F.col("value"), delimiter, kind).alias("seq"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): text lines with their 0-based number in their file.

    The rows of one file split lie next to each other in one task, so a line's number
    is its distance from the first row of its split plus the lines of earlier splits.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("file", "_block")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return lines.join(splits, ["file", "_block"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_start")).alias("line"), "value"
    )


def parse_labels(lines: DataFrame) -> DataFrame:
    """(utt, labels) of (file, line, value) rows: start/end/phone triples, a later key wins."""
    words = F.split(strip(F.col("value")), f"{WS}+")
    triples = F.transform(
        F.when(F.size("w") >= 4, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 3).cast("int") - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(
            F.get("w", i * 3 + 1).alias("start"), F.get("w", i * 3 + 2).alias("end"), F.get("w", i * 3 + 3).alias("phone")
        ),
    )
    parsed = lines.select(F.struct("file", "line").alias("at"), words.alias("w")).select("at", F.get("w", F.lit(0)).alias("utt"), triples.alias("labels"))
    return keep_last(parsed, ["utt"], F.col("at")).select("utt", "labels")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(numbered_lines(spark, path))


def read_clip_tsv(spark: SparkSession, folder: str, name: str = "train.tsv") -> DataFrame:
    """(lang, spk, clip, text) of ``<folder>/<lang>/train.tsv``; header lines start with ``client``.

    A language folder may also be a partition folder ``lang=<lang>``.  A line may end before its sentence,
    and begin with the tab behind an absent speaker.
    """
    # no tab before the first column goes, as it stands for an absent speaker
    line = F.rtrim(F.ltrim(F.col("value"), F.lit(_WS_CHARS.replace("\t", ""))), F.lit(_WS_CHARS))
    columns = F.split(line, "\t")
    return (
        spark.read.text(f"{folder}/*/{name}")
        .where(~F.col("value").startswith("client"))
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), "([^/=]+)/[^/]+$", 1).alias("lang"),
            columns[0].alias("spk"),
            columns[1].alias("clip"),
            F.coalesce(F.get(columns, F.lit(2)), F.lit("")).alias("text"),
        )
    )


def read_named_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A TSV with a header; empty fields stay empty strings."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", "\t")
        .option("escape", '"')
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
        .na.fill("")
    )


def quoted_records(spark: SparkSession, path: str | list[str], end: str, quotes: Column) -> DataFrame:
    """(file, block, record, text): records that end with ``end`` outside of quotes, ``end`` left out.

    Files are read in splits, also within a record: rows are what lies between two ``end``s, and
    ``quotes`` counts the quotes in a row (``value``).  A row is inside quotes if the quotes before it are
    odd in number.  That is a prefix sum: of the splits before (a table of one row per
    split), and of the rows before in the split.  Rows after the first one of a record are joined to it
    within their split; only what crosses the edge of a split meets its record in a second step.

    ``block`` is the offset of the split in which a record starts, ``record`` its number there from 1, so
    (file, block, record) is the order of the records.
    """
    rows = spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
        quotes.cast("bigint").alias("_quotes"),
        "value",
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "block").agg(F.sum("_quotes").alias("_sum"))
    odd_before = sums.select("file", "block", F.pmod(F.coalesce(F.sum("_sum").over(earlier), F.lit(0)), F.lit(2)).alias("_open"))
    # a split is one group, as large as the reader makes it
    so_far = Window.partitionBy("file", "block").orderBy("_id")
    before = F.coalesce(F.sum("_quotes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_open")
    marked = rows.join(odd_before, ["file", "block"]).withColumn("_starts", (F.pmod(before, F.lit(2)) == 0).cast("bigint"))
    numbered = marked.withColumn("record", F.sum("_starts").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))

    def joined(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column, "value"))), lambda x: x["value"]), end)

    numbered = numbered.withColumn("_records", F.max("record").over(Window.partitionBy("file", "block")))
    pieces = numbered.groupBy("file", "block", "record").agg(joined("_id").alias("value"), F.max("_records").alias("_records"))
    # no join here: a check of whole records must not be pushed down to pieces
    inside = pieces.where((F.col("record") > 0) & (F.col("record") < F.col("_records"))).select("file", "block", "record", "value")
    # what opens a split in the middle of a record belongs to the last record before it
    owner = F.max(F.when(F.col("_records") > 0, F.struct("block", "_records"))).over(earlier)
    owners = numbered.groupBy("file", "block").agg(F.max("record").alias("_records")).select("file", "block", owner.alias("_owner"))
    edge = pieces.where((F.col("record") == 0) | (F.col("record") == F.col("_records"))).join(owners, ["file", "block"]).select(
        "file",
        F.when(F.col("record") == 0, F.col("_owner.block")).otherwise(F.col("block")).alias("_block"),
        F.when(F.col("record") == 0, F.col("_owner._records")).otherwise(F.col("record")).alias("record"),
        F.col("block").alias("_at"),
        "value",
    )
    edge = edge.groupBy("file", F.col("_block").alias("block"), "record").agg(joined("_at").alias("value"))
    return inside.unionByName(edge).select("file", "block", "record", F.col("value").alias("text"))


def read_task_csv(spark: SparkSession, path: str, schema: str, key: str = "idx") -> DataFrame:
    """A CSV with a header, quotes and line breaks in fields; of equal keys the later row wins.

    Large files are cut inside: any split may begin within a quoted field.
    """
    count = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    records = quoted_records(spark, path, "\n", count).where(~((F.col("block") == 0) & (F.col("record") == 1)))
    line = F.regexp_replace("text", "\r$", "")
    fields = F.from_csv(line, schema, {"quote": '"', "escape": '"'})
    parsed = records.where(line != "").select(fields.alias("_row"), F.struct("file", "block", "record").alias("_at"))
    return keep_last(parsed.select("_row.*", "_at").na.fill(""), [key], F.col("_at")).drop("_at")


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    """(clip, seconds)."""
    return spark.read.schema("clip string, seconds double").option("sep", "\t").option("quote", "").csv(path)


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(utt): one id per line, stripped, distinct."""
    return spark.read.text(path).select(strip(F.col("value")).alias("utt")).distinct()


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(pos, prefix, postfix) of JSON lists of ``[prefix, postfix]`` pairs, file after file.

    A file is cut at every ``]``, so a list of any size is read by many tasks, also if it is one line.
    A bracket inside a string ends nothing.  Anything but pairs of strings is an error; a file may
    also be a single pair.
    """
    # escaped characters count for nothing
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    count = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    # before the pair: the bracket of the list, or a comma; behind the last one nothing is left
    pair = F.regexp_replace("text", r"^\s*(\[(?=\s*\[)|,)?\s*", "")
    pairs = quoted_records(spark, path, "]", count).select("file", "block", "record", pair.alias("pair"))
    pairs = pairs.where(~F.col("pair").rlike(r"^\[?\s*$"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split
    starts = pairs.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("record").alias("_first"))
    starts = starts.select("file", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    values = F.from_json(F.concat("pair", F.lit("]")), "array<string>")
    wrong = F.raise_error(F.concat(F.lit("not a pair of strings: "), F.col("pair"))).cast("boolean")
    listed = pairs.join(starts, ["file", "block"]).withColumn("_values", values)
    checked = listed.where(F.when(F.col("_values").isNotNull() & (F.size("_values") == 2) & F.col("pair").startswith("["), F.lit(True)).otherwise(wrong))
    return checked.select(
        (F.col("record") + F.col("_shift")).alias("pos"), F.col("_values")[0].alias("prefix"), F.col("_values")[1].alias("postfix")
    )


def read_aligned(
    spark: SparkSession, folders: dict[str, str], shard_pattern: str = r"(\d+)\.txt$"
) -> tuple[DataFrame, DataFrame]:
    """Files that belong together line by line.

    ``folders`` maps a column to the path of its shard files; the first group of
    ``shard_pattern`` is the shard number in a file path.  Returns (rows, lengths):
    rows (shard, line, <columns>) up to the shortest file of a shard, and the line
    count of every file, so that a cut-off tail is visible.
    """
    rows, lengths = None, None
    for column, path in folders.items():
        part = numbered_lines(spark, path).select(
            F.regexp_extract("file", shard_pattern, 1).cast("bigint").alias("shard"),
            "line",
            F.col("value").alias(column),
        )
        rows = part if rows is None else rows.join(part, ["shard", "line"])
        n = part.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select(F.lit(column).alias("column"), "shard", "n")
        lengths = n if lengths is None else lengths.unionAll(n)
    return rows, lengths


def check_tables(
    df: DataFrame, required: Sequence[str], optional: Sequence[str] = (), dset: str = "dset", allow_others: bool = False
) -> DataFrame:
    """(dset, column, n_rows, n_missing) of every required and optional column present.

    A required column that is absent, or a column that is neither, is an error.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    known = {dset, "utt", *required, *optional}
    others = [c for c in df.columns if c not in known]
    if others and not allow_others:
        raise ValueError(f"unexpected columns: {', '.join(others)}")
    names = [c for c in [*required, *optional] if c in df.columns]
    empty = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in names]
    counts = df.groupBy(dset).agg(F.count(F.lit(1)).alias("n_rows"), *empty)
    return counts.unpivot([dset, "n_rows"], names, "column", "n_missing").select(
        dset, "column", "n_rows", "n_missing"
    )
