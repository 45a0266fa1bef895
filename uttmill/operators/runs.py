"""Metrics of a training run: epochs to keep, parameters to average, decode logs.

Windows here run over the epochs of one criterion, of which a run has some hundreds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from .ranking import HOT_ROWS, hot_groups

#: spans of a hot job
SPANS = 256


def epoch_metrics(log: DataFrame) -> DataFrame:
    """(epoch, phase, key, value, weight): weighted means; absent values do not count."""
    present = log.where(F.col("value").isNotNull())
    return present.groupBy("epoch", "phase", "key").agg(
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"), F.sum("weight").alias("weight")
    )


def _better_first(mode: str) -> list[Column]:
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max: {mode}")
    value = F.col("value")
    return [value.asc() if mode == "min" else value.desc(), F.col("epoch").asc()]


def top_n_epochs(metrics: DataFrame, phase: str, key: str, mode: str, n: int) -> DataFrame:
    """(epoch, value, place): the n best of a criterion, an earlier epoch first on ties."""
    chosen = metrics.where((F.col("phase") == phase) & (F.col("key") == key))
    place = F.row_number().over(Window.partitionBy("phase", "key").orderBy(*_better_first(mode)))
    return chosen.withColumn("place", place.cast("bigint")).where(F.col("place") <= n).select("epoch", "value", "place")


def best_so_far(metrics: DataFrame, mode: str) -> DataFrame:
    """Adds ``best`` (running best) and ``improved`` per (phase, key)."""
    by_epoch = Window.partitionBy("phase", "key").orderBy("epoch")
    upto = by_epoch.rowsBetween(Window.unboundedPreceding, 0)
    before = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min if mode == "min" else F.max
    earlier = pick("value").over(before)
    better = F.col("value") < earlier if mode == "min" else F.col("value") > earlier
    return metrics.withColumn("best", pick("value").over(upto)).withColumn(
        "improved", F.coalesce(better, F.lit(True))
    )


def early_stop(metrics: DataFrame, mode: str, patience: int) -> DataFrame:
    """(phase, key, stop_epoch, best_epoch): the first epoch more than ``patience`` after the best so far."""
    upto = Window.partitionBy("phase", "key").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    marked = best_so_far(metrics, mode).withColumn(
        "best_epoch", F.last(F.when(F.col("improved"), F.col("epoch")), ignorenulls=True).over(upto)
    )
    late = marked.where(F.col("epoch") - F.col("best_epoch") > patience)
    return late.groupBy("phase", "key").agg(
        F.min("epoch").alias("stop_epoch"), F.min_by("best_epoch", "epoch").alias("best_epoch")
    )


def retained_checkpoints(metrics: DataFrame, criteria: list[tuple[str, str, str]], n: int) -> DataFrame:
    """(epoch, kept): epochs that are among the n best of any criterion, or the latest."""
    best = [top_n_epochs(metrics, phase, key, mode, n).select("epoch") for phase, key, mode in criteria]
    latest = metrics.agg(F.max("epoch").alias("epoch"))
    kept = reduce(DataFrame.unionByName, [*best, latest]).distinct().withColumn("kept", F.lit(True))
    return metrics.select("epoch").distinct().join(kept, "epoch", "left").select(
        "epoch", F.coalesce("kept", F.lit(False)).alias("kept")
    )


def average_parameters(states: DataFrame, epochs: DataFrame, n: int) -> DataFrame:
    """(name, idx, value): element-wise mean over the chosen epochs; whole numbers are added up.

    ``states`` (epoch, name, idx, dtype, value).
    """
    chosen = states.join(epochs.select("epoch"), "epoch", "left_semi")
    sums = chosen.groupBy("name", "idx").agg(F.sum("value").alias("_sum"), F.max("dtype").alias("dtype"))
    value = F.when(F.col("dtype").startswith("int"), F.col("_sum")).otherwise(F.col("_sum") / n)
    return sums.select("name", "idx", "dtype", value.alias("value"))


def pair_markers(
    events: DataFrame,
    job: str,
    order: list[str],
    marker: str,
    start: str,
    end: str,
    carry: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each start event with the next marker of its job, where that is an end.

    Returns (job, <carry of the start>, end_<carry>).  ``order`` must be unique inside a
    job.  The events of a hot job are cut into spans at quantiles of the first column of
    ``order`` (a number, date or time), and the last event of a span meets the first of the next one.
    """
    marks = events.where(F.col(marker).isin(start, end)).select(job, *dict.fromkeys([*order, marker, *carry]))
    following = F.struct(marker, *carry)
    first = F.col(order[0])
    if not isinstance(marks.schema[order[0]].dataType, (NumericType, DateType, TimestampType, TimestampNTZType)):
        paired = marks.withColumn("_next", F.lead(following).over(Window.partitionBy(job).orderBy(*order)))
    else:
        keyed = marks.withColumn("_group", F.xxhash64(job))
        hot = F.broadcast(hot_groups(marks, [job], hot_rows))
        cuts = keyed.join(hot, "_group").groupBy("_group").agg(F.percentile_approx(first, [i / SPANS for i in range(1, SPANS)]).alias("_cuts"))
        # as many rows as there are hot jobs
        spanned = keyed.join(F.broadcast(cuts), "_group", "left").withColumn("_key", F.struct(job))
        spanned = spanned.withColumn("_span", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= first)), F.lit(0)))
        ahead = Window.partitionBy("_key", "_span").orderBy(*order)
        heads = spanned.where(F.col("_cuts").isNotNull()).groupBy("_key", "_span").agg(F.min_by(following, F.struct(*order)).alias("_head"))
        heads = heads.select("_key", "_span", F.lead("_head").over(Window.partitionBy("_key").orderBy("_span")).alias("_head"))
        paired = spanned.withColumn("_next", F.lead(following).over(ahead)).join(heads, ["_key", "_span"], "left")
        paired = paired.withColumn("_next", F.coalesce("_next", "_head"))
    starts = paired.where((F.col(marker) == start) & (F.col(f"_next.{marker}") == end))
    return starts.select(job, *carry, *[F.col(f"_next.{c}").alias(f"end_{c}") for c in carry])


def parse_log(lines: DataFrame, line: str, start_pattern: str, end_pattern: str, time_pattern: str) -> DataFrame:
    """(…, marker, at, length) of log lines; lines without a marker go.

    The first group of ``start_pattern`` is the length of the input.
    """
    text = F.col(line)
    marker = F.when(text.rlike(start_pattern), "start").when(text.rlike(end_pattern), "end")
    return (
        lines.withColumn("marker", marker)
        .where(F.col("marker").isNotNull())
        .withColumn("at", F.to_timestamp(F.regexp_extract(text, time_pattern, 0)))
        .withColumn("length", F.when(F.col("marker") == "start", F.regexp_extract(text, start_pattern, 1)).cast("double"))
    )


def decode_rtf(pairs: DataFrame, begin: Column, finish: Column, length_s: Column) -> DataFrame:
    """One row: utterances, real-time factor and mean latency in seconds."""
    seconds = (F.unix_micros(finish.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / F.lit(1000000.0)
    timed = pairs.select(seconds.alias("_decode"), length_s.alias("_audio"))
    return timed.agg(
        F.count(F.lit(1)).alias("utterances"),
        (F.sum("_decode") / F.sum("_audio")).alias("rtf"),
        F.avg("_decode").alias("latency"),
    )
