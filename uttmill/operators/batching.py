"""Splits, batches, chunks and padding.

Batch sizes depend on lengths.  Either rows are first put into length classes, and inside a
class the batch of a row is its rank divided by the capacity of the class; or the sampler's greedy
loop is run over the different lengths and their counts (``greedy_batches``).  No task
walks through a sorted list of rows, and the result does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import shuffle_key, slot, unit
from ..functions.sequences import chunk_starts, pad
from .ranking import HOT_ROWS, dense_index, hash_span, rank_in_group, rows_of


def split_keys(df: DataFrame, n: int, utt: str = "utt") -> DataFrame:
    """Adds ``split`` 0..: contiguous, even parts in key order; n is at most the number of rows."""
    indexed = dense_index(df, [F.col(utt)], "_i")
    total = indexed.count()
    parts = max(min(n, total), 1)
    return indexed.withColumn("split", F.floor(F.col("_i") * parts / F.lit(max(total, 1))).cast("bigint")).drop("_i")


def split_manifests(df: DataFrame, n: int, iterations: int, utt: str = "utt") -> DataFrame:
    """``split_keys`` of a wide table, with the iterations of each split per epoch."""
    return split_keys(df, n, utt).withColumn(
        "split_iterations", F.floor((F.lit(iterations) + F.col("split")) / F.lit(n)).cast("bigint")
    )


def batch_fixed(df: DataFrame, size: int, order: Sequence[Column]) -> DataFrame:
    """Adds ``batch``: constant row counts along a total order."""
    indexed = dense_index(df, order, "_i")
    return indexed.withColumn("batch", F.floor(F.col("_i") / F.lit(size)).cast("bigint")).drop("_i")


def _leading_bits(length: Column) -> tuple[Column, Column]:
    """(magnitude, leading five bits) of a length: steps at most 1/16 wide."""
    drop = F.greatest(F.length(F.bin(length)) - 5, F.lit(0))
    return drop, F.call_function("shiftright", length, drop)


def _length_class(length: Column) -> Column:
    """The smallest length of the step a length is in."""
    drop, leading = _leading_bits(length)
    return F.call_function("shiftleft", leading, drop)


def _in_classes(
    df: DataFrame, classes: list[str], length: Column, capacity: Column, utt: str, min_batch_size: int, hot_rows: int
) -> DataFrame:
    """Adds ``batch`` inside each class: rank by (length step, digest of the key) over the capacity.

    Rows of one step differ by at most 1/16 in length, so their order inside it is free;
    the digest makes it even, and a hot class can be cut anywhere.  The rows of a class are
    dealt evenly over as many batches as the capacity asks for, or over fewer if a batch
    would fall below ``min_batch_size``; only a class with fewer rows than that stays below.
    """
    length = length.cast("bigint")
    drop, leading = _leading_bits(length)
    mixed = df.withColumn("_len", length).withColumn("_step", drop * 32 + leading)
    mixed = mixed.withColumn("_row", shuffle_key(0, F.col(utt)))
    longest = mixed.groupBy(*classes).agg(F.max("_len").alias("_longest"), F.count(F.lit(1)).alias("_rows"))
    ranked = rank_in_group(
        mixed,
        classes,
        [F.col("_step"), F.col("_row"), F.col(utt)],
        "_rank",
        lambda parts: F.col("_step") * parts + F.floor(unit(F.col("_row")) * parts),
        hot_rows,
    )
    joined = ranked.join(longest, classes)
    place = F.floor((F.col("_rank") - 1) / capacity)
    if min_batch_size > 1:
        full = F.ceil(F.col("_rows") / capacity)
        batches = F.greatest(F.lit(1), F.least(full, F.floor(F.col("_rows") / F.lit(min_batch_size))))
        place = F.floor((F.col("_rank") - 1) * batches / F.col("_rows"))
    return joined.withColumn("batch", place.cast("bigint")).drop("_rank", "_row", "_step", "_len", "_longest", "_rows")


def _merged_classes(df: DataFrame, category: list[str], column: str, least: int) -> DataFrame:
    """Joins classes to the next larger one until each has ``least`` rows; the largest join the one below.

    There are at most some hundreds of classes in a category, and only their sizes are
    walked through: from small to large, a class is open until it has enough rows.
    """
    group = [F.lit(0).alias("_all")] if not category else [F.col(c) for c in category]
    sizes = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    names = category or ["_all"]
    listed = sizes.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), F.col("_n").alias("n")))).alias("_l"))
    start = F.struct(F.lit(0).cast("bigint").alias("open"), F.array().cast("array<bigint>").alias("ends"))

    def step(state, x):
        full = state["open"] + x["n"] >= least
        return F.struct(
            F.when(full, F.lit(0).cast("bigint")).otherwise(state["open"] + x["n"]).alias("open"),
            F.when(full, F.concat(state["ends"], F.array(x["c"]))).otherwise(state["ends"]).alias("ends"),
        )

    ends = F.aggregate("_l", start, step, lambda s: s["ends"])
    listed = listed.select(*names, F.explode("_l").alias("_x"), ends.alias("_ends"))
    above = F.filter("_ends", lambda e: e >= F.col("_x.c"))
    to = F.when(F.size(above) > 0, F.array_min(above)).when(F.size("_ends") > 0, F.array_max("_ends")).otherwise(F.col("_x.c"))
    moves = listed.select(*category, F.col("_x.c").alias(column), to.alias("_to"))
    return df.join(F.broadcast(moves) if not category else moves, [*category, column]).withColumn(column, F.col("_to")).drop("_to")


def batch_by_bins(
    df: DataFrame,
    bins: int,
    length: Column,
    utt: str = "utt",
    dim: int = 1,
    category: Sequence[str] = (),
    min_batch_size: int = 1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``length_class`` and ``batch``; a batch is (category, length_class, batch).

    Rows times longest row times ``dim`` stays within ``bins``, but for batches of one
    row, and of ``min_batch_size`` rows where that is asked for.  Length classes with
    fewer rows than ``min_batch_size`` join the next longer class.  Categories are never mixed.
    """
    classed = df.withColumn("length_class", _length_class(length.cast("bigint")))
    if min_batch_size > 1:
        classed = _merged_classes(classed, list(category), "length_class", min_batch_size)
    capacity = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(bins) / (F.col("_longest") * dim)))
    return _in_classes(classed, [*category, "length_class"], length, capacity, utt, min_batch_size, hot_rows)


def batch_folded(
    df: DataFrame,
    size: int,
    lengths: Sequence[Column],
    folds: Sequence[int],
    utt: str = "utt",
    category: Sequence[str] = (),
    min_batch_size: int = 1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``fold`` and ``batch``: the batch size is divided by 1 + how often the longest input is folded.

    Folds with fewer rows than ``min_batch_size`` join the next larger fold.
    """
    factors = [F.floor(n / F.lit(f)).cast("bigint") for n, f in zip(lengths, folds)]
    factor = F.greatest(*factors) if len(factors) > 1 else factors[0]
    classed = df.withColumn("fold", factor)
    if min_batch_size > 1:
        classed = _merged_classes(classed, list(category), "fold", min_batch_size)
    capacity = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(size) / (F.col("fold") + 1)))
    return _in_classes(classed, [*category, "fold"], lengths[0], capacity, utt, min_batch_size, hot_rows)


def _walked(counts: list[int], capacities: list[int], first_decides: bool) -> tuple[list[int], list[int]]:
    """Where the batches of a sequential loop fall in runs of rows with the same capacity.

    Of each run ``head`` rows still join the open batch, number ``number``; the others start new
    batches of the run's capacity.  A batch is open while it has fewer rows than its
    capacity: that of its first row, or of the row to join.
    """
    heads, numbers = [], []
    rows, number, limit = 0, 0, 0
    for count, capacity in zip(counts, capacities):
        if not first_decides or not rows:
            limit = capacity
        head = max(0, min(count, limit - rows))
        heads.append(head)
        numbers.append(number)
        rows += head
        rest = count - head
        if rest:
            full = -(-rest // capacity)
            number, rows, limit = number + full, rest - (full - 1) * capacity, capacity
    return heads, numbers


def _greedy(
    df: DataFrame, category: list[str], key: Column, capacity: Column, utt: str, descending: bool, hot_rows: int
) -> DataFrame:
    """Adds ``batch``, as a loop over the rows in the order of (key, digest of ``utt``) makes them.

    Rows of one key are alike, so the loop runs over the keys and their counts: a category
    has no more of them than different keys, whatever its rows, and the rows only look up
    where the batches fall in their run.  ``capacity`` says how many rows a batch may have when
    its longest one has this key.
    """
    keyed = df.withColumn("_cap_key", key.cast("bigint")).withColumn("_row", shuffle_key(0, F.col(utt)))
    keyed = keyed.withColumn("_key_of", F.struct(*[F.col(c) for c in category], "_cap_key"))
    sizes = keyed.groupBy("_key_of").agg(F.count(F.lit(1)).alias("n"), F.max(capacity.cast("bigint")).alias("capacity"))
    names = [f"_c{i}" for i in range(len(category))]
    cells = sizes.select(
        *[F.col(f"_key_of.{c}").alias(n) for c, n in zip(category, names)], F.col("_key_of._cap_key").alias("_at"), "n", "capacity"
    )
    out = [*names, "_at", "capacity"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(out).schema)

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_at", "descending" if descending else "ascending")])
        heads, numbers = _walked(table["n"].to_pylist(), table["capacity"].to_pylist(), descending)
        return table.select(out).append_column("head", pa.array(heads, pa.int64())).append_column("number", pa.array(numbers, pa.int64()))

    runs = cells.groupBy(*names).applyInArrow(walk, f"{kinds}, head bigint, number bigint")
    key_of = F.struct(*[F.col(n).alias(c) for c, n in zip(category, names)], F.col("_at").alias("_cap_key"))
    runs = runs.select(key_of.alias("_key_of"), F.struct("capacity", "head", "number").alias("_run"))
    ranked = rank_in_group(keyed, ["_key_of"], [F.col("_row"), F.col(utt)], "_rank", hash_span(F.col("_row")), hot_rows)
    late = F.col("_rank") - 1 - F.col("_run.head")
    place = F.col("_run.number") + F.when(late < 0, 0).otherwise(1 + F.floor(late / F.col("_run.capacity")))
    return ranked.join(runs, "_key_of").withColumn("batch", place.cast("bigint")).drop("_key_of", "_cap_key", "_row", "_rank", "_run")


def greedy_batches(
    df: DataFrame,
    bins: int,
    length: Column,
    utt: str = "utt",
    dim: int = 1,
    category: Sequence[str] = (),
    min_batch_size: int = 1,
    descending: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``batch``: the rows sorted by length, cut by the sampler's own greedy rule, exactly.

    A row joins the open batch while rows times longest row times ``dim`` stay within ``bins``, or
    while the batch has fewer than ``min_batch_size`` rows; else it opens the next one.  Rows of one length
    stand in the order of their digest.  Lengths above ``bins / dim`` are alike, as each
    stands alone, so the loop has at most ``bins / dim + 1`` steps.
    """
    most = bins // dim
    clipped = F.greatest(F.lit(1), F.least(length.cast("bigint"), F.lit(most + 1)))
    capacity = F.greatest(F.lit(max(1, min_batch_size)).cast("bigint"), F.floor(F.lit(bins) / (F.col("_cap_key") * dim)))
    return _greedy(df, list(category), clipped, capacity, utt, descending, hot_rows)


def greedy_folded(
    df: DataFrame,
    size: int,
    lengths: Sequence[Column],
    folds: Sequence[int],
    utt: str = "utt",
    category: Sequence[str] = (),
    min_batch_size: int = 1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``fold`` and ``batch``: rows sorted by how often their longest input is folded, the most folded first.

    The size of a batch is divided by 1 + the fold of its first row; batches may go on into smaller folds.
    """
    factors = [F.floor(n / F.lit(f)).cast("bigint") for n, f in zip(lengths, folds)]
    folded = df.withColumn("fold", F.greatest(*factors) if len(factors) > 1 else factors[0])
    capacity = F.greatest(F.lit(max(1, min_batch_size)).cast("bigint"), F.floor(F.lit(size) / (F.col("_cap_key") + 1)))
    return _greedy(folded, list(category), F.col("fold"), capacity, utt, True, hot_rows)


def batch_fill(df: DataFrame, batch: Sequence[str], length: Column, bins: int, dim: int = 1) -> DataFrame:
    """One row: batches, rows, ``fill`` (mean of rows x longest x dim / bins) and ``padding`` (share of padded places)."""
    made = df.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("_n"), F.max(length.cast("bigint")).alias("_longest"), F.sum(length.cast("bigint")).alias("_used")
    )
    places = F.col("_n") * F.col("_longest")
    return made.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("_n").alias("rows"),
        F.avg(places * dim / F.lit(bins)).alias("fill"),
        (F.lit(1.0) - F.sum("_used") / F.sum(places)).alias("padding"),
    )


def order_batches(
    df: DataFrame,
    batch: Sequence[str],
    length: str,
    utt: str = "utt",
    sort_in_batch: str = "descending",
    sort_batch: str = "descending",
) -> DataFrame:
    """Adds ``place`` in the batch and ``batch_place`` among the batches, both 0-based.

    Batches are ordered by their longest row, equal ones by their first key.
    """

    def by(column: str, how: str) -> Column:
        return F.col(column).desc() if how == "descending" else F.col(column).asc()

    # a batch is bounded by its size
    inside = Window.partitionBy(*batch).orderBy(by(length, sort_in_batch), F.col(utt))
    placed = df.withColumn("place", (F.row_number().over(inside) - 1).cast("bigint"))
    heads = df.groupBy(*batch).agg(F.max(length).alias("_longest"), F.min(utt).alias("_first"))
    ordered = dense_index(heads, [by("_longest", sort_batch), F.col("_first")], "batch_place")
    return placed.join(ordered.select(*batch, "batch_place"), list(batch))


def batch_summary(df: DataFrame, batch: Sequence[str]) -> DataFrame:
    sizes = df.groupBy(*batch).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("batches"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max")
    )


def rank_slice(df: DataFrame, batch: Sequence[str], place: str, world: int) -> DataFrame:
    """Adds ``rank``: worker r takes places r, r + world, …; a batch smaller than the world is an error."""
    # a batch is bounded by its size
    sized = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*batch)))
    too_small = F.concat(F.lit("batch smaller than the number of workers: "), F.col("_n").cast("string"))
    checked = sized.where(F.when(F.col("_n") >= world, F.lit(True)).otherwise(F.raise_error(too_small).cast("boolean")))
    return checked.withColumn("rank", F.pmod(F.col(place), F.lit(world)).cast("bigint")).drop("_n")


def epoch_slice(
    batches: DataFrame, key: str, iterations: int, epochs: int, seed: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(epoch, iteration, pass, <key>): a fixed number of batches per epoch, the rest carries over.

    Passes over all batches follow each other, each in its own seeded order.
    """
    total = F.greatest(rows_of(batches), F.lit(1).cast("bigint"))
    passes = F.ceil(F.lit(epochs * iterations) / total)
    spread = batches.select(key).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1)))
    mixed = spread.withColumn("_row", shuffle_key(F.col("pass") + F.lit(seed), F.col(key)))
    ranked = rank_in_group(mixed, ["pass"], [F.col("_row"), F.col(key)], "_i", hash_span(F.col("_row")), hot_rows)
    at = F.col("pass") * total + F.col("_i") - 1
    return (
        ranked.withColumn("_at", at)
        .where(F.col("_at") < epochs * iterations)
        .select(
            F.floor(F.col("_at") / F.lit(iterations)).cast("bigint").alias("epoch"),
            F.pmod("_at", F.lit(iterations)).cast("bigint").alias("iteration"),
            F.col("pass").cast("bigint").alias("pass"),
            key,
        )
    )


def chunk_lengths(spec: str | int) -> list[int]:
    """``300``, ``300,400`` or ``300-400``."""
    text = str(spec)
    if "-" in text:
        low, high = text.split("-")
        return list(range(int(low), int(high) + 1))
    return [int(part) for part in text.split(",")]


def chunk_sequences(
    df: DataFrame, values: str, utt: str, lengths: str | int, shift_ratio: float, seed: int
) -> DataFrame:
    """(utt, start, chunk): overlapping windows of one drawn length per row.

    Only lengths the row reaches are drawn; a shorter row gives nothing.
    """
    options = F.array(*[F.lit(n).cast("bigint") for n in chunk_lengths(lengths)])
    size = F.size(values).cast("bigint")
    fitting = F.filter(options, lambda n: n <= size)
    length = F.get(fitting, slot(seed, F.greatest(F.size(fitting), F.lit(1)), F.col(utt)))
    drawn = df.select(utt, values, length.alias("_len"))
    shift = F.greatest(F.floor(F.col("_len") * F.lit(shift_ratio)).cast("bigint"), F.lit(1).cast("bigint"))
    # rows without a length go behind the explode: a filter before it would compute the values again
    return drawn.withColumn(
        "start", F.explode_outer(chunk_starts(F.size(values).cast("bigint"), F.col("_len"), shift))
    ).where(F.col("start").isNotNull()).select(utt, "start", F.slice(values, (F.col("start") + 1).cast("int"), F.col("_len").cast("int")).alias("chunk"))


def pad_batch(df: DataFrame, batch: Sequence[str], values: str, filler: Column, length: str = "length") -> DataFrame:
    """Pads an array column to the longest of its batch and keeps the true length."""
    longest = Window.partitionBy(*batch)
    sized = df.withColumn(length, F.size(values).cast("bigint")).withColumn("_longest", F.max(length).over(longest))
    return sized.withColumn(values, pad(F.col(values), F.col("_longest"), filler)).drop("_longest")


def assemble_lm_sequence(
    df: DataFrame,
    batch: Sequence[str],
    prefix: str,
    source: str,
    postfix: str,
    target: str,
    pad_id: int,
    side: str = "right",
) -> DataFrame:
    """Adds ``tokens``, ``mask`` and ``no_loss_len``: prefix, source, postfix and target without its start.

    The last element of the postfix predicts the first target token, so the loss starts
    at its place.  Rows are padded to the longest of their batch on ``side``.
    """
    joined = F.concat(prefix, source, postfix, F.slice(target, F.lit(2), F.greatest(F.size(target) - 1, F.lit(0))))
    sized = (
        df.withColumn("_tokens", joined)
        .withColumn("_n", F.size("_tokens"))
        .withColumn("_longest", F.max("_n").over(Window.partitionBy(*batch)))
    )
    left = side == "left"
    ones = F.array_repeat(F.lit(1).cast("bigint"), F.col("_n"))
    return (
        sized.withColumn("no_loss_len", (F.size(prefix) + F.size(source) + F.size(postfix) - 1).cast("bigint"))
        .withColumn("tokens", pad(F.col("_tokens"), F.col("_longest"), F.lit(pad_id).cast("bigint"), left))
        .withColumn("mask", pad(ones, F.col("_longest"), F.lit(0).cast("bigint"), left))
        .drop("_tokens", "_n", "_longest")
    )
