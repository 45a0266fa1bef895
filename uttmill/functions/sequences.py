"""Array columns: token ids, padding, training sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import IGNORE_ID
from .let import let


def ctc_collapse(ids: Column, exclude: list[int]) -> Column:
    """One of each run of equal neighbours, then without the excluded ids."""
    heads = let(ids, lambda y: F.filter(y, lambda x, i: (i == 0) | (x != F.get(y, i - 1))))
    return F.filter(heads, lambda x: ~x.isin(exclude))


def emitted_ids(sequence: Column, blank: int = 0) -> Column:
    """A decoded sequence without its first and last symbol and without blanks."""
    inner = F.slice(sequence, F.lit(2), F.greatest(F.size(sequence) - 2, F.lit(0)))
    return F.filter(inner, lambda x: x != blank)


def add_sos(ids: Column, sos: int) -> Column:
    return F.concat(F.array(F.lit(sos).cast("bigint")), ids)


def add_eos(ids: Column, eos: int) -> Column:
    return F.concat(ids, F.array(F.lit(eos).cast("bigint")))


def pad(values: Column, size: Column, filler, left: bool = False) -> Column:
    missing = F.array_repeat(filler, (size - F.size(values)).cast("int"))
    return F.concat(missing, values) if left else F.concat(values, missing)


def repeat_label(ids: Column, label: Column, ignore: int = IGNORE_ID) -> Column:
    """The label at each position that holds a token."""
    return F.transform(ids, lambda x: F.when(x == ignore, F.lit(ignore).cast("bigint")).otherwise(label))


def count_equal(reference: Column, hypothesis: Column, ignore: int = IGNORE_ID) -> tuple[Column, Column]:
    """(equal, counted) positions where the reference is not the ignored id."""
    pairs = F.filter(F.arrays_zip(reference.alias("r"), hypothesis.alias("h")), lambda p: p["r"] != ignore)
    equal = F.filter(pairs, lambda p: p["r"] == p["h"])
    return F.size(equal).cast("bigint"), F.size(pairs).cast("bigint")


def numbers(text: Column, delimiter: str, kind: str) -> Column:
    """A number sequence; an empty text is an empty sequence and a bad number fails."""
    parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, delimiter))
    return F.transform(parts, lambda p: F.trim(p).cast(kind))


def chunk_starts(size: Column, length: Column, shift: Column) -> Column:
    return F.when(size >= length, F.sequence(F.lit(0).cast("bigint"), size - length, shift))
