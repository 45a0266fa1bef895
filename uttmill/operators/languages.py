"""Language names and language ids of utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LANGUAGE_NAME_OVERRIDES
from .manifests import strict_join


def language_table(first: DataFrame, second: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(source, code, name) of two code tables (code, name), of a few hundred rows each.

    ``overrides`` replace names of the second table, so that one language has one name
    in both.  The tables are the caller's: they belong to the corpora, not to the engine.
    """
    patch = LANGUAGE_NAME_OVERRIDES if overrides is None else overrides
    spark = first.sparkSession
    fixed = spark.createDataFrame(list(patch.items()), "code string, name string")
    patched = second.join(F.broadcast(fixed.select("code")), "code", "left_anti").unionByName(fixed)
    return first.select(F.lit(1).alias("source"), "code", "name").unionByName(
        patched.select(F.lit(2).alias("source"), "code", "name")
    )


def lang_names(utts: DataFrame, table: DataFrame, on_missing: str = "error") -> DataFrame:
    """Adds ``name`` to (…, source, code); an unknown code is an error.

    ``source`` says which table the code belongs to.
    """
    lookup = table.select(F.concat_ws("|", F.col("source").cast("string"), "code").alias("lang_key"), "name")
    keyed = utts.withColumn("lang_key", F.concat_ws("|", F.col("source").cast("string"), "code"))
    return strict_join(keyed, lookup, "lang_key", on_missing).drop("lang_key")


def language_universe(table: DataFrame, observed: DataFrame) -> DataFrame:
    """Names that are in a language table and observed."""
    return table.select("name").intersect(observed.select("name"))


def language_ids(utts: DataFrame, table: DataFrame) -> DataFrame:
    """(utt, lang_id): 1-based place of the name among the observed names in order.

    The universe cannot be larger than the language tables, so it is ranked in one
    array and broadcast.
    """
    names = language_universe(table, utts).agg(F.array_sort(F.collect_set("name")).alias("names"))
    ranked = names.select(F.posexplode("names").alias("pos", "name"))
    ids = ranked.select("name", (F.col("pos") + 1).cast("bigint").alias("lang_id"))
    return utts.join(F.broadcast(ids), "name").select("utt", "lang_id")
