"""The query registry, table access and pieces of SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttmill.functions.text import ENTITIES_13A, TOKENIZER_13A
from uttmill.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table.  Each is one row group, so on a single machine its rows are dealt to all cores; a cluster reads it as it is."""
    df = read_table(spark, f"{folder}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.sparkContext.master.startswith("local[") else df


# ---- inputs, derived by Spark from the tables


def manifest(spark, folder):
    """documents as utterances: utt, spk, lang, text, samples, doc_id."""
    return table(spark, folder, "documents").select(
        F.concat(
            "lang", F.lit("_"), "source", F.lit("-audio-test-"), F.col("doc_id").cast("string")
        ).alias("utt"),
        F.col("source").alias("spk"),
        "lang",
        "text",
        (F.col("n_chars") * 1000).alias("samples"),
        "doc_id",
    )


def clips(spark, folder):
    """documents as clips: clip, lang, spk, text, cost, doc_id."""
    return table(spark, folder, "documents").select(
        F.concat(
            F.lit("common_voice_"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".mp3")
        ).alias("clip"),
        "lang",
        F.col("source").alias("spk"),
        "text",
        F.col("n_chars").alias("cost"),
        "doc_id",
    )


def pairs(spark, folder):
    """conversations as references (turn 2k) and hypotheses (turn 2k + 1), whole texts; ``conv_id`` counts pairs."""
    pair = F.shiftleft(F.col("conv_id"), 20) + F.floor(F.col("turn") / 2)
    turns = table(spark, folder, "conversations").select(pair.alias("conv_id"), (F.col("turn") % 2).alias("side"), "text")
    first = turns.where("side = 0").select("conv_id", F.col("text").alias("ref"))
    second = turns.where("side = 1").select("conv_id", F.col("text").alias("hyp"))
    return first.join(second, "conv_id").select(
        F.col("conv_id").cast("string").alias("utt"),
        (F.col("conv_id") % 10).cast("string").alias("spk"),
        "ref",
        "hyp",
        "conv_id",
    )


def templates(spark, folder):
    """The halves of the benchmark texts as (pos, prefix, postfix)."""
    rows = table(spark, folder, "benchmark").withColumn("w", F.split("text", r"[\s\x1C-\x1F\x85\p{Z}]+"))
    half = F.floor((F.size("w") + 1) / 2).cast("int")
    return rows.select(
        F.col("item_id").alias("pos"),
        F.concat(F.array_join(F.slice("w", F.lit(1), half), " "), F.lit(" ")).alias("prefix"),
        F.concat(F.lit(" "), F.array_join(F.slice("w", half + 1, F.size("w") - half), " ")).alias("postfix"),
    )


# ---- the same inputs in SQL

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squash_sql(x: str) -> str:
    return f"regexp_replace({strip_sql(x)}, '{WS}+', ' ', 'g')"


def clean_sql(x: str) -> str:
    x = f"lower({x})"
    x = rf"regexp_replace({x}, '[<\[][^>\]]*[>\]]', '', 'g')"
    x = rf"regexp_replace({x}, '\([^)]+\)', '', 'g')"
    x = rf"lower(regexp_replace({x}, '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g'))"
    return squash_sql(x)


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def tokens_13a_sql(x: str) -> str:
    """Words and punctuation as the 13a tokenizer separates them."""
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for name, char in ENTITIES_13A:
        x = f"replace({x}, '{name}', '{char}')"
    x = f"' ' || {x} || ' '"
    for pattern, by in TOKENIZER_13A:
        by = by.replace("$", "\\")
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return words_sql(x)


def chars_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).')"


def digest_sql(seed, *parts: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f"||'|'||{p}" for p in parts) + ")"


def slot_sql(seed, n, *parts: str) -> str:
    return f"(('0x'||substr({digest_sql(seed, *parts)},1,12))::BIGINT % ({n}))"


def unit_sql(seed, *parts: str) -> str:
    return f"(('0x'||substr({digest_sql(seed, *parts)},1,8))::BIGINT / 4294967296.0::DOUBLE)"


MANIFEST = """m AS (SELECT lang||'_'||source||'-audio-test-'||doc_id AS utt, source AS spk, lang, text,
  n_chars*1000 AS samples, doc_id FROM documents)"""

CLIPS = """c AS (SELECT 'common_voice_'||lang||'_'||doc_id||'.mp3' AS clip, lang, source AS spk, text,
  n_chars AS cost, doc_id FROM documents)"""

PAIRS = """pt AS (SELECT (conv_id << 20) + turn // 2 AS conv_id, turn % 2 AS side, text FROM conversations),
 p AS (SELECT a.conv_id::VARCHAR AS utt, (a.conv_id % 10)::VARCHAR AS spk, a.text AS ref, b.text AS hyp, a.conv_id
  FROM pt a JOIN pt b ON a.conv_id = b.conv_id AND a.side = 0 AND b.side = 1)"""

TEMPLATES = f"""tw AS (SELECT item_id AS pos, regexp_split_to_array(text, '{WS}+') AS w FROM benchmark),
 t AS (SELECT pos, array_to_string(w[1:(len(w) + 1) // 2], ' ')||' ' AS prefix, ' '||array_to_string(w[(len(w) + 1) // 2 + 1:], ' ') AS postfix FROM tw)"""
