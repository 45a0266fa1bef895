"""One query per operator over its whole table, with the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .classifier import scored, train
from .collocations import collocations
from .decontamination import leaks
from .html_template import main_texts
from .licenses import labels, licenses
from .merkle import manifest, verified
from .mixing import mixture
from .quality_rules import quality
from .secrets import BASE, digest_line, secrets_of
from .sharding import sharded
from .simhash import near_duplicates
from .substring_dedup import remove_repeated_windows
from .suffix_dedup import remove_repeated_bytes

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
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op4_substring_dedup", oracles.SUBSTRING_DEDUP)
def substring_dedup(spark, folder):
    return remove_repeated_windows(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


@query("op5_suffix_dedup", oracles.SUFFIX_DEDUP)
def suffix_dedup(spark, folder):
    return remove_repeated_bytes(table(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op3_quality_rules")
def quality_rules(spark, folder):
    return quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_fallback_share", "token_entropy",
    )


@query("op7_simhash")
def simhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op8_mixing", oracles.MIXING)
def mixing(spark, folder):
    return mixture(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_sharding")
def sharding(spark, folder):
    return sharded(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op1_secrets", oracles.SECRETS)
def secrets(spark, folder):
    found, _ = secrets_of(table(spark, folder, "documents"))

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")

    base = F.filter("findings", lambda f: f["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE)],
        F.sha2(F.encode(digest_line(base), "UTF-8"), 256).alias("base_sha256"),
        digest_line(F.col("findings")).alias("spans"),
    )


@query("op6_html_template")
def html_template(spark, folder):
    return main_texts(table(spark, folder, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_classifier")
def classifier(spark, folder):
    docs = table(spark, folder, "documents")
    machine = train(docs, table(spark, folder, "labels"))
    return scored(docs, machine)


@query("op2_decontamination")
def decontamination(spark, folder):
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_merkle_manifest", oracles.MERKLE)
def merkle_manifest(spark, folder):
    odd_one = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    text = F.when(odd_one, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verified(manifest(table(spark, folder, "documents"), changed={"text": text})).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


@query("op13_license_scan")
def license_scan(spark, folder):
    spans = F.transform("hits", lambda h: F.concat_ws(":", h["label"], h["start"].cast("string"), h["end"].cast("string"), h["edits"].cast("string")))
    return licenses(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels(), ",").alias("labels"), "score", F.array_join(spans, ",").alias("spans"),
    )


@query("op12_phrase_collocations", oracles.COLLOCATIONS)
def phrase_collocations(spark, folder):
    return collocations(table(spark, folder, "documents"))
