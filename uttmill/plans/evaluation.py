"""Scores of an experiment, from references and hypotheses to the report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import REPORT_WEIGHTS
from ..functions.text import cleaner_chain, squash, tokenize, tokens_13a
from ..functions.keys import known_reference, normalize_choice
from ..operators.manifests import pair_ref_hyp
from ..operators.runs import decode_rtf, pair_markers, parse_log
from ..operators.scoring import accuracy, corpus_bleu, corpus_chrf, error_rates, macro_average, matthews, with_edit_counts
from ..session import stored


def scored_pairs(
    pairs: DataFrame,
    levels: Sequence[str] = ("char", "word"),
    cleaner: str | Sequence[str] | None = "whisper_basic",
    hyp_cleaner: str | Sequence[str] | None = "whisper_basic",
    symbols: Sequence[str] = (),
    weights: Sequence[int] = REPORT_WEIGHTS,
) -> DataFrame:
    """(level, utt, spk, corr, sub, del, ins) of (utt, spk, ref, hyp); both sides cleaned before tokenizing."""
    cleaned = pairs.select(
        *[c for c in pairs.columns if c not in ("ref", "hyp")],
        cleaner_chain(F.col("ref"), cleaner).alias("ref"),
        cleaner_chain(F.col("hyp"), hyp_cleaner).alias("hyp"),
    )
    parts = []
    for level in levels:
        tokens = cleaned.withColumn("ref", tokenize(F.col("ref"), level, symbols, True)).withColumn(
            "hyp", tokenize(F.col("hyp"), level, symbols, True)
        )
        parts.append(
            with_edit_counts(tokens, F.col("ref"), F.col("hyp"), weights).drop("ref", "hyp").withColumn("level", F.lit(level))
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def log_rtf(
    lines: DataFrame,
    job: str,
    order: Sequence[str],
    line: str,
    start_pattern: str,
    end_pattern: str,
    time_pattern: str,
    per_second: float = 1.0,
) -> DataFrame:
    """One row (utterances, rtf, latency) of decoding logs: markers, pairs, then times read from the lines.

    ``order`` is the order of the lines of a job; a length counts ``per_second`` units a second.
    """
    marked = parse_log(lines, line, start_pattern, end_pattern, time_pattern)
    pairs = pair_markers(marked, job, order, "marker", "start", "end", ["at", "length"])
    return decode_rtf(pairs, F.col("at"), F.col("end_at"), F.col("length") / F.lit(per_second))


def classification_report(
    rows: DataFrame, choices: Mapping[str, Sequence[str]], metrics: Mapping[str, str], exclude: Sequence[str] = ()
) -> DataFrame:
    """(task, metric, n, score) of stored answers (task, ref, hyp), and their macro average as task ``average``.

    ``choices``: the answers of a task in the order of their labels.  An unknown reference is
    an error, an unknown hypothesis label 0.  ``metrics``: ``accuracy`` or ``matthews`` per task.
    """
    parts = []
    for task, answers in choices.items():
        own = rows.where(F.col("task") == task).where(known_reference(F.col("ref"), list(answers))).select(
            "task",
            normalize_choice(F.col("ref"), list(answers), True).alias("ref"),
            normalize_choice(F.col("hyp"), list(answers), False).alias("hyp"),
        )
        n = F.count(F.lit(1)).alias("n")
        if metrics.get(task, "accuracy") == "matthews":
            scored = matthews(own, "task", "ref", "hyp").withColumnRenamed("matthews", "score")
            scored = scored.join(own.groupBy("task").agg(n), "task")
        else:
            scored = accuracy(own, "task", "ref", "hyp").withColumnRenamed("accuracy", "score")
        parts.append(scored.select("task", F.lit(metrics.get(task, "accuracy")).alias("metric"), "n", "score"))
    whole = reduce(DataFrame.unionByName, parts)
    mean = macro_average(whole, "task", "score", exclude)
    return whole.unionByName(mean.select(F.lit("average").alias("task"), F.lit("macro").alias("metric"), F.col("tasks").alias("n"), F.col("average").alias("score")))


def score_experiment(
    refs: DataFrame,
    hyps: DataFrame,
    dset: str,
    cleaner: str | Sequence[str] | None = "whisper_basic",
    hyp_cleaner: str | Sequence[str] | None = "whisper_basic",
    clean_hyp_for_bleu: bool = False,
) -> DataFrame:
    """(dset, metric, n, value): error rates, BLEU and chrF of one data set.

    A reference without a hypothesis counts as all deleted, a hypothesis without a
    reference as all inserted.  BLEU and chrF compare the cleaned reference with the
    raw hypothesis unless told otherwise.
    """
    paired = pair_ref_hyp(refs, hyps).select("utt", *[F.coalesce(c, F.lit("")).alias(c) for c in ("spk", "ref", "hyp")])
    # four scores read the pairs, so they are joined and cleaned once
    pairs = stored(
        paired.select(
            "utt",
            "spk",
            cleaner_chain(F.col("ref"), cleaner).alias("ref"),
            cleaner_chain(F.col("hyp"), hyp_cleaner).alias("hyp"),
            squash(F.col("hyp")).alias("raw"),
        ),
        "pairs",
    )
    counts = scored_pairs(pairs, ("char", "word"), None, None).withColumn("dset", F.concat_ws("|", F.lit(dset), "level"))
    rates = error_rates(counts.drop("level")).where(F.col("level") == "set")
    level = F.element_at(F.split("dset", r"\|"), -1)
    errors = rates.select(
        F.lit(dset).alias("dset"),
        F.concat(level, F.lit("_error_rate")).alias("metric"),
        F.col("words").alias("n"),
        (100 * F.col("error_rate")).alias("value"),
    )
    text_pairs = pairs.select("utt", "ref", F.col("hyp" if clean_hyp_for_bleu else "raw").alias("hyp"))
    bleu = corpus_bleu(text_pairs, "utt", tokens_13a(F.col("ref")), tokens_13a(F.col("hyp"))).select(
        F.lit(dset).alias("dset"), F.lit("bleu").alias("metric"), F.col("ref_len").alias("n"), F.col("bleu").alias("value")
    )
    chrf = corpus_chrf(text_pairs, "utt", F.col("ref"), F.col("hyp")).select(
        F.lit(dset).alias("dset"), F.lit("chrf").alias("metric"), F.col("orders").alias("n"), F.col("chrf").alias("value")
    )
    return errors.unionByName(bleu).unionByName(chrf)
