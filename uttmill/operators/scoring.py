"""Scores of hypotheses and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import FAILED_SCORE, FAILED_TEXT, FAILED_TOKEN_ID, REPORT_WEIGHTS, SPACE
from ..functions.assignment import best_assignment
from ..functions.edits import edit_counts
from ..functions.grams import gram_matches as grams_of_pair
from ..functions.let import let
from ..functions.sequences import count_equal
from ..functions.text import WS, characters
from .manifests import fill_failed
from .ranking import total_up_to

COUNTS = ["corr", "sub", "del", "ins"]


def with_edit_counts(df: DataFrame, ref: Column, hyp: Column, weights: Sequence[int] = REPORT_WEIGHTS) -> DataFrame:
    """Adds corr, sub, del and ins of two token columns."""
    return df.withColumn("_counts", edit_counts(ref, hyp, weights)).select(*df.columns, "_counts.*")


def error_rates(counts: DataFrame, dset: str = "dset", spk: str = "spk") -> DataFrame:
    """Totals and rates per speaker, per set and overall.

    ``level`` is speaker, set or all; a missing name is the empty string.  The error
    rate divides by the reference length, the sentence error rate by the sentences.
    """
    wrong = (F.col("sub") + F.col("del") + F.col("ins") > 0).cast("bigint")
    rolled = counts.rollup(dset, spk).agg(
        F.count(F.lit(1)).alias("sentences"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum(wrong).alias("wrong"),
        F.grouping_id().alias("_level"),
    )
    words = F.col("corr") + F.col("sub") + F.col("del")
    return rolled.select(
        F.when(F.col("_level") == 0, "speaker").when(F.col("_level") == 1, "set").otherwise("all").alias("level"),
        F.coalesce(dset, F.lit("")).alias(dset),
        F.coalesce(spk, F.lit("")).alias(spk),
        "sentences",
        words.alias("words"),
        *COUNTS,
        F.when(words > 0, (F.col("sub") + F.col("del") + F.col("ins")) / words).alias("error_rate"),
        (F.col("wrong") / F.col("sentences")).alias("sentence_error_rate"),
    )


def _grams(tokens: Column, max_n: int) -> Column:
    """ARRAY<STRUCT<n, gram>> of the n-grams of a token array; tokens are joined by a space."""

    def of(words: Column, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("gram")),
        )

    return let(tokens, lambda words: F.concat(*[of(words, n) for n in range(1, max_n + 1)]))


def gram_matches(df: DataFrame, key: str, ref: Column, hyp: Column, max_n: int) -> DataFrame:
    """(n, matched, ref_total, hyp_total): clipped n-gram matches over the corpus.

    The rows are partitioned by key as they are, before they have tokens.  The n-grams of a key
    with one row are counted in the row; those of the rows of a repeated key are added up first.
    """
    rows = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(key)))
    orders = range(1, max_n + 1)
    names = ("matched", "ref_total", "hyp_total")
    single = rows.where("_rows = 1").select(grams_of_pair(ref, hyp, max_n).alias("_g"))
    sums = single.agg(*[F.sum(F.get("_g", F.lit(3 * (n - 1) + i))).alias(f"{c}{n}") for n in orders for i, c in enumerate(names)])
    counted = sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("n"), *[F.col(f"{c}{n}").alias(c) for c in names]) for n in orders])))
    repeated = _repeated_matches(rows.where("_rows > 1"), key, ref, hyp, max_n)
    whole = counted.unionByName(repeated).groupBy("n").agg(*[F.sum(c).alias(c) for c in names])
    return whole.where((F.col("ref_total") > 0) | (F.col("hyp_total") > 0))


def _repeated_matches(df: DataFrame, key: str, ref: Column, hyp: Column, max_n: int) -> DataFrame:
    """``gram_matches`` of keys with several rows: the n-grams are counted as rows, where they arise."""
    rows = df.select(F.col(key).alias("_key"), ref.alias("_ref"), hyp.alias("_hyp"))
    sides = F.concat(
        F.transform(_grams(F.col("_ref"), max_n), lambda g: F.struct(g["n"].alias("n"), g["gram"].alias("gram"), F.lit(1).alias("r"), F.lit(0).alias("h"))),
        F.transform(_grams(F.col("_hyp"), max_n), lambda g: F.struct(g["n"].alias("n"), g["gram"].alias("gram"), F.lit(0).alias("r"), F.lit(1).alias("h"))),
    )
    counted = (
        rows.select("_key", F.inline(sides))
        .groupBy("_key", "n", "gram")
        .agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    )
    return counted.groupBy("n").agg(
        F.sum(F.least("r", "h")).alias("matched"), F.sum("r").alias("ref_total"), F.sum("h").alias("hyp_total")
    )


def corpus_bleu(df: DataFrame, key: str, ref: Column, hyp: Column, max_n: int = 4, smooth: str = "exp") -> DataFrame:
    """One row: bleu (0..100), brevity penalty, lengths and the n-gram precisions.

    ``exp`` smoothing: the k-th order without a match has the precision 1 / (2^k * its
    n-grams).  ``none``: such an order makes the score 0.  The score is 0 without any match
    or when the hypotheses are shorter than an order.
    """
    if smooth not in ("exp", "none"):
        raise ValueError(f"unknown smoothing: {smooth}")
    orders = range(1, max_n + 1)

    def of(n: int, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("n") == n, F.col(column))), F.lit(0))

    one = gram_matches(df, key, ref, hyp, max_n).agg(
        of(1, "ref_total").alias("ref_len"),
        of(1, "hyp_total").alias("hyp_len"),
        *[of(n, c).alias(f"_{c}{n}") for n in orders for c in ("matched", "hyp_total")],
    )
    for n in orders:
        missed = sum(((F.col(f"_matched{k}") == 0).cast("int") for k in range(2, n + 1)), (F.col("_matched1") == 0).cast("int"))
        share = F.col(f"_matched{n}") / F.col(f"_hyp_total{n}")
        smoothed = 1 / (F.pow(F.lit(2.0), missed) * F.col(f"_hyp_total{n}")) if smooth == "exp" else F.lit(0.0)
        precision = F.when(F.col(f"_hyp_total{n}") == 0, F.lit(0.0)).when(F.col(f"_matched{n}") == 0, smoothed).otherwise(share)
        one = one.withColumn(f"p{n}", precision)
    penalty = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0)).otherwise(
        F.when(F.col("hyp_len") > 0, F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(F.lit(0.0))
    )
    logs = sum((F.log(f"p{n}") for n in range(2, max_n + 1)), F.log("p1"))
    usable = (F.least(*[F.col(f"p{n}") for n in orders]) > 0) & (F.greatest(*[F.col(f"_matched{n}") for n in orders]) > 0)
    scored = one.withColumn("brevity", penalty).withColumn(
        "bleu", F.when(usable, 100 * F.col("brevity") * F.exp(logs / max_n)).otherwise(F.lit(0.0))
    )
    return scored.select("ref_len", "hyp_len", *[f"p{n}" for n in orders], "brevity", "bleu")


def corpus_chrf(df: DataFrame, key: str, ref: Column, hyp: Column, max_n: int = 6, beta: float = 2.0) -> DataFrame:
    """One row: chrf (0..100), the F-score of precision and recall, each averaged over orders.

    White space is left out; an order that neither side reaches is not averaged.
    """

    def chars(text):
        return characters(F.regexp_replace(text, WS, ""))

    matches = gram_matches(df, key, chars(ref), chars(hyp), max_n).where(
        (F.col("ref_total") > 0) & (F.col("hyp_total") > 0)
    )
    means = matches.agg(
        F.coalesce(F.avg(F.col("matched") / F.col("hyp_total")), F.lit(0.0)).alias("p"),
        F.coalesce(F.avg(F.col("matched") / F.col("ref_total")), F.lit(0.0)).alias("r"),
        F.count(F.lit(1)).alias("orders"),
    )
    factor = beta * beta
    score = F.when(F.col("p") + F.col("r") > 0, 100 * (1 + factor) * F.col("p") * F.col("r") / (factor * F.col("p") + F.col("r")))
    return means.select(F.coalesce(score, F.lit(0.0)).alias("chrf"), "orders")


def accuracy(df: DataFrame, group: str, ref: str, hyp: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(ref) == F.col(hyp)).cast("double")).alias("accuracy")
    )


def matthews(df: DataFrame, group: str, ref: str, hyp: str) -> DataFrame:
    """Matthews correlation of 0/1 labels per group; 0 where it is not defined."""
    r, h = F.col(ref) == 1, F.col(hyp) == 1
    cells = df.groupBy(group).agg(
        F.count_if(r & h).cast("double").alias("tp"),
        F.count_if(~r & ~h).cast("double").alias("tn"),
        F.count_if(~r & h).cast("double").alias("fp"),
        F.count_if(r & ~h).cast("double").alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return cells.select(group, F.when(below == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / below).alias("matthews"))


def _average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = total_up_to(counts, [F.col(value)], F.col("_n"), "_upto")
    ranks = upto.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, value)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pearson and spearman (with average ranks of ties)."""
    pearson = df.agg(F.corr(x, y).alias("v")).select(F.lit("pearson").alias("name"), "v")
    ranked = _average_rank(_average_rank(df.select(x, y), x, "_rx"), y, "_ry")
    spearman = ranked.agg(F.corr("_rx", "_ry").alias("v")).select(F.lit("spearman").alias("name"), "v")
    return pearson.unionByName(spearman).agg(
        F.max(F.when(F.col("name") == "pearson", F.col("v"))).alias("pearson"),
        F.max(F.when(F.col("name") == "spearman", F.col("v"))).alias("spearman"),
    )


def macro_average(scores: DataFrame, task: str, score: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Mean over tasks; by default no task is left out."""
    kept = scores.where(~F.col(task).isin(list(exclude))) if exclude else scores
    return kept.agg(F.count(F.lit(1)).alias("tasks"), F.avg(score).alias("average"))


def answer_options(df: DataFrame, group: str, answer: str) -> DataFrame:
    """(<group>, <answer>, words, longest): a row per different answer, its words and those of the longest one of the group."""
    words = F.size(F.split(F.col(answer), f"{WS}+")).cast("bigint")
    options = df.select(group, answer).distinct().withColumn("words", words)
    longest = options.groupBy(group).agg(F.max("words").alias("longest")).withColumnRenamed(group, "_group")
    return options.join(longest, options[group].eqNullSafe(longest["_group"])).select(group, answer, "words", "longest")


def token_accuracy(df: DataFrame, group: str, ref: Column, hyp: Column, ignore: int = -1) -> DataFrame:
    equal, counted = count_equal(ref, hyp, ignore)
    sums = df.select(group, equal.alias("_e"), counted.alias("_c")).groupBy(group).agg(
        F.sum("_e").alias("equal"), F.sum("_c").alias("counted")
    )
    return sums.withColumn("accuracy", F.col("equal") / F.col("counted"))


def confusion(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    return df.groupBy(ref, hyp).agg(F.count(F.lit(1)).alias("n"))


def permutation_score(refs: DataFrame, hyps: DataFrame, weights=REPORT_WEIGHTS) -> DataFrame:
    """Best assignment of hypothesis to reference speakers per utterance.

    ``refs`` (utt, refs) and ``hyps`` (utt, hyps) hold one token array per speaker, any number of them.
    Returns (utt, assignment, errors): ``assignment[i]`` is the hypothesis of reference i, or -1
    where there are fewer hypotheses than references; such a reference counts as lost words.
    Hypotheses that no reference gets do not count.  The table of errors of an utterance
    is solved by shortest augmenting paths, so the plan is the same for any number of speakers.
    """
    joined = refs.join(hyps, "utt")
    pairs = joined.select("utt", F.posexplode("refs").alias("i", "ref"), "hyps").select(
        "utt", "i", "ref", F.posexplode_outer("hyps").alias("j", "hyp")
    )
    scored = with_edit_counts(pairs, F.col("ref"), F.col("hyp"), weights).select(
        "utt", "i", "j", (F.col("sub") + F.col("del") + F.col("ins")).alias("errors"), (F.col("corr") + F.col("sub") + F.col("del")).alias("words")
    )
    # a table has one cell per pair of speakers of an utterance
    by_ref = scored.groupBy("utt", "i").agg(
        F.max("words").alias("words"), F.array_sort(F.collect_list(F.when(F.col("j").isNotNull(), F.struct("j", "errors")))).alias("cells")
    )
    tables = by_ref.groupBy("utt").agg(F.array_sort(F.collect_list(F.struct("i", "words", "cells"))).alias("rows"))
    missing = F.greatest(F.size("rows") - F.size(F.col("rows")[0]["cells"]), F.lit(0))
    costs = F.transform(
        "rows",
        lambda r: F.concat(F.transform(r["cells"], lambda c: c["errors"]), F.array_repeat(r["words"], missing)),
    )
    best = tables.select("utt", F.size(F.col("rows")[0]["cells"]).alias("_n"), best_assignment(costs).alias("_b"))
    place = F.transform("_b.assignment", lambda j: F.when(j < F.col("_n"), j).otherwise(F.lit(-1).cast("bigint")))
    return best.select("utt", place.alias("assignment"), F.col("_b.total").alias("errors"))


def fill_undecoded(expected: DataFrame, hyps: DataFrame, nbest: int) -> DataFrame:
    return fill_failed(expected, hyps, nbest, FAILED_TEXT, SPACE, FAILED_TOKEN_ID, FAILED_SCORE)


def top_hypotheses(hyps: DataFrame, nbest: int) -> DataFrame:
    return hyps.where(F.col("nbest") <= nbest)
