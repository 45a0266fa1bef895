"""Seeded samples, draws and replications.

Every random choice is a slot number computed from (seed, key) and an equi-join on
it; no row ever meets more candidates than it draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import REPEAT_POSTFIX, REPEAT_PREFIX
from ..functions.chance import leading_number, shuffle_key, slot, unit
from .ranking import HOT_ROWS, hash_index, hash_span, pair_span, position_span, rank_in_group, rows_of, total_before


def hours_by_language(df: DataFrame, lang: str, seconds: str) -> DataFrame:
    return df.groupBy(lang).agg((F.sum(seconds) / F.lit(3600.0)).alias("hours"))


def _round_span(round_: Column, digest: Column):
    """Spans of the visiting order (round, digest of the text).

    A round has at most n/round rows, so early rounds are cut by the digest, ever
    more coarsely, and late rounds are taken together in ranges of growing width.
    """

    def span(parts: Column) -> Column:
        early = round_ <= parts
        step = F.floor(parts * F.log2(round_.cast("double"))).cast("bigint")
        inside = F.when(early, F.floor(unit(digest) * F.ceil(parts / round_))).otherwise(F.lit(0))
        return step * F.lit(1 << 21) + F.least(inside.cast("bigint"), F.lit((1 << 21) - 1))

    return span


def budgeted_diverse_sample(
    df: DataFrame,
    group: str,
    text: str,
    cost: str,
    budget: float,
    seed: int,
    key: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows of a text-diverse sample of each group, up to a cost budget.

    Rounds over the distinct texts of a group, texts and rows of a text in seeded
    order, one row of each text per round, until the cost exceeds the budget.  The
    row that crosses the budget is in; a group below the budget is taken whole.
    Costs are added as decimals, so the crossing row does not depend on the order of
    additions.  A row without a cost is an error.  A digest stands for the text as key of
    ranks and order, so texts are moved only if the caller selects them.
    """
    priced = df.withColumn(
        "_cost",
        F.when(F.col(cost).isNull(), F.raise_error(F.concat(F.lit("no cost for "), F.col(key).cast("string"))))
        .otherwise(F.col(cost))
        .cast("decimal(18,6)"),
    )
    keyed = priced.withColumn("_row", shuffle_key(seed, F.col(key))).withColumn(
        "_text", shuffle_key(seed, F.col(text))
    )
    rounds = rank_in_group(
        keyed, [group, "_text"], [F.col("_row"), F.col(key)], "round", hash_span(F.col("_row")), hot_rows
    )
    kept = total_before(
        rounds,
        [group],
        [F.col("round"), F.col("_text")],
        F.col("_cost"),
        _round_span(F.col("round"), F.col("_text")),
        "cost_before",
        hot_rows,
        at_most=F.lit(budget).cast("decimal(28,6)"),
    )
    return kept.withColumn("cost_before", F.col("cost_before").cast("double")).drop("_cost", "_row", "_text")


def seeded_order(df: DataFrame, seed: int, keys: Sequence[str], epoch: int = 0, out: str = "position") -> DataFrame:
    """Position of each row in the shuffle of an epoch."""
    return hash_index(df, seed + epoch, keys, out)


def sample_from_pool(
    df: DataFrame,
    pool: DataFrame,
    key: str,
    pool_key: str,
    probability: float,
    seed: int,
) -> DataFrame:
    """One uniform choice from a pool per row, made with a probability.

    Columns of the pool are null where nothing is applied.  Such rows get negative
    slots, which match nothing, instead of null: nulls would all meet in one task.
    """
    numbered = hash_index(pool, seed, [pool_key], "_slot")
    size = rows_of(pool)
    applies = unit(shuffle_key(seed, F.lit("apply"), F.col(key))) <= F.lit(float(probability))
    nowhere = -1 - leading_number(shuffle_key(seed, F.col(key)))
    drawn = df.withColumn("_slot", F.when(applies, slot(seed, size, F.col(key))).otherwise(nowhere))
    return drawn.join(numbered, "_slot", "left").drop("_slot")


def draw_lines(keys: DataFrame, lines: DataFrame, key: str, seed: int) -> DataFrame:
    """A random line for every key, from (line, value) numbered 0..n-1 without gaps."""
    n = rows_of(lines)
    drawn = keys.withColumn("line", slot(seed, n, F.col(key)))
    return drawn.join(lines.select("line", "value"), "line")


def pick_mixing_sources(
    df: DataFrame, ref_num: int, seed: int, utt: str = "utt", spk: str = "spk", retries: int = 10
) -> DataFrame:
    """(utt, place, picked): ref_num - 1 other utterances of other speakers per utterance.

    Draws are made in order.  A draw of an utterance already taken or of the same
    speaker is a failure; once there are more than ``retries`` failures any draw is
    accepted.  So ``ref_num - 1 + retries`` draws always suffice.  Nearly always the first
    ``ref_num - 1`` do: only utterances that they leave short meet the pool again, with all their draws.
    """
    need = ref_num - 1
    pool = hash_index(df.select(F.col(utt).alias("_p_utt"), F.col(spk).alias("_p_spk")), seed, ["_p_utt"], "_slot")
    size = rows_of(df)
    start = F.struct(F.array(F.col("utt")).alias("taken"), F.lit(0).alias("failed"))

    def step(state, draw):
        good = ~draw["same"] & ~F.array_contains(state["taken"], draw["_p_utt"])
        full = F.size(state["taken"]) > need
        failed = state["failed"] + F.when(full | good, 0).otherwise(1)
        accept = ~full & (good | (failed > retries))
        return F.struct(
            F.when(accept, F.concat(state["taken"], F.array(draw["_p_utt"]))).otherwise(state["taken"]).alias("taken"),
            failed.alias("failed"),
        )

    def drawn(rows: DataFrame, draws: int) -> DataFrame:
        asked = rows.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        met = asked.withColumn("_slot", slot(seed, size, F.col("utt"), F.col("_draw"))).join(pool, "_slot")
        same = (F.col("_p_spk") == F.col("_spk")).alias("same")
        tried = met.groupBy("utt", "_spk").agg(F.array_sort(F.collect_list(F.struct("_draw", "_p_utt", same))).alias("_draws"))
        return tried.select("utt", "_spk", F.aggregate("_draws", start, step, lambda s: F.slice(s["taken"], 2, need)).alias("_taken"))

    first = drawn(df.select(F.col(utt).alias("utt"), F.col(spk).alias("_spk")), need)
    whole = first.where(F.size("_taken") == need)
    if retries:
        short = first.where(F.size("_taken") < need).select("utt", "_spk")
        whole = whole.unionByName(drawn(short, need + retries))
    return whole.select("utt", F.posexplode("_taken").alias("place", "picked")).select(
        "utt", F.col("place").cast("bigint").alias("place"), "picked"
    )


def sample_enrollment(
    df: DataFrame, seed: int, utt: str = "utt", spk: str = "spk", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(utt, spk, enrollment): a random other utterance of the speaker; null if there is none."""
    keyed = df.select(utt, spk).withColumn("_row", shuffle_key(seed, F.col(utt)))
    ranked = rank_in_group(keyed, [spk], [F.col("_row"), F.col(utt)], "_i", hash_span(F.col("_row")), hot_rows).drop("_row")
    sizes = ranked.groupBy(spk).agg(F.count(F.lit(1)).alias("_n"))
    aimed = ranked.join(sizes, spk).withColumn(
        "_partner",
        F.when(
            F.col("_n") > 1,
            F.pmod(F.col("_i") + slot(seed, F.col("_n") - 1, F.lit("enroll"), F.col(utt)), F.col("_n")) + 1,
        ),
    )
    others = ranked.select(spk, F.col("_i").alias("_partner"), F.col(utt).alias("enrollment"))
    return aimed.join(others, [spk, "_partner"], "left").select(utt, spk, "enrollment")


# ---- instruction targets


def text_multiplicity(df: DataFrame, text: Column) -> DataFrame:
    """(text, n) of the stripped texts."""
    return df.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def sample_templates(counts: DataFrame, templates: DataFrame, n_templates: int, per_text: int, seed: int) -> DataFrame:
    """(text, i, prefix, postfix): ``per_text`` draws with replacement per occurrence of a text.

    ``templates`` (pos, prefix, postfix) is numbered 0..n_templates-1.
    """
    draws = counts.select(
        "text", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") * per_text - 1)).alias("i")
    )
    aimed = draws.withColumn("pos", slot(seed, n_templates, F.col("text"), F.col("i")))
    return aimed.join(templates, "pos").select("text", "i", "prefix", "postfix")


def repeat_targets(counts: DataFrame) -> DataFrame:
    """(text, i, prefix, postfix, output): the transcription target, once per occurrence."""
    return counts.select(
        "text",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"),
        F.lit(REPEAT_PREFIX).alias("prefix"),
        F.lit(REPEAT_POSTFIX).alias("postfix"),
        F.col("text").alias("output"),
    )


def shard(df: DataFrame, n: int, key: Column, seed: int = 0, out: str = "shard") -> DataFrame:
    """Shard number 0..n-1 from the key; the last shard number n is for other targets."""
    return df.withColumn(out, slot(seed, n, key))


def deal_targets(
    utts: DataFrame,
    targets: DataFrame,
    utt_order: str,
    target_order: str | tuple[str, str],
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Targets of a text dealt round-robin over the utterances with that text.

    ``utts`` (utt, text, <utt_order>, …) and ``targets`` (text, <target_order>, …): both
    orders are unique whole numbers, that of the targets also two such columns.  The last target is dealt first; target j goes to
    utterance j mod n, whose key gets the suffix of its turn.  Returns (dealt,
    leftover): leftover targets have no utterance with their text.
    """
    # a digest stands for the text as key of ranks and joins, so texts are never compared or sorted
    utts = utts.withColumn("_text", F.md5(F.encode("text", "UTF-8")))
    targets = targets.withColumn("_text", F.md5(F.encode("text", "UTF-8")))
    ranked = rank_in_group(
        utts.drop("text"), ["_text"], [F.col(utt_order)], "_i", position_span(F.col(utt_order), hot_rows), hot_rows
    ).withColumn("_i", F.col("_i") - 1)
    sizes = utts.groupBy("_text").agg(F.count(F.lit(1)).alias("_n"))
    places = [F.col(c) for c in ([target_order] if isinstance(target_order, str) else target_order)]
    span_of = position_span if len(places) == 1 else pair_span
    stacked = rank_in_group(
        targets,
        ["_text"],
        [place.desc() for place in places],
        "_j",
        span_of(*places, hot_rows, descending=True),
        hot_rows,
    )
    aimed = (
        stacked.join(sizes, "_text", "left")
        .withColumn("_j", F.col("_j") - 1)
        .withColumn("_i", F.pmod("_j", "_n"))
    )
    dealt = (
        aimed.where(F.col("_n").isNotNull())
        .join(ranked.drop(utt_order), ["_text", "_i"])
        .withColumn(
            "new_utt", F.concat(F.col("utt"), F.lit("-"), (F.floor(F.col("_j") / F.col("_n")) + 1).cast("string"))
        )
        .drop("_i", "_j", "_n", "_text")
    )
    leftover = aimed.where(F.col("_n").isNull()).drop("_i", "_j", "_n", "_text")
    return dealt, leftover
