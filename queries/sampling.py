"""Samples, draws, instruction targets and dealing."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttmill.functions.text import json_quote, json_unquote, squash, strip, tokenize, valid_target
from uttmill.operators import ranking, sampling, vocabulary
from uttmill.plans import corpora
from uttmill.session import scratch_path

from .registry import (
    CLIPS,
    MANIFEST,
    TEMPLATES,
    clips,
    digest_sql,
    manifest,
    query,
    slot_sql,
    squash_sql,
    strip_sql,
    table,
    templates,
    unit_sql,
    words_sql,
)

SEED = 7
BUDGET = 50000


_SAMPLE = f"""WITH {CLIPS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY {digest_sql(SEED, 'clip')}, clip) AS round FROM c),
    o AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY lang ORDER BY round, {digest_sql(SEED, 'text')}, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cost_before FROM r)
    SELECT clip, lang, round::BIGINT AS round, cost, cost_before FROM o WHERE cost_before <= {BUDGET}"""


def _sample(spark, d, **kwargs):
    sample = sampling.budgeted_diverse_sample(clips(spark, d), "lang", "text", "cost", BUDGET, SEED, "clip", **kwargs)
    return sample.select("clip", "lang", "round", "cost", "cost_before")


@query("s1_budgeted_diverse_sample", _SAMPLE)
def s1(spark, d):
    return _sample(spark, d)


# groups from 100 rows on count as hot: the languages are cut into spans
@query("s1_hot_groups", _SAMPLE)
def s1_hot(spark, d):
    return _sample(spark, d, hot_rows=100)


@query(
    "subsample_clips",
    f"""WITH {CLIPS}, q AS (SELECT regexp_replace(clip, '[.][^.]*$', '') AS utt, clip, lang, {squash_sql('text')} AS text, cost / 8.0::DOUBLE AS seconds FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY {digest_sql(SEED, 'clip')}, clip) AS round FROM q),
    o AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY lang ORDER BY round, {digest_sql(SEED, 'text')}, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM r)
    SELECT utt FROM o WHERE before <= 2 * 3600""",
)
def subsample(spark, d):
    durations, folder, out = (scratch_path(spark, f"subsample-{n}") for n in ("durations", "clips", "list"))
    rows = clips(spark, d)
    rows.select("clip", (F.col("cost") / 8).alias("seconds")).write.option("sep", "\t").csv(durations)
    # an absent speaker or text is an empty column
    spk, text = (F.coalesce(c, F.lit("")) for c in (F.col("spk"), squash(F.col("text"))))
    lines = rows.select("lang", F.concat_ws("\t", spk, "clip", text).alias("value"))
    lines.write.partitionBy("lang").text(folder)
    return corpora.subsample_clips(spark, durations, folder, out, 2.0, SEED, "*.txt")


@query(
    "w1_seeded_order",
    f"WITH {MANIFEST} SELECT utt, (row_number() OVER (ORDER BY {digest_sql(SEED + 3, 'utt')}) - 1)::BIGINT AS position FROM m",
)
def w1(spark, d):
    return sampling.seeded_order(manifest(spark, d).select("utt"), SEED, ["utt"], epoch=3)


@query("a1_hours_by_language", f"WITH {CLIPS} SELECT lang, round(sum(cost)::DOUBLE / 3600.0, 6) AS hours FROM c GROUP BY lang")
def a1(spark, d):
    return sampling.hours_by_language(clips(spark, d), "lang", "cost").withColumn("hours", F.round("hours", 6))


_COUNTS = f"k AS (SELECT {strip_sql('text')} AS text, count(*)::BIGINT AS n FROM documents GROUP BY 1)"


def _counts(spark, d):
    return sampling.text_multiplicity(table(spark, d, "documents"), strip(F.col("text")))


@query("a2_text_multiplicity", f"WITH {_COUNTS} SELECT text, n FROM k")
def a2(spark, d):
    return _counts(spark, d)


_NUMBERED = f"{TEMPLATES}, nt AS (SELECT (row_number() OVER (ORDER BY pos) - 1)::BIGINT AS pos, prefix, postfix FROM t)"
_DRAWS = f"""{_COUNTS}, {_NUMBERED}, dr AS (SELECT text, i, {slot_sql(SEED, '(SELECT count(*) FROM nt)', 'text', 'i')} AS pos
  FROM (SELECT text, unnest(range(0, 2 * n)) AS i FROM k)), t1 AS (SELECT text, i, prefix, postfix FROM dr JOIN nt USING (pos))"""


def _draws(spark, d):
    listed = ranking.dense_index(templates(spark, d), [F.col("pos")], "place")
    numbered = listed.select(F.col("place").alias("pos"), "prefix", "postfix")
    return sampling.sample_templates(_counts(spark, d), numbered, numbered.count(), 2, SEED)


@query("t1_sample_templates", f"WITH {_DRAWS} SELECT text, i, prefix, postfix FROM t1")
def t1(spark, d):
    return _draws(spark, d)


@query(
    "t2_repeat_targets",
    f"WITH {_COUNTS} SELECT text, unnest(range(0, n)) AS i, 'Repeat the sentence: ' AS prefix, '. ' AS postfix, text AS output FROM k",
)
def t2(spark, d):
    return sampling.repeat_targets(_counts(spark, d))


@query("t4_shard", f"WITH {MANIFEST} SELECT utt, {slot_sql(0, 61, 'text')}::BIGINT AS shard FROM m")
def t4(spark, d):
    return sampling.shard(manifest(spark, d), 61, F.col("text")).select("utt", "shard")


# Generated rows: the drawn prompts with an output, empty for every seventh, as JSON literals.
_GENERATED = f"""{_DRAWS}, ge AS (SELECT text, prefix, postfix, CASE WHEN i % 7 = 0 THEN '' ELSE lower(text) END AS output,
  (row_number() OVER (ORDER BY text, i) - 1)::BIGINT AS line FROM t1)"""


def _generated(spark, d):
    rows = ranking.dense_index(_draws(spark, d), [F.col("text"), F.col("i")], "line")
    output = F.when(F.col("i") % 7 == 0, F.lit("")).otherwise(F.lower("text"))
    return rows.select(
        F.lit(0).cast("bigint").alias("shard"),
        "line",
        "text",
        *[json_quote(c).alias(n) for n, c in (("prefix", F.col("prefix")), ("postfix", F.col("postfix")), ("output", output))],
    )


@query("f8_json_quote", f"WITH {_GENERATED} SELECT line, to_json(output)::VARCHAR AS quoted, output AS unquoted FROM ge")
def f8(spark, d):
    return _generated(spark, d).select("line", F.col("output").alias("quoted"), json_unquote(F.col("output")).alias("unquoted"))


@query(
    "f9_valid_target",
    f"WITH {_GENERATED} SELECT line FROM ge WHERE len({words_sql('output')}) > 0 AND (len({words_sql('prefix')}) > 0 OR len({words_sql('postfix')}) > 0)",
)
def f9(spark, d):
    tokens = [tokenize(json_unquote(F.col(c)), "word") for c in ("prefix", "postfix", "output")]
    return _generated(spark, d).where(valid_target(*tokens)).select("line")


_UTTS = f"{MANIFEST}, u AS (SELECT utt, {strip_sql('text')} AS text, doc_id, spk FROM m)"


def _utts(spark, d):
    return manifest(spark, d).select("utt", strip(F.col("text")).alias("text"), "doc_id", "spk")


_DEAL = f"""ru AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY text) AS n FROM u),
 rt AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY line DESC) - 1 AS j FROM ge WHERE output <> ''),
 dealt AS (SELECT ru.utt||'-'||(j // n + 1) AS new_utt, rt.prefix, rt.postfix, rt.output, ru.spk, rt.line FROM ru JOIN rt ON ru.text = rt.text AND rt.j % ru.n = ru.i)"""


_DEALT = f"WITH {_GENERATED}, {_UTTS}, {_DEAL} SELECT new_utt, prefix, postfix, output, spk, line FROM dealt"


def _targets(spark, d):
    targets = _generated(spark, d).select(
        "line", "text", *[json_unquote(F.col(c)).alias(c) for c in ("prefix", "postfix", "output")]
    )
    return targets.where("output <> ''").withColumn("at", F.col("line"))


def _dealt(spark, d, **kwargs):
    dealt, _ = sampling.deal_targets(_utts(spark, d), _targets(spark, d), "doc_id", "at", **kwargs)
    return dealt.select("new_utt", "prefix", "postfix", "output", "spk", "line")


@query("j7_deal_targets", _DEALT)
def j7(spark, d):
    return _dealt(spark, d)


# texts with more than one row count as hot
@query("j7_hot_texts", _DEALT)
def j7_hot(spark, d):
    return _dealt(spark, d, hot_rows=1)


@query(
    "j7_leftover_targets",
    f"""WITH {_GENERATED}, {_UTTS}, lt AS (SELECT line, output, CASE WHEN line % 5 = 0 THEN text || ' ' || line ELSE text END AS text FROM ge WHERE output <> '')
    SELECT line, text, output FROM lt WHERE text NOT IN (SELECT text FROM u)""",
)
def j7_leftover(spark, d):
    # every fifth target is for a text that nobody says
    lost = F.concat_ws(" ", "text", F.col("line").cast("string"))
    targets = _targets(spark, d).withColumn("text", F.when(F.col("line") % 5 == 0, lost).otherwise(F.col("text")))
    _, leftover = sampling.deal_targets(_utts(spark, d), targets, "doc_id", "at")
    return leftover.select("line", "text", "output")


_VOCAB = f"""wc AS (SELECT w AS token, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS w FROM documents) GROUP BY 1),
 vo AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM wc)"""


def _ids_sql(column):
    return f"""(SELECT coalesce(string_agg(coalesce(vo.id, 1)::VARCHAR, ' ' ORDER BY k), '') FROM
      (SELECT unnest({words_sql(column)}) AS w, generate_subscripts({words_sql(column)}, 1) AS k) x LEFT JOIN vo ON vo.token = x.w)"""


@query(
    "t5_build_instruction_set",
    f"""WITH {_GENERATED}, {_UTTS}, {_DEAL}, {_VOCAB} SELECT new_utt, spk, {_ids_sql('prefix')} AS prefix, {_ids_sql('postfix')} AS postfix,
      {_ids_sql('output')} AS output FROM dealt""",
)
def t5(spark, d):
    vocab = vocabulary.build_vocab(table(spark, d, "documents"), tokenize(F.col("text"), "word"))
    dealt, _ = corpora.build_instruction_set(_generated(spark, d), _utts(spark, d), vocab, "doc_id")
    ids = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("prefix", "postfix", "output")]
    return dealt.select("new_utt", "spk", *ids)


# ---- draws from a pool


_POOL = f"po AS (SELECT item_id AS noise_id, text AS noise, row_number() OVER (ORDER BY {digest_sql(SEED, 'item_id')}) - 1 AS slot FROM benchmark)"


@query(
    "j6_sample_from_pool",
    f"""WITH {MANIFEST}, {_POOL}, w AS (SELECT utt, CASE WHEN {unit_sql(SEED, "'apply'", 'utt')} <= 0.6
      THEN {slot_sql(SEED, '(SELECT count(*) FROM po)', 'utt')} END AS slot FROM m)
    SELECT utt, noise_id, noise FROM w LEFT JOIN po USING (slot)""",
)
def j6(spark, d):
    pool = table(spark, d, "benchmark").select(F.col("item_id").alias("noise_id"), F.col("text").alias("noise"))
    return sampling.sample_from_pool(manifest(spark, d).select("utt"), pool, "utt", "noise_id", 0.6, SEED)


@query(
    "t8_draw_lines",
    f"""WITH {MANIFEST}, l AS (SELECT text AS value, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents),
    w AS (SELECT utt, {slot_sql(SEED, '(SELECT count(*) FROM l)', 'utt')} AS line FROM m)
    SELECT utt, line::BIGINT AS line, value FROM w JOIN l USING (line)""",
)
def t8(spark, d):
    lines = ranking.dense_index(table(spark, d, "documents").select("doc_id", "text"), [F.col("doc_id")], "line")
    numbered = lines.select("line", F.col("text").alias("value"))
    return sampling.draw_lines(manifest(spark, d).select("utt"), numbered, "utt", SEED).select("utt", "line", "value")


@query(
    "j11_pick_mixing_sources",
    f"""WITH {MANIFEST}, po AS (SELECT utt AS picked, spk AS p_spk, row_number() OVER (ORDER BY {digest_sql(SEED, 'utt')}) - 1 AS slot FROM m),
    dr AS (SELECT utt, spk, k, {slot_sql(SEED, '(SELECT count(*) FROM po)', 'utt', 'k')} AS slot FROM m, range(1, 12) r(k)),
    x AS (SELECT dr.*, picked, (picked <> utt AND p_spk <> spk) AS good FROM dr JOIN po USING (slot))
    SELECT utt, 0::BIGINT AS place, coalesce(arg_min(picked, k) FILTER (good), arg_max(picked, k)) AS picked FROM x GROUP BY utt""",
)
def j11(spark, d):
    return sampling.pick_mixing_sources(manifest(spark, d).select("utt", "spk"), 2, SEED)


@query(
    "j12_sample_enrollment",
    f"""WITH {MANIFEST}, r AS (SELECT utt, spk, row_number() OVER (PARTITION BY spk ORDER BY {digest_sql(SEED, 'utt')}) AS i,
      count(*) OVER (PARTITION BY spk) AS n FROM m),
    a AS (SELECT utt, spk, CASE WHEN n > 1 THEN (i + {slot_sql(SEED, 'greatest(n - 1, 1)', "'enroll'", 'utt')}) % n + 1 END AS partner FROM r)
    SELECT a.utt, a.spk, r.utt AS enrollment FROM a LEFT JOIN r ON r.spk = a.spk AND r.i = a.partner""",
)
def j12(spark, d):
    return sampling.sample_enrollment(manifest(spark, d), SEED)
