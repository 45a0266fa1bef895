"""Sample columns: the embeddings as waveforms of 64 samples, the label as speaker."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttmill.operators import signals, vocabulary

from .registry import digest_sql, query, slot_sql, table, unit_sql

SEED = 11

_WAVES = "wv AS (SELECT 'v'||vec_id AS utt, label::VARCHAR AS spk, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


def _waves(spark, d):
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("utt"),
        F.col("label").cast("string").alias("spk"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def _rows(df, column="x", out="value", extra=()):
    """(utt, i, value) of an array column, rounded."""
    long = df.select("utt", *extra, F.posexplode(column).alias("i", "_v"))
    return long.select("utt", *extra, F.col("i").cast("bigint").alias("i"), F.round("_v", 6).alias(out))


_LONG = "SELECT utt, generate_subscripts(x, 1)::BIGINT - 1 AS i, round(unnest(x), 6) AS value FROM"


@query(
    "a5_feature_stats",
    f"""WITH {_WAVES}, l AS (SELECT generate_subscripts(x, 1)::BIGINT - 1 AS dim, unnest(x) AS v FROM wv)
    SELECT dim, count(*)::BIGINT AS n, round(sum(v), 6) AS sum, round(sum(v * v), 6) AS sum_sq FROM l GROUP BY dim""",
)
def a5(spark, d):
    stats = vocabulary.feature_stats(_waves(spark, d), "x")
    return stats.select("dim", "n", F.round("sum", 6).alias("sum"), F.round("sum_sq", 6).alias("sum_sq"))


# 64 samples, frames of 16 every 8: centered, 80 samples and 9 frames; otherwise 7.
@query(
    "d1_frame_table",
    f"""WITH {_WAVES}, z AS (SELECT list_transform(range(0, 8), lambda i: 0.0::DOUBLE) AS z), c AS (SELECT utt, z || x || z AS x FROM wv, z),
    f AS (SELECT utt, x, unnest(range(0, (len(x) - 16) // 8 + 1)) AS frame FROM c)
    SELECT utt, frame, i, round(x[frame * 8 + i + 1], 6) AS value FROM f, range(0, 16) r(i)""",
)
def d1(spark, d):
    frames = signals.frame_table(_waves(spark, d), "x", 16, 8)
    return _rows(frames, "samples", extra=["frame"])


_FRAMES = f"""{_WAVES}, fp AS (SELECT utt, frame, list_sum(list_transform(x[frame * 8 + 1:frame * 8 + 16], lambda v: v * v)) / 16 AS power
   FROM (SELECT utt, x, unnest(range(0, (len(x) - 16) // 8 + 1)) AS frame FROM wv)),
 fa AS (SELECT utt, frame, power / avg(power) OVER (PARTITION BY utt) > 0.9 AS active FROM fp)"""


@query("d2_non_silence", f"WITH {_FRAMES} SELECT utt, frame, active FROM fa")
def d2(spark, d):
    return signals.non_silence(_waves(spark, d), "x", threshold=0.9, length=16, shift=8)


_POWER = f"""{_FRAMES}, sm AS (SELECT utt, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM wv),
 ap AS (SELECT sm.utt, avg(v * v) AS power FROM sm JOIN fa ON fa.utt = sm.utt AND fa.frame = least(i // 8, 6) WHERE active GROUP BY sm.utt)"""


@query("d3_active_power", f"WITH {_POWER} SELECT utt, round(power, 6) AS power FROM ap")
def d3(spark, d):
    power = signals.active_power(F.col("x"), 0.9, 16, 8)
    return _waves(spark, d).select("utt", F.round(power, 6).alias("power"))


# Waves are vectors three times over, noises vectors once or five times, so that both wrapping and cropping occur.
_THRICE = _FRAMES.replace("> 0.9", "> 0.01").replace(
    "list_transform(embedding, lambda x: x::DOUBLE) AS x", "list_transform(embedding || embedding || embedding, lambda x: x::DOUBLE) AS x"
)
_NOISY = f"""{_THRICE}, sm AS (SELECT utt, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM wv),
 ap AS (SELECT sm.utt, avg(v * v) AS power FROM sm JOIN fa ON fa.utt = sm.utt AND fa.frame = least(i // 8, 22) WHERE active GROUP BY sm.utt),
 po AS (SELECT vec_id AS noise_id, CASE WHEN vec_id % 2 = 0 THEN e ELSE e || e || e || e || e END AS noise, row_number() OVER (ORDER BY {digest_sql(SEED, 'vec_id')}) - 1 AS slot
   FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
 dr AS (SELECT utt, x, CASE WHEN {unit_sql(SEED, "'apply'", 'utt')} <= 0.8 THEN {slot_sql(SEED, '(SELECT count(*) FROM po)', 'utt')} END AS slot,
   -3 + 7 * {unit_sql(SEED, "'db'", 'utt')} AS db FROM wv),
 of AS (SELECT dr.*, noise_id, noise, {slot_sql(SEED, 'greatest(abs(len(x) - len(noise)), 1)', "'offset'", 'utt')} AS o FROM dr LEFT JOIN po USING (slot)),
 fi AS (SELECT *, CASE WHEN len(noise) < len(x) THEN list_transform(range(0, len(x)), lambda i: noise[((i - o) % len(noise) + len(noise)) % len(noise) + 1])
   ELSE noise[o + 1:o + len(x)] END AS fit FROM of),
 sc AS (SELECT fi.*, pow(10, -db / 20) * sqrt(power) / sqrt(greatest(list_sum(list_transform(fit, lambda v: v * v)) / len(fit), 1e-10)) AS scale FROM fi JOIN ap ON ap.utt = fi.utt),
 mx AS (SELECT utt, noise_id, CASE WHEN noise_id IS NULL THEN x ELSE list_transform(range(1, len(x) + 1), lambda i: x[i] + scale * fit[i]) END AS x,
   coalesce(len(noise) / len(x) < 0.7, false) AS short_noise FROM sc),
 pk AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM mx)"""


@query(
    "d4_add_noise",
    f"""WITH {_NOISY} SELECT utt, noise_id, short_noise, generate_subscripts(x, 1)::BIGINT - 1 AS i, round(CASE WHEN peak > 1 THEN unnest(x) / peak ELSE unnest(x) END, 6) AS value FROM pk""",
)
def d4(spark, d):
    whole = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    pool = whole.select(
        F.col("vec_id").alias("noise_id"),
        F.when(F.col("vec_id") % 2 == 0, F.col("e")).otherwise(F.concat("e", "e", "e", "e", "e")).alias("noise"),
    )
    waves = _waves(spark, d).withColumn("x", F.concat("x", "x", "x"))
    noisy = signals.add_noise(waves, pool, "x", -3.0, 4.0, 0.8, SEED, short_share=0.7, length=16, shift=8)
    return _rows(noisy, extra=["noise_id", "short_noise"])


@query(
    "d5_peak_guard",
    f"""WITH {_WAVES}, l AS (SELECT utt, x, list_max(list_transform(x, lambda v: abs(v * 4))) AS peak FROM wv)
    SELECT utt, generate_subscripts(x, 1)::BIGINT - 1 AS i, round(unnest(x) * 4 / greatest(peak, 1), 6) AS value FROM l""",
)
def d5_guard(spark, d):
    loud = _waves(spark, d).withColumn("x", F.transform("x", lambda v: v * 4))
    return _rows(loud.withColumn("x", signals.peak_guard(F.col("x"))))


@query(
    "d5_volume_normalize",
    f"""WITH {_WAVES}, l AS (SELECT utt, x, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM wv)
    SELECT utt, generate_subscripts(x, 1)::BIGINT - 1 AS i, round(unnest(x) * 0.5 / peak, 6) AS value FROM l""",
)
def d5(spark, d):
    return _rows(_waves(spark, d).withColumn("x", signals.volume_normalize(F.col("x"), 0.5)))


# Waves of odd vectors are doubled, so that both cutting and reflection occur.
_MIXED = f"""{_WAVES}, cu AS (SELECT utt, spk, CASE WHEN substr(utt, 2)::BIGINT % 2 = 1 THEN x || x ELSE x END AS x FROM wv),
 po AS (SELECT utt AS picked, spk AS p_spk, x AS px, row_number() OVER (ORDER BY {digest_sql(SEED, 'utt')}) - 1 AS slot FROM cu),
 dr AS (SELECT utt, spk, x, k, {slot_sql(SEED, '(SELECT count(*) FROM po)', 'utt', 'k')} AS slot FROM cu, range(1, 12) r(k)),
 dg AS (SELECT dr.*, picked, px, (picked <> utt AND p_spk <> spk) AS good FROM dr JOIN po USING (slot)),
 ch AS (SELECT utt, any_value(x) AS x, coalesce(arg_min(px, k) FILTER (good), arg_max(px, k)) AS px FROM dg GROUP BY utt),
 ft AS (SELECT utt, x, list_transform(range(0, len(x)), lambda i: px[CASE WHEN i % (2 * (len(px) - 1)) < len(px) THEN i % (2 * (len(px) - 1)) ELSE 2 * (len(px) - 1) - i % (2 * (len(px) - 1)) END + 1]) AS px,
   pow(10, (-6 + 12 * {unit_sql(SEED, "'gain'", 'utt', '0')}) / 20) AS g0, pow(10, (-6 + 12 * {unit_sql(SEED, "'gain'", 'utt', '1')}) / 20) AS g1 FROM ch)"""


@query("d6_mix_sources", f"WITH {_MIXED} SELECT utt, i, round(g0 * x[i + 1] + g1 * px[i + 1], 6) AS value FROM (SELECT *, unnest(range(0, len(x))) AS i FROM ft)")
def d6(spark, d):
    odd = F.substring("utt", 2, 20).cast("bigint") % 2 == 1
    cut = _waves(spark, d).withColumn("x", F.when(odd, F.concat("x", "x")).otherwise(F.col("x")))
    return _rows(signals.mix_sources(cut, "x", 2, 6.0, SEED), "mixture")


@query(
    "d7_utterance_normalize",
    f"""WITH {_WAVES}, l AS (SELECT utt, x, list_avg(x) AS mean FROM wv), s AS (SELECT *, sqrt(list_avg(list_transform(x, lambda v: (v - mean) * (v - mean)))) AS sd FROM l)
    SELECT utt, generate_subscripts(x, 1)::BIGINT - 1 AS i, round((unnest(x) - mean) / sd, 6) AS value FROM s""",
)
def d7(spark, d):
    return _rows(_waves(spark, d).withColumn("x", signals.utterance_normalize(F.col("x"))))


@query(
    "d7_global_normalize",
    f"""WITH {_WAVES}, l AS (SELECT utt, generate_subscripts(x, 1)::BIGINT - 1 AS i, unnest(x) AS v FROM wv),
    s AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS sd FROM l GROUP BY i) SELECT utt, i, round((v - mean) / sd, 6) AS value FROM l JOIN s USING (i)""",
)
def d7_global(spark, d):
    return _rows(signals.global_normalize(_waves(spark, d), "x"))
