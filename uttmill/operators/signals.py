"""Columns of samples: frames, activity, noise, mixtures, normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chance import slot, uniform
from ..functions.let import let
from .sampling import pick_mixing_sources, sample_from_pool
from .vocabulary import feature_stats


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), n.cast("int"))


def energy(samples: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(samples, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def mean_power(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, energy(samples) / F.size(samples))


def frame_table(
    df: DataFrame, samples: str, length: int, shift: int, utt: str = "utt", centered: bool = True, padded: bool = True
) -> DataFrame:
    """(utt, frame, samples): overlapping frames, zero-padded at the edges and at the end.

    A row that is empty or shorter than a frame is an error.
    """
    if length < 1 or shift < 1:
        raise ValueError("frame length and shift must be positive")
    size = F.size(samples)
    wide = F.col(samples).cast("array<double>")
    # a filter, as a projection may be pruned
    short = F.raise_error(F.concat(F.lit("too few samples for a frame: "), F.col(utt).cast("string"))).cast("boolean")
    around = F.concat(_zeros(F.lit(length // 2)), wide, _zeros(F.lit(length // 2))) if centered else wide
    rows = df.where(F.when(size >= length, F.lit(True)).otherwise(short)).select(utt, around.alias("_x"))
    if padded:
        missing = F.pmod(F.pmod(-(F.size("_x") - length), F.lit(shift)), F.lit(length))
        rows = rows.withColumn("_x", F.concat("_x", _zeros(missing)))
    last = F.floor((F.size("_x") - length) / F.lit(shift)).cast("int")
    return rows.select(utt, "_x", F.explode(F.sequence(F.lit(0), last)).alias("_f")).select(
        utt,
        F.col("_f").cast("bigint").alias("frame"),
        F.slice("_x", F.col("_f") * shift + 1, F.lit(length)).alias("samples"),
    )


def frame_powers(samples: Column, length: int, shift: int) -> Column:
    """Mean power of each frame of a row (not centered, zero-padded at the end); null if too short."""
    n = F.size(samples)
    padding = F.pmod(F.pmod(-(n - length), F.lit(shift)), F.lit(length))
    last = F.floor((n + padding - length) / F.lit(shift)).cast("int")
    powers = F.transform(
        F.sequence(F.lit(0), last), lambda f: energy(F.slice(samples, f * shift + 1, F.lit(length))) / length
    )
    return F.when(n >= length, powers)


def active_frames(samples: Column, threshold: float = 0.01, length: int = 1024, shift: int = 512) -> Column:
    """ARRAY<BOOLEAN> per frame, null where every sample counts as active (short or silent rows)."""

    def flags(powers: Column) -> Column:
        mean = F.aggregate(powers, F.lit(0.0).cast("double"), lambda a, p: a + p) / F.size(powers)
        return let(mean, lambda m: F.when(m > 0, F.transform(powers, lambda p: p / m > threshold)))

    return let(frame_powers(samples, length, shift), flags)


def non_silence(df: DataFrame, samples: str, utt: str = "utt", threshold=0.01, length=1024, shift=512) -> DataFrame:
    """(utt, frame, active): a frame is active if its power is above a share of the mean power.

    A row that is too short or all zero has one active frame, which stands for all of it.
    """
    flags = let(
        F.col(samples).cast("array<double>"),
        lambda x: F.coalesce(active_frames(x, threshold, length, shift), F.array(F.lit(True))),
    )
    return df.select(utt, F.posexplode(flags).alias("frame", "active")).withColumn("frame", F.col("frame").cast("bigint"))


def activity_mask(samples: Column, threshold=0.01, length=1024, shift=512) -> Column:
    """ARRAY<BOOLEAN> per sample: each frame covers ``shift`` samples, the last one the rest."""

    def spread(flags: Column) -> Column:
        def at(i: Column) -> Column:
            return F.least(F.floor(i / F.lit(shift)).cast("int"), F.size(flags) - 1)

        return F.transform(samples, lambda x, i: F.coalesce(F.get(flags, at(i)), F.lit(True)))

    return let(active_frames(samples, threshold, length, shift), spread)


def active_power(samples: Column, threshold=0.01, length=1024, shift=512) -> Column:
    """Mean square over the active samples; null if there are none."""

    def power(x: Column) -> Column:
        mask = activity_mask(x, threshold, length, shift)
        kept = F.filter(F.zip_with(x, mask, lambda v, m: F.when(m, v * v)), lambda v: v.isNotNull())
        return let(kept, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0).cast("double"), lambda a, v: a + v) / F.size(k)))

    return let(samples, power)


def fitted_noise(noise: Column, n: Column, offset: Column) -> Column:
    """Noise of n samples: wrapped around from an offset if shorter, cut out at it if longer."""
    m = F.size(noise)
    places = F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
    wrapped = F.transform(places, lambda i: F.get(noise, F.pmod(i - offset, m).cast("int")))
    cut = F.slice(noise, (offset + 1).cast("int"), n.cast("int"))
    return F.when(m < n, wrapped).when(m == n, noise).otherwise(cut)


def add_noise(
    df: DataFrame,
    pool: DataFrame,
    samples: str,
    db_low: float,
    db_high: float,
    probability: float,
    seed: int,
    utt: str = "utt",
    short_share: float = 0.5,
    length: int = 1024,
    shift: int = 512,
) -> DataFrame:
    """Adds noise drawn from ``pool`` (noise_id, noise) at a drawn level.

    Replaces the samples (peak guarded) and adds ``noise_id``, ``noise_db`` and
    ``short_noise``; rows without noise keep their samples.
    """
    drawn = sample_from_pool(df, pool, utt, "noise_id", probability, seed)
    n, m = F.size(samples), F.size("noise")
    offset = slot(seed, F.greatest(F.abs(n - m), F.lit(1)), F.lit("offset"), F.col(utt))
    level = uniform(seed, db_low, db_high, F.lit("db"), F.col(utt))

    def mixed(x: Column) -> Column:
        def at_scale(noise: Column) -> Column:
            ratio = F.sqrt(active_power(x, length=length, shift=shift)) / F.sqrt(
                F.greatest(mean_power(noise), F.lit(1e-10))
            )
            scale = F.pow(F.lit(10.0), -level / 20) * ratio
            return let(scale, lambda k: F.when(k.isNull(), x).otherwise(F.zip_with(x, noise, lambda a, b: a + k * b)))

        fitted = let(offset, lambda o: fitted_noise(F.col("noise").cast("array<double>"), n, o))
        return F.when(m > 0, let(fitted, at_scale)).otherwise(x)

    return (
        drawn.withColumn("noise_db", F.when(m.isNotNull(), level))
        .withColumn("short_noise", F.coalesce(m / n < short_share, F.lit(False)))
        .withColumn(samples, peak_guard(let(F.col(samples).cast("array<double>"), mixed)))
        .drop("noise")
    )


def _with_peak(samples: Column, body) -> Column:
    def of(x: Column) -> Column:
        return let(F.array_max(F.transform(x, lambda v: F.abs(v))), lambda peak: body(x, peak))

    return let(samples, of)


def peak_guard(samples: Column) -> Column:
    """Divided by its peak if that is above 1."""
    return _with_peak(
        samples, lambda x, peak: F.when(peak > 1.0, F.transform(x, lambda v: v / peak)).otherwise(x)
    )


def volume_normalize(samples: Column, volume: float) -> Column:
    return _with_peak(samples, lambda x, peak: F.transform(x, lambda v: v * volume / peak))


def fitted_source(samples: Column, n: Column) -> Column:
    """Cut to n samples, or continued by reflection at its ends."""
    m = F.size(samples)
    period = F.greatest(2 * (m - 1), F.lit(1))
    places = F.sequence(F.lit(0), n - 1)

    def at(i):
        p = F.pmod(i, period)
        return F.get(samples, F.when(p < m, p).otherwise(period - p))

    return F.when(m >= n, F.slice(samples, F.lit(1), n)).otherwise(F.transform(places, at))


def mix_sources(
    df: DataFrame, samples: str, ref_num: int, gain_db: float, seed: int, utt: str = "utt", spk: str = "spk"
) -> DataFrame:
    """(utt, sources, mixture): own and picked sources, each with a drawn gain, and their sum."""
    picks = pick_mixing_sources(df.select(utt, spk), ref_num, seed, utt, spk)
    waves = df.select(F.col(utt).alias("utt"), F.col(samples).cast("array<double>").alias("_x"))
    partners = picks.join(waves.select(F.col("utt").alias("picked"), F.col("_x").alias("_p")), "picked")
    gathered = partners.groupBy("utt").agg(
        F.array_sort(F.collect_list(F.struct("place", "picked", "_p"))).alias("_partners")
    )
    own = waves.join(gathered, "utt").withColumn("_n", F.size("_x"))

    def gained(wave: Column, place: Column) -> Column:
        gain = F.pow(F.lit(10.0), uniform(seed, -gain_db, gain_db, F.lit("gain"), F.col("utt"), place) / 20.0)
        return let(gain, lambda g: let(wave, lambda w: F.transform(w, lambda x: x * g)))

    others = F.transform(
        "_partners", lambda p: gained(fitted_source(p["_p"], F.col("_n")), p["place"] + 1)
    )
    sources = F.concat(F.array(gained(F.col("_x"), F.lit(0).cast("bigint"))), others)
    summed = F.aggregate(
        "sources", _zeros(F.col("_n")), lambda acc, s: F.zip_with(acc, s, lambda a, b: a + b)
    )
    return own.withColumn("sources", sources).select("utt", "sources", summed.alias("mixture"))


def utterance_normalize(samples: Column) -> Column:
    """Zero mean and unit variance over the row; a constant row becomes zeros."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, x: a + x)

    def scaled(x: Column) -> Column:
        deviation = F.greatest(F.sqrt(energy(x) / F.size(x)), F.lit(1e-20))
        return let(deviation, lambda s: F.transform(x, lambda v: v / s))

    def centered(x: Column) -> Column:
        return let(total(x) / F.size(x), lambda mean: let(F.transform(x, lambda v: v - mean), scaled))

    return let(samples, centered)


def global_normalize(df: DataFrame, feature: str) -> DataFrame:
    """Each dimension with the mean and deviation of the whole corpus.

    The statistics have one entry per dimension; they enter the plan as one scalar.
    """
    stats = feature_stats(df, feature)
    mean = F.col("sum") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("sum_sq") / F.col("n") - mean * mean, F.lit(0.0)))
    table = stats.agg(
        F.array_sort(
            F.collect_list(F.struct("dim", mean.alias("mean"), F.greatest(deviation, F.lit(1e-20)).alias("deviation")))
        ).alias("stats")
    )
    wide = df.withColumn("_stats", table.scalar())
    return wide.withColumn(
        feature,
        F.transform(
            F.col(feature).cast("array<double>"),
            lambda x, i: (x - F.get("_stats", i)["mean"]) / F.get("_stats", i)["deviation"],
        ),
    ).drop("_stats")
