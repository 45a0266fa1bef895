"""Score sheets (syllables with notes and phones) against timed labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import PHONE_CUTS, SLUR


def score_label_align(sheets: DataFrame, labels: DataFrame, rate: int, hop: int) -> DataFrame:
    """(utt, index, phone, note, duration_phn, duration_ruled_phn, duration_syb, slur, phn_count).

    ``sheets`` (utt, syllables ARRAY<STRUCT<st, et, syllable, note, phones>>) and
    ``labels`` (utt, labels ARRAY<STRUCT<start, end, phone>>).  The phones of a sheet, in
    order, must be the phones of the labels; anything else is an error.
    """
    shift = F.lit(hop / rate)
    cuts = F.create_map(*[x for n, c in PHONE_CUTS.items() for x in (F.lit(n), F.array(*[F.lit(v) for v in c]))])

    def frames(seconds):
        return F.floor(seconds / shift + 0.5).cast("bigint")

    # sheet and labels of one utterance are arrays of one row, so phones are matched by place
    syllables = F.transform(
        "syllables",
        lambda s: F.transform(
            F.split(s["phones"], "_"),
            lambda p, k: F.struct(
                p.alias("phone"),
                k.alias("k"),
                F.size(F.split(s["phones"], "_")).alias("n"),
                (s["et"] - s["st"]).alias("dur"),
                s["note"].alias("note"),
                (s["syllable"] == SLUR).alias("slur"),
            ),
        ),
    )
    joined = sheets.join(labels, "utt", "full_outer").select("utt", F.flatten(syllables).alias("_p"), "labels")
    mismatch = F.raise_error(F.concat(F.lit("score and labels differ: "), F.col("utt")))
    same = F.transform("_p", lambda p: p["phone"]) == F.transform("labels", lambda x: x["phone"])
    matched = joined.select(
        "utt", F.when(F.coalesce(same, F.lit(False)), F.arrays_zip("_p", "labels")).otherwise(mismatch).alias("_z")
    )
    rows = matched.select("utt", F.posexplode("_z").alias("index", "z")).select("utt", "index", "z._p.*", "z.labels.start", "z.labels.end")
    upto = F.get(F.element_at(cuts, F.col("n")), F.col("k"))
    before = F.when(F.col("k") > 0, F.get(F.element_at(cuts, F.col("n")), F.col("k") - 1)).otherwise(F.lit(0.0))
    return rows.select(
        "utt",
        F.col("index").cast("bigint").alias("index"),
        "phone",
        "note",
        frames(F.col("end").cast("double") - F.col("start").cast("double")).alias("duration_phn"),
        F.floor((upto - before) * F.col("dur") / shift + 0.5).cast("bigint").alias("duration_ruled_phn"),
        frames(F.col("dur")).alias("duration_syb"),
        F.col("slur").cast("bigint").alias("slur"),
        F.col("n").cast("bigint").alias("phn_count"),
    )
