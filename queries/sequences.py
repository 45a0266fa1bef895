"""Splits, batches, chunks, padding, training sequences and score sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttmill.functions.sequences import add_eos, add_sos, repeat_label
from uttmill.functions.text import characters
from uttmill.operators import batching, scores

from .registry import MANIFEST, chars_sql, digest_sql, manifest, query, slot_sql, table


@query("b1_split_keys", f"WITH {MANIFEST} SELECT utt, ((row_number() OVER (ORDER BY utt) - 1) * 32 // count(*) OVER ())::BIGINT AS split FROM m")
def b1(spark, d):
    return batching.split_keys(manifest(spark, d).select("utt"), 32)


@query(
    "b2_split_manifests",
    f"""WITH {MANIFEST}, s AS (SELECT utt, text, spk, ((row_number() OVER (ORDER BY utt) - 1) * 7 // count(*) OVER ())::BIGINT AS split FROM m)
    SELECT utt, text, spk, split, ((100 + split) // 7)::BIGINT AS split_iterations FROM s""",
)
def b2(spark, d):
    return batching.split_manifests(manifest(spark, d).select("utt", "text", "spk"), 7, 100)


@query("b3_batch_fixed", f"WITH {MANIFEST} SELECT utt, samples, ((row_number() OVER (ORDER BY samples DESC, utt) - 1) // 20)::BIGINT AS batch FROM m")
def b3(spark, d):
    return batching.batch_fixed(manifest(spark, d).select("utt", "samples"), 20, [F.col("samples").desc(), F.col("utt")])


_STEPS = f"""{MANIFEST}, st AS (SELECT *, greatest(length(bin(samples)) - 5, 0) AS dr FROM m),
 sp AS (SELECT *, dr * 32 + (samples >> dr::BIGINT) AS step, (samples >> dr::BIGINT) << dr::BIGINT AS length_class FROM st)"""


def _batch_sql(classes, capacity, extra=""):
    return f"""WITH {_STEPS}, fo AS (SELECT *, samples // 2000000 AS fold FROM sp),
    rk AS (SELECT *, row_number() OVER (PARTITION BY {classes} ORDER BY step, {digest_sql(0, 'utt')}, utt) - 1 AS i, max(samples) OVER (PARTITION BY {classes}) AS longest FROM fo)
    SELECT utt, samples, {classes}, (i // greatest(1, {capacity}))::BIGINT AS batch FROM rk"""


@query("b4_batch_folded", _batch_sql("fold", "20 // (fold + 1)"))
def b4(spark, d):
    rows = manifest(spark, d).select("utt", "samples")
    return batching.batch_folded(rows, 20, [F.col("samples")], [2000000]).select("utt", "samples", "fold", "batch")


@query("b5_batch_by_bins", _batch_sql("length_class", "60000000 // longest"))
def b5(spark, d):
    rows = manifest(spark, d).select("utt", "samples")
    return batching.batch_by_bins(rows, 60000000, F.col("samples")).select("utt", "samples", "length_class", "batch")


# length classes with more than 20 rows count as hot
@query("b5_hot_classes", _batch_sql("length_class", "60000000 // longest"))
def b5_hot(spark, d):
    rows = manifest(spark, d).select("utt", "samples")
    return batching.batch_by_bins(rows, 60000000, F.col("samples"), hot_rows=20).select("utt", "samples", "length_class", "batch")


@query("b7_batch_by_category", _batch_sql("lang, length_class", "60000000 // longest"))
def b7(spark, d):
    rows = manifest(spark, d).select("utt", "samples", "lang")
    batches = batching.batch_by_bins(rows, 60000000, F.col("samples"), category=["lang"])
    return batches.select("utt", "samples", "lang", "length_class", "batch")


def _loop_sql(order, fits):
    """A loop over the sorted rows, one step each: (i, batch, held, first) of the open batch."""
    return f"""WITH RECURSIVE {MANIFEST}, so AS (SELECT utt, samples, samples // 2000000 AS fold, row_number() OVER (ORDER BY {order}, {digest_sql(0, 'utt')}) AS i FROM m),
    lo AS (SELECT 1::BIGINT AS i, 0::BIGINT AS batch, 1::BIGINT AS held, (SELECT fold FROM so WHERE i = 1) AS first
      UNION ALL SELECT so.i, CASE WHEN {fits} THEN batch ELSE batch + 1 END, CASE WHEN {fits} THEN held + 1 ELSE 1 END, CASE WHEN {fits} THEN first ELSE fold END
      FROM lo JOIN so ON so.i = lo.i + 1)"""


_GREEDY = _loop_sql("least(samples, 60000001)", "(held + 1) * samples <= 60000000")


def _greedy(spark, d):
    return batching.greedy_batches(manifest(spark, d).select("utt", "samples"), 60000000, F.col("samples"))


@query("b5_greedy_batches", f"{_GREEDY} SELECT utt, samples, batch FROM lo JOIN so USING (i)")
def b5_greedy(spark, d):
    return _greedy(spark, d).select("utt", "samples", "batch")


@query("b4_greedy_folded", f"{_loop_sql('fold DESC', 'held < greatest(1, 20 // (first + 1))')} SELECT utt, samples, fold, batch FROM lo JOIN so USING (i)")
def b4_greedy(spark, d):
    rows = manifest(spark, d).select("utt", "samples")
    return batching.greedy_folded(rows, 20, [F.col("samples")], [2000000]).select("utt", "samples", "fold", "batch")


@query(
    "b5_batch_fill",
    f"""{_GREEDY}, {_STEPS.removeprefix(f"{MANIFEST}, ")}, rk AS (SELECT *, row_number() OVER (PARTITION BY length_class ORDER BY step, {digest_sql(0, 'utt')}, utt) - 1 AS i, max(samples) OVER (PARTITION BY length_class) AS longest FROM sp),
    ba AS (SELECT 'greedy' AS method, samples, 0::BIGINT AS class, batch FROM lo JOIN so USING (i)
      UNION ALL SELECT 'classes', samples, length_class, (i // greatest(1, 60000000 // longest))::BIGINT FROM rk),
    sz AS (SELECT method, count(*) AS n, max(samples) AS longest, sum(samples) AS used FROM ba GROUP BY method, class, batch)
    SELECT method, count(*)::BIGINT AS batches, sum(n)::BIGINT AS rows, round(avg(n * longest / 60000000.0::DOUBLE), 6) AS fill, round(1 - sum(used)::DOUBLE / sum(n * longest), 6) AS padding FROM sz GROUP BY method""",
)
def b5_fill(spark, d):
    classes = batching.batch_by_bins(manifest(spark, d).select("utt", "samples"), 60000000, F.col("samples"))
    made = [("greedy", _greedy(spark, d), ["batch"]), ("classes", classes, ["length_class", "batch"])]
    rows = [batching.batch_fill(df, batch, F.col("samples"), 60000000).withColumn("method", F.lit(name)) for name, df, batch in made]
    return rows[0].unionByName(rows[1]).select(
        "method", "batches", "rows", F.round("fill", 6).alias("fill"), F.round("padding", 6).alias("padding")
    )


# Batches of 20 along the length.
_FIXED = f"{MANIFEST}, bf AS (SELECT utt, samples, ((row_number() OVER (ORDER BY samples DESC, utt) - 1) // 20)::BIGINT AS batch FROM m)"
_PLACED = f"""{_FIXED}, hd AS (SELECT batch, row_number() OVER (ORDER BY max(samples), min(utt)) - 1 AS batch_place FROM bf GROUP BY batch),
 pl AS (SELECT utt, samples, batch, (row_number() OVER (PARTITION BY batch ORDER BY samples DESC, utt) - 1)::BIGINT AS place, batch_place::BIGINT AS batch_place FROM bf JOIN hd USING (batch))"""


def _placed(spark, d):
    fixed = batching.batch_fixed(manifest(spark, d).select("utt", "samples"), 20, [F.col("samples").desc(), F.col("utt")])
    return batching.order_batches(fixed, ["batch"], "samples", sort_in_batch="descending", sort_batch="ascending")


@query("b6_order_batches", f"WITH {_PLACED} SELECT * FROM pl")
def b6(spark, d):
    return _placed(spark, d).select("utt", "samples", "batch", "place", "batch_place")


@query(
    "a17_batch_summary",
    f"""{_batch_sql('length_class', '60000000 // longest').replace('SELECT utt, samples, length_class,', ', ba AS (SELECT length_class,', 1)}),
    sz AS (SELECT count(*) AS n FROM ba GROUP BY length_class, batch) SELECT count(*)::BIGINT AS batches, round(avg(n), 6) AS mean, min(n)::BIGINT AS min, max(n)::BIGINT AS max FROM sz""",
)
def a17(spark, d):
    rows = manifest(spark, d).select("utt", "samples")
    batches = batching.batch_by_bins(rows, 60000000, F.col("samples"))
    return batching.batch_summary(batches, ["length_class", "batch"]).withColumn("mean", F.round("mean", 6))


@query("b8_rank_slice", f"WITH {_PLACED} SELECT utt, batch, place, place % 4 AS rank FROM pl")
def b8(spark, d):
    return batching.rank_slice(_placed(spark, d), ["batch"], "place", 4).select("utt", "batch", "place", "rank")


@query(
    "b9_epoch_slice",
    f"""WITH {_FIXED}, bt AS (SELECT DISTINCT batch FROM bf), n AS (SELECT count(*) AS n FROM bt),
    pl AS (SELECT batch, pass, pass * n + row_number() OVER (PARTITION BY pass ORDER BY md5((pass + 5)||'|'||batch)) - 1 AS k FROM bt, n, range(0, (SELECT (4 * 30 + n - 1) // n FROM n)) r(pass))
    SELECT (k // 30)::BIGINT AS epoch, (k % 30)::BIGINT AS iteration, pass, batch FROM pl WHERE k < 4 * 30""",
)
def b9(spark, d):
    fixed = batching.batch_fixed(manifest(spark, d).select("utt", "samples"), 20, [F.col("samples").desc(), F.col("utt")])
    return batching.epoch_slice(fixed.select("batch").distinct(), "batch", 30, 4, 5)


_CODES = f"cd AS (SELECT doc_id, list_transform({chars_sql('text')}, lambda c: (ascii(c) % 5)::BIGINT) AS y FROM documents)"


def _codes(spark, d):
    chars = characters(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.transform(chars, lambda c: (F.ascii(c) % 5).cast("bigint")).alias("y"))


@query(
    "b10_chunk_sequences",
    f"""WITH {_CODES}, f AS (SELECT doc_id, y, list_filter([300, 400, 2000], lambda n: n <= len(y)) AS fit FROM cd),
    l AS (SELECT doc_id, y, fit[{slot_sql(3, 'len(fit)', 'doc_id')} + 1] AS n FROM f WHERE len(fit) > 0),
    s AS (SELECT doc_id, y, n, unnest(range(0, len(y) - n + 1, n // 2)) AS start FROM l)
    SELECT doc_id, start::BIGINT AS start, n::BIGINT AS n, array_to_string(y[start + 1:start + n], '') AS chunk FROM s""",
)
def b10(spark, d):
    chunks = batching.chunk_sequences(_codes(spark, d), "y", "doc_id", "300,400,2000", 0.5, 3)
    return chunks.select(
        "doc_id", "start", F.size("chunk").cast("bigint").alias("n"), F.array_join(F.col("chunk").cast("array<string>"), "").alias("chunk")
    )


_TURNS = f"tu AS (SELECT conv_id, turn, list_transform({chars_sql('text')}, lambda c: (ascii(c) % 5)::BIGINT) AS y FROM conversations)"


def _turns(spark, d):
    chars = characters(F.col("text"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.transform(chars, lambda c: (F.ascii(c) % 5).cast("bigint")).alias("y")
    )


def _joined(c):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


@query(
    "b11_pad_batch",
    f"""WITH {_TURNS}, l AS (SELECT *, len(y) AS length, max(len(y)) OVER (PARTITION BY conv_id) AS longest FROM tu)
    SELECT conv_id, turn, length::BIGINT AS length, array_to_string(y || list_transform(range(0, longest - length), lambda i: -1::BIGINT), ' ') AS y FROM l""",
)
def b11(spark, d):
    padded = batching.pad_batch(_turns(spark, d), ["conv_id"], "y", F.lit(-1).cast("bigint"))
    return padded.select("conv_id", "turn", "length", _joined("y"))


def _lm_sql(left):
    order = "pd || tok" if left else "tok || pd"
    mask = "pd0 || ones" if left else "ones || pd0"
    return f"""WITH {_TURNS}, s AS (SELECT conv_id, turn, [7, turn]::BIGINT[] AS pre, y[1:len(y) // 2] AS src, [8]::BIGINT[] AS post, [9] || y[len(y) // 2 + 1:] AS tgt FROM tu),
    t AS (SELECT conv_id, turn, pre || src || post || tgt[2:] AS tok, len(pre) + len(src) + len(post) - 1 AS no_loss_len FROM s),
    w AS (SELECT *, list_transform(tok, lambda x: 1) AS ones, max(len(tok)) OVER (PARTITION BY conv_id) - len(tok) AS lack FROM t),
    v AS (SELECT *, list_transform(range(0, lack), lambda i: 3::BIGINT) AS pd, list_transform(range(0, lack), lambda i: 0) AS pd0 FROM w)
    SELECT conv_id, turn, array_to_string({order}, ' ') AS tokens, array_to_string({mask}, ' ') AS mask, no_loss_len::BIGINT AS no_loss_len FROM v"""


def _lm(spark, d, side):
    half = F.floor(F.size("y") / 2).cast("int")
    rows = _turns(spark, d).select(
        "conv_id",
        "turn",
        F.array(F.lit(7).cast("bigint"), F.col("turn")).alias("pre"),
        F.slice("y", F.lit(1), half).alias("src"),
        F.array(F.lit(8).cast("bigint")).alias("post"),
        add_sos(F.slice("y", half + 1, F.size("y")), 9).alias("tgt"),
    )
    whole = batching.assemble_lm_sequence(rows, ["conv_id"], "pre", "src", "post", "tgt", 3, side)
    return whole.select("conv_id", "turn", _joined("tokens"), _joined("mask"), "no_loss_len")


@query("b12_assemble_lm_sequence", _lm_sql(False))
def b12(spark, d):
    return _lm(spark, d, "right")


@query("b12_assemble_lm_sequence_left", _lm_sql(True))
def b12_left(spark, d):
    return _lm(spark, d, "left")


@query(
    "b13_repeat_label",
    f"WITH {_TURNS} SELECT conv_id, turn, array_to_string(list_transform(y, lambda x: CASE WHEN x = 0 THEN 0 ELSE turn + 1 END), ' ') AS y FROM tu",
)
def b13(spark, d):
    labelled = _turns(spark, d).withColumn("y", repeat_label(F.col("y"), F.col("turn") + 1, 0))
    return labelled.select("conv_id", "turn", _joined("y"))


@query(
    "b14_add_sos_eos",
    f"WITH {_TURNS} SELECT conv_id, turn, array_to_string([6] || y, ' ') AS y_in, array_to_string(y || [7], ' ') AS y_out, (len(y) + 1)::BIGINT AS n FROM tu",
)
def b14(spark, d):
    rows = _turns(spark, d).select(
        "conv_id", "turn", add_sos(F.col("y"), 6).alias("y_in"), add_eos(F.col("y"), 7).alias("y_out")
    )
    return rows.select("conv_id", "turn", _joined("y_in"), _joined("y_out"), F.size("y_in").cast("bigint").alias("n"))


# Score sheets: words of the benchmark texts as syllables, cut into 1 to 4 pieces as phones.
@query(
    "b8_slices_of_bins",
    # every class is padded out to at least four rows a batch: how the ranks share them
    """WITH l AS (SELECT count(*) AS n FROM documents) SELECT n::BIGINT AS rows, 4::BIGINT AS ranks, true AS even FROM l""",
)
def b8_of_bins(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("utt"), F.col("n_chars").alias("n"))
    binned = batching.batch_by_bins(rows, 200_000, F.col("n"), min_batch_size=4)
    placed = batching.order_batches(binned, ["length_class", "batch"], "n")
    ranked = batching.rank_slice(placed, ["length_class", "batch"], "place", 4)
    shares = ranked.groupBy("length_class", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 0).alias("first"), F.count_if(F.col("rank") == 3).alias("last"), F.count_distinct("rank").alias("ranks")
    )
    return shares.agg(
        F.sum("n").alias("rows"), F.min("ranks").alias("ranks"), F.bool_and((F.col("first") - F.col("last")).between(0, 1)).alias("even")
    )


@query(
    "j17_score_label_align",
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: t <> '') AS l FROM benchmark),
    s AS (SELECT item_id, k - 1 AS k, CASE WHEN k % 6 = 0 THEN '—' ELSE l[k] END AS syllable, list_transform(range(0, least(len(l[k]), 1 + (k - 1) % 4)), lambda i: substr(l[k], 1 + i * len(l[k]) // least(len(l[k]), 1 + (k - 1) % 4),
        (i + 1) * len(l[k]) // least(len(l[k]), 1 + (k - 1) % 4) - i * len(l[k]) // least(len(l[k]), 1 + (k - 1) % 4))) AS ph,
      (k - 1) * 0.5::DOUBLE AS st, (k - 1) * 0.5::DOUBLE + 0.1::DOUBLE * (1 + len(l[k])) AS et, 60 + len(l[k]) AS note FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS k FROM w)),
    p AS (SELECT item_id, k, syllable, note, et - st AS dur, len(ph) AS n, unnest(ph) AS phone, generate_subscripts(ph, 1) - 1 AS j FROM s),
    x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k, j) - 1 AS index FROM p),
    c AS (SELECT *, [[1.0], [0.25, 1.0], [0.1, 0.5, 1.0], [0.05, 0.1, 0.5, 1.0]]::DOUBLE[][] AS cuts FROM x)
    SELECT 'b'||item_id AS utt, index::BIGINT AS index, phone, note::BIGINT AS note, floor((index % 9) * 0.05::DOUBLE / (256 / 16000.0::DOUBLE) + 0.5)::BIGINT AS duration_phn,
      floor((cuts[n][j + 1] - CASE WHEN j > 0 THEN cuts[n][j] ELSE 0 END) * dur / (256 / 16000.0::DOUBLE) + 0.5)::BIGINT AS duration_ruled_phn,
      floor(dur / (256 / 16000.0::DOUBLE) + 0.5)::BIGINT AS duration_syb, (syllable = '—')::INT::BIGINT AS slur, n::BIGINT AS phn_count FROM c""",
)
def j17(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: t != "")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("utt"), words.alias("w"))

    def phones(w, i):
        n = F.least(F.length(w), 1 + F.pmod(i, F.lit(4)))

        def edge(k):
            return F.floor(k * F.length(w) / n).cast("int")

        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(w, edge(k) + 1, edge(k + 1) - edge(k)))

    syllables = F.transform(
        "w",
        lambda w, i: F.struct(
            (i * F.lit(0.5)).alias("st"),
            (i * F.lit(0.5) + F.lit(0.1) * (1 + F.length(w))).alias("et"),
            F.when(F.pmod(i + 1, F.lit(6)) == 0, F.lit("—")).otherwise(w).alias("syllable"),
            (F.length(w) + 60).cast("bigint").alias("note"),
            F.array_join(phones(w, i), "_").alias("phones"),
        ),
    )
    flat = F.flatten(F.transform("w", phones))
    labels = F.transform(
        flat,
        lambda p, i: F.struct(
            F.lit("0.0").alias("start"), (F.pmod(i, F.lit(9)) * F.lit(0.05)).cast("string").alias("end"), p.alias("phone")
        ),
    )
    return scores.score_label_align(
        rows.select("utt", syllables.alias("syllables")), rows.select("utt", labels.alias("labels")), 16000, 256
    )
