"""Epoch metrics, best epochs, parameter averages and decode logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from uttmill.operators import runs
from uttmill.plans.evaluation import log_rtf

from .registry import query, table

_LOG = "lo AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS epoch, event_type AS key, value, user_id AS weight FROM events)"
_METRICS = f"""{_LOG}, me AS (SELECT epoch::BIGINT AS epoch, key, sum(value * weight) / sum(weight) AS value, sum(weight)::BIGINT AS weight FROM lo WHERE value IS NOT NULL GROUP BY ALL)"""


def _metrics(spark, d):
    log = table(spark, d, "events").select(
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("epoch"),
        F.lit("valid").alias("phase"),
        F.col("event_type").alias("key"),
        "value",
        F.col("user_id").alias("weight"),
    )
    return runs.epoch_metrics(log)


@query("a18_epoch_metrics", f"WITH {_METRICS} SELECT epoch, 'valid' AS phase, key, round(value, 6) AS value, weight FROM me")
def a18(spark, d):
    return _metrics(spark, d).withColumn("value", F.round("value", 6))


@query(
    "w5_top_n_epochs",
    f"""WITH {_METRICS} SELECT epoch, round(value, 6) AS value, place FROM (SELECT *, row_number() OVER (ORDER BY value DESC, epoch)::BIGINT AS place FROM me WHERE key = 'view') WHERE place <= 5""",
)
def w5(spark, d):
    return runs.top_n_epochs(_metrics(spark, d), "valid", "view", "max", 5).withColumn("value", F.round("value", 6))


_BEST = f"""{_METRICS}, be AS (SELECT *, min(value) OVER (PARTITION BY key ORDER BY epoch) AS best,
  coalesce(value < min(value) OVER (PARTITION BY key ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM me)"""


@query("w7_best_so_far", f"WITH {_BEST} SELECT epoch, key, round(best, 6) AS best, improved FROM be")
def w7(spark, d):
    return runs.best_so_far(_metrics(spark, d), "min").select("epoch", "key", F.round("best", 6).alias("best"), "improved")


@query(
    "w8_early_stop",
    f"""WITH {_BEST}, ma AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY key ORDER BY epoch) AS best_epoch FROM be)
    SELECT key, min(epoch) AS stop_epoch, arg_min(best_epoch, epoch) AS best_epoch FROM ma WHERE epoch - best_epoch > 3 GROUP BY key""",
)
def w8(spark, d):
    return runs.early_stop(_metrics(spark, d), "min", 3).select("key", "stop_epoch", "best_epoch")


@query(
    "w10_retained_checkpoints",
    f"""WITH {_METRICS}, a AS (SELECT epoch, row_number() OVER (ORDER BY value DESC, epoch) AS r FROM me WHERE key = 'view'),
    b AS (SELECT epoch, row_number() OVER (ORDER BY value, epoch) AS r FROM me WHERE key = 'error')
    SELECT epoch, epoch IN (SELECT epoch FROM a WHERE r <= 3 UNION SELECT epoch FROM b WHERE r <= 3 UNION SELECT max(epoch) FROM me) AS kept FROM (SELECT DISTINCT epoch FROM me)""",
)
def w10(spark, d):
    return runs.retained_checkpoints(_metrics(spark, d), [("valid", "view", "max"), ("valid", "error", "min")], 3)


_STATES = """ra AS (SELECT label::BIGINT AS epoch, 'p'||row_number() OVER (PARTITION BY label ORDER BY vec_id) AS name, vec_id, embedding FROM embeddings),
 sa AS (SELECT epoch, name, generate_subscripts(embedding, 1)::BIGINT - 1 AS idx, 'float32' AS dtype, unnest(embedding)::DOUBLE AS value FROM ra
   UNION ALL SELECT epoch, 'steps', 0, 'int64', vec_id::DOUBLE FROM ra WHERE name = 'p1')"""


@query(
    "a19_average_parameters",
    f"""WITH {_METRICS}, {_STATES}, ch AS (SELECT epoch FROM me WHERE key = 'view' AND epoch < 10 ORDER BY value DESC, epoch LIMIT 3)
    SELECT name, idx, dtype, round(CASE WHEN dtype = 'int64' THEN sum(value) ELSE sum(value) / 3 END, 6) AS value FROM sa WHERE epoch IN (SELECT epoch FROM ch) GROUP BY name, idx, dtype""",
)
def a19(spark, d):
    numbered = table(spark, d, "embeddings").select(
        F.col("label").cast("bigint").alias("epoch"),
        F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("r"),
        "vec_id",
        "embedding",
    )
    floats = numbered.select(
        "epoch",
        F.concat(F.lit("p"), F.col("r").cast("string")).alias("name"),
        F.posexplode("embedding").alias("idx", "value"),
    ).select("epoch", "name", F.col("idx").cast("bigint").alias("idx"), F.lit("float32").alias("dtype"), F.col("value").cast("double").alias("value"))
    steps = numbered.where("r = 1").select(
        "epoch",
        F.lit("steps").alias("name"),
        F.lit(0).cast("bigint").alias("idx"),
        F.lit("int64").alias("dtype"),
        F.col("vec_id").cast("double").alias("value"),
    )
    best = runs.top_n_epochs(_metrics(spark, d).where("epoch < 10"), "valid", "view", "max", 3)
    return runs.average_parameters(floats.unionByName(steps), best, 3).withColumn("value", F.round("value", 6))


_PAIRED = """mk AS (SELECT user_id, event_id, ts, event_type, value, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS next_ts, lead(event_id) OVER w AS next_id
  FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 pa AS (SELECT * FROM mk WHERE event_type = 'view' AND next_type = 'purchase')"""


def _paired(spark, d, **kwargs):
    return runs.pair_markers(
        table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "view", "purchase", ["event_id", "ts", "value"], **kwargs
    )


@query("w9_pair_markers", f"WITH {_PAIRED} SELECT user_id, event_id, next_id AS end_event_id FROM pa")
def w9(spark, d):
    return _paired(spark, d).select("user_id", "event_id", "end_event_id")


# jobs with more than 10 events count as hot
@query("w9_hot_jobs", f"WITH {_PAIRED} SELECT user_id, event_id, next_id AS end_event_id FROM pa")
def w9_hot(spark, d):
    return _paired(spark, d, hot_rows=10).select("user_id", "event_id", "end_event_id")


@query(
    "a20_decode_rtf",
    f"""WITH {_PAIRED}, s AS (SELECT (epoch_us(next_ts) - epoch_us(ts)) / 1000000.0::DOUBLE AS decode, value AS audio FROM pa)
    SELECT count(*)::BIGINT AS utterances, round(sum(decode) / sum(audio), 6) AS rtf, round(avg(decode), 6) AS latency FROM s""",
)
def a20(spark, d):
    result = runs.decode_rtf(_paired(spark, d), F.col("ts"), F.col("end_ts"), F.col("value"))
    return result.select("utterances", F.round("rtf", 6).alias("rtf"), F.round("latency", 6).alias("latency"))


@query(
    "a20_parse_log",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'start' ELSE 'end' END AS marker,
      CASE event_type WHEN 'view' THEN value END AS length FROM events WHERE event_type IN ('view', 'purchase')""",
)
def a20_log(spark, d):
    parsed = runs.parse_log(
        _log_lines(spark, d), "line", r"speech length: ([0-9.]+)", "best hypo", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
    )
    return parsed.select("event_id", "marker", "length")


# The log of each user as a decoding job; times are those of the lines, whole seconds.
@query(
    "log_rtf",
    f"""WITH {_PAIRED}, s AS (SELECT (epoch_us(date_trunc('second', next_ts)) - epoch_us(date_trunc('second', ts))) / 1000000.0::DOUBLE AS decode, value / 16000 AS audio FROM pa)
    SELECT count(*)::BIGINT AS utterances, round(sum(decode) / sum(audio), 3) AS rtf, round(avg(decode), 6) AS latency FROM s""",
)
def rtf_of_logs(spark, d):
    result = log_rtf(
        _log_lines(spark, d), "user_id", ["ts", "event_id"], "line", r"speech length: ([0-9.]+)", "best hypo",
        r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", 16000.0,
    )
    return result.select("utterances", F.round("rtf", 3).alias("rtf"), F.round("latency", 6).alias("latency"))


def _log_lines(spark, d):
    words = F.when(F.col("event_type") == "view", F.concat(F.lit("speech length: "), F.col("value").cast("string")))
    words = words.when(F.col("event_type") == "purchase", F.lit("best hypo: a b")).otherwise(F.lit("beam size 5"))
    return table(spark, d, "events").select("event_id", "user_id", "ts", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO: "), words).alias("line"))
