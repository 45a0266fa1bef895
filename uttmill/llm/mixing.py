"""Mixing sources to target weights: complete epochs, then Efraimidis-Spirakis sampling.

Each source has a weight and may be repeated ``max_epochs`` times. The targets share the
words of all documents by weight; what a source cannot give within its epochs is shared
again among the others. A source is taken in complete epochs first. The rest of its target
is filled in the order of exponential keys ``-ln(u) / quality``: u is a uniform number from
a digest of the seed and the id, quality a weight of the document. The prefix sum of words
in that order ends at the document that crosses the budget, which is taken if that comes nearer.

No source is sorted in one task: keys fall into ``KEY_BINS`` bins of about equal mass, the
bins are summed, and only the bin in which the budget ends is looked at row by row. One row
per source holds the outcome (epochs, and the last key taken), so texts are never shuffled.

Everything is DataFrame functions. The quality weight of a text is its share of characters
that are not markup symbols, to the fourth power, at least 0.05; another Column can be given.

Null and empty texts have no words: they take part in complete epochs only. A null source is
a source of its own, the last. Null ids share one random number and are told apart by their
text. Rows equal in id and text are taken together. Extra columns stay in
``mixed_documents`` whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import leading_number, shuffle_key
from ..functions.let import let
from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
KEY_BINS = 4096
SEED = 8
BROADCAST_SOURCES = 50_000
SYMBOLS = "#*$%&|<>!"
MIN_QUALITY = 0.05
#: rates whose mean spreads the keys of all qualities from MIN_QUALITY to 1 over the bins
RATES = (1.0, 0.5, 0.2, 0.05)


def text_quality(text: Column) -> Column:
    """The share of characters that are not symbols, to the fourth power."""
    share = F.length(F.translate(text, SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    return let(share, lambda x: F.greatest(F.lit(MIN_QUALITY), x * x * x * x))


def _facts(id_col: str, text_col: str, source_col: str, quality: Column | None, seed: int) -> Column:
    """What mixing has to know of a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.col(source_col).cast("string")
    u = (leading_number(shuffle_key(seed, F.col(id_col)), 13) + 1).cast("double") / F.lit(float(16**13))
    key = -F.log(u) / (text_quality(text) if quality is None else quality)
    return F.struct(
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.struct(key.alias("key"), F.col(id_col).cast("string").alias("id"), F.crc32(F.encode(text, "UTF-8")).alias("crc")).alias("place"),
    )


def _bin(key: Column) -> Column:
    mass = sum((1 - F.exp(-F.lit(rate) * key) for rate in RATES[1:]), 1 - F.exp(-F.lit(RATES[0]) * key)) / len(RATES)
    return F.least(F.lit(KEY_BINS - 1), F.floor(mass * KEY_BINS)).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` and ``epochs`` to (no_source, source, source_size), one row per source.

    Sources take the weights in turn, by code point, null last. With ``r`` the level at
    which a source reaches its cap, the common level is the largest that any prefix of the
    sources in order of ``r`` leaves to the rest.
    """
    order = Window.orderBy("no_source", "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    rows = rows.withColumn("r", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("r", "no_source", "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("r", "no_source", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(onward))
    rows = rows.withColumn("level", F.max("level").over(whole))
    rows = rows.withColumn("target", F.when(F.col("r") <= F.col("level"), F.col("cap")).otherwise(F.col("level") * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return rows.select("no_source", "source", "source_size", "target", epochs.cast("int").alias("epochs"))


def _cuts(facts: DataFrame, weights, max_epochs: int) -> DataFrame:
    """Per source: size, target, epochs, and the place of the last document of the fractional epoch."""
    own = ["no_source", "source"]
    bins = facts.groupBy(*own, _bin(F.col("place.key")).alias("bin")).agg(F.sum("size").alias("words"))
    sizes = bins.groupBy(*own).agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, max_epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy(*own).orderBy("bin")
    bins = bins.withColumn("after", F.sum("words").over(upto)).join(plan, own)
    start = F.col("after") - F.col("words")
    crossing = bins.where((start < F.col("budget")) & (F.col("budget") <= F.col("after")))
    crossing = crossing.select(*own, "bin", start.alias("start"), "budget")
    rows = facts.where("size > 0").withColumn("bin", _bin(F.col("place.key"))).join(crossing, [*own, "bin"])
    inside = Window.partitionBy(*own, "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("after", F.col("start") + F.sum("size").over(inside))
    early = F.col("after") - F.col("size")
    nearer = (early < F.col("budget")) & (2 * (F.col("budget") - early) > F.col("size"))
    taken = rows.where((F.col("after") <= F.col("budget")) | nearer)
    last = taken.groupBy(*own).agg(F.max("place").alias("last"))
    # where the bin gives no document, all before it are taken
    found = crossing.join(last, own, "left").select(*own, F.col("bin").alias("last_bin"), "last")
    plan = cut_lineage(plan.join(found, own, "left").drop("budget"))
    # one row per source; a great many sources are joined by a shuffle that Spark can split
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _copies(size: Column, place: Column, plan: str) -> Column:
    """How often a row is taken; ``plan``: the name of the plan's column."""
    bin_of, last = _bin(place.getField("key")), F.col(f"{plan}.last")
    before = bin_of < F.col(f"{plan}.last_bin")
    upto = (bin_of == F.col(f"{plan}.last_bin")) & last.isNotNull() & (place <= last)
    return F.col(f"{plan}.epochs") + F.when((size > 0) & F.coalesce(before | upto, F.lit(False)), 1).otherwise(0)


def mixture(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    quality: Column | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies, taken (words)."""
    facts = docs.select(F.col(id_col).alias("doc_id"), _facts(id_col, text_col, source_col, quality, seed).alias("fact"))
    facts = cut_lineage(facts.select("doc_id", "fact.*"))
    plan = _cuts(facts.drop("doc_id"), weights, max_epochs)
    rows = facts.join(plan.select("no_source", "source", F.struct("*").alias("plan")), ["no_source", "source"])
    copies = _copies(F.col("size"), F.col("place"), "plan")
    return rows.select("doc_id", "size", "plan.source_size", "plan.target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    quality: Column | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of the mix, all columns, each as often as the mix takes it."""
    name = "fact"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    rows = docs.withColumn(name, _facts(id_col, text_col, source_col, quality, seed))
    plan = _cuts(cut_lineage(rows.select(f"{name}.*")), weights, max_epochs)
    plan = plan.select(F.struct("*").alias(f"{name}plan"))
    joined = rows.join(plan, [F.col(f"{name}.{c}") == F.col(f"{name}plan.{c}") for c in ("no_source", "source")])
    repeat = F.array_repeat(F.lit(0), _copies(F.col(f"{name}.size"), F.col(f"{name}.place"), f"{name}plan"))
    return joined.withColumn(f"{name}copy", F.explode(repeat)).select(*docs.columns)
