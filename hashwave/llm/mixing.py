"""Mixing sources to target weights.

Words are added up per source, each source gets a target, and target over size is the rate at
which its documents are repeated: floor(rate) times for certain, and once more with the fraction as
probability, drawn from hashes so that every run takes the same ones.

Independent draws would leave a source of few or unequal documents far off its target. So the draws of a source are
one systematic sample: its documents are numbered by size and then by hash, and document k is taken once more where
k * fraction + offset passes a whole number, with an offset in [0, 1) that a hash of seed and source gives. Over the
seeds each document is taken with just the fraction as probability. As many are taken of the small ones as of the
large ones, so the words taken miss the target by at most those of the largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashwave.llm.common import WORD, text_or_empty, written
from hashwave.operators.numbering import numbered

SEED = "mix-1"
WEIGHTS = (3, 1, 2)


def size(text: str = "text") -> Column:
    """Words of the whole text; none for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2
) -> DataFrame:
    """Size, target and rate of each source, from rows of (``source``, ``size``).

    The sources in code point order, null last, take the weights in turn and share ``percent`` of
    all words; no target exceeds ``most`` times its source, and what that leaves over goes to the
    others by weight until none is above. Sorted by how soon they fill up, the full sources are a
    prefix, and the level that the rest share per unit of weight is the highest that any prefix
    leaves. A source without words has target 0 and rate 0. There is one row per source in the two windows, after
    an aggregate with a map-side part, so a hot source is one row per input task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = by_source.withColumn("weight", weight.cast("long"))
    full = most * F.col("source_size")
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, everything = (
        order.rowsBetween(Window.unboundedPreceding, -1),
        order.rowsBetween(0, Window.unboundedFollowing),
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )
    left = percent * F.sum("source_size").over(everything) - 100 * F.coalesce(F.sum(full).over(before), F.lit(0))
    level = left / (100.0 * F.sum("weight").over(after))
    # Filling up one more source raises the level until the level is right and lowers it afterwards.
    found = weighed.withColumn("_level", level).withColumn("_common", F.max("_level").over(everything))
    target = F.when(F.col("_common") * F.col("weight") < full, F.col("_common") * F.col("weight")).otherwise(full.cast("double"))
    return found.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def draw(doc_id: str = "doc_id", text: str | None = None, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document's id alone, or on its text where that is null."""
    name = F.col(doc_id).cast("string")
    if text:
        name = F.coalesce(name, F.md5(text_or_empty(text)))
    return _fraction(F.coalesce(name, F.lit("null")), seed)


def _fraction(name: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sized(df: DataFrame, *columns: str, text: str = "text", seed: str = SEED) -> DataFrame:
    """``columns``, ``source``, ``size``, ``chance`` and ``key`` of every row, stored; equal rows have equal keys."""
    rows = df.select(*columns, "source", size(text).alias("size"), draw(text=text, seed=seed).alias("chance"), _key(df).alias("key"))
    return written(rows, "sizes")


def _key(df: DataFrame) -> Column:
    """Tells rows apart by all columns that can be hashed."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()))


def times(rows: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """``key``, ``source``, ``source_size``, ``target`` and ``times`` for each different row of ``sized`` rows.

    Equal rows are one document of their words together and are taken alike. Documents are numbered over ranges of
    source and size, so a hot source covers several tasks.
    """
    rates = source_targets(rows.select("source", "size"), **shares).withColumnRenamed("source", "_of")
    alike = rows.groupBy("key", "source").agg(F.sum("size").alias("size"), F.min("chance").alias("chance"))
    placed = numbered(alike, ["source"], ["size", "chance", "key"])
    rated = placed.join(rates, F.col("source").eqNullSafe(F.col("_of")))
    fraction = F.col("rate") - F.floor("rate")
    offset = _fraction(F.concat(F.lit("offset:"), F.coalesce("source", F.lit("null"))), seed)
    passed = lambda k: F.floor(k * fraction + offset)
    once_more = F.least(passed(F.col("number") + 1) - passed(F.col("number")), F.lit(1))
    taken = (F.floor("rate") + once_more).cast("long").alias("times")
    return rated.select("key", "source", "source_size", "target", taken)


def mix(df: DataFrame, text: str = "text", seed: str = SEED, **shares) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``df``.

    Needs ``doc_id`` and ``source``. Null sources form one source; null and empty texts have no words and are drawn
    like others; rows without an id are drawn by their text. Repeated rows are one document and are taken alike, and
    rows that differ in a map column alone count as repeated. Other columns may have any names. An empty table
    has an empty mix. The words taken of a source miss its target by at most its largest document, whatever its
    length. The texts are shuffled once, for the join by key, which Spark splits where it is skewed.
    """
    taken = times(sized(df, text=text, seed=seed), seed, **shares).where("times > 0")
    taken = taken.select(F.col("key").alias("_of"), F.col("source").alias("_from"), "times")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    held = df.select(row, _key(df).alias("_key"), F.col("source").alias("_source"))
    joined = held.join(taken, (held["_key"] == taken["_of"]) & held["_source"].eqNullSafe(taken["_from"]))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")
