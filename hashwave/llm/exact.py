"""Exact dedup by progressive refinement.

Rows that could be equal are told apart step by step, each step looking only at what the one before left: by
the length of the normalised text, then by a hash of its beginning, then by a hash of all of it. Only the
rows of the last groups have their whole content compared. Native: functions of Spark on the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashwave.llm.common import text_or_empty, written
from hashwave.operators.joins import splittable_join

#: White space other than one single space, which is what normalising replaces by one.
_UNEVEN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

PREFIX = 256


def normalised(text: str = "text") -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), _UNEVEN, " ")


def _shared(rows: DataFrame, *by: str) -> DataFrame:
    """The rows that agree with another one in ``by``. Counted before the shuffle, so that a hot value is one row per task."""
    often = rows.groupBy(*by).count().where("count > 1").select(*by)
    return splittable_join(rows, often, list(by), "left_semi")


def _place() -> Column:
    """Document id and row as one number to order by, rows without an id last; numbers are aggregated by hash."""
    id = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.expr("9223372036854775808BD"))
    return id * F.expr("10000000000000000000BD") + F.col("_row").cast("decimal(19,0)")


def _signatures(texts: DataFrame, prefix: int, digest: bool) -> DataFrame:
    """Length and hash of the beginning of each normalised ``_text``, and with ``digest`` the hash of all of it."""
    bodies = texts.select("doc_id", normalised("_text").alias("_body"))
    whole = [F.sha2("_body", 256).alias("sha256")] if digest else []
    start = F.xxhash64(F.left("_body", F.lit(prefix))).alias("prefix")
    return bodies.select("doc_id", F.length("_body").cast("long").alias("length"), start, *whole)


def equal_texts(docs: DataFrame, text: str = "text", digests: bool = False, prefix: int = PREFIX) -> DataFrame:
    """One row per document: ``doc_id``, ``length``, ``sha256``, ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when their normalised forms are. Of each group the row of the smallest ``doc_id`` stays, of
    repeated rows of that id one; rows without an id stay only where no other row has one, and then one of
    them does (``keep_id`` is null). Null and empty texts are equal to one another; a blank text is one space. Texts of any
    length are hashed whole. Of ``docs`` only ``doc_id`` and the text are used, so other columns cannot clash.
    An empty table gives no rows.

    ``sha256`` (hex, of the normalised text) is there for the rows that agree with another one in length and first
    ``prefix`` characters, and null for the others, whose content is not looked at again: only documents of the former
    are read a second time. With ``digests`` the caller wants that of every row. It is then taken in the first
    reading, and the last step picks up those of its rows instead of reading their texts again.

    Lengths and hashes are shuffled, and texts only where the second reading is joined by shuffle. A hot group is one row
    per task where it is counted, and its rows are joined by splittable joins.
    """
    held = docs.select("doc_id", F.col(text).alias("_text"))
    signed = written(_signatures(held, prefix, digests), "signatures")
    step = ["length", "prefix"]
    likely = _shared(_shared(signed.select("doc_id", *step), "length"), *step)
    keys = written(likely.select(*step).distinct(), "likely")
    marked = splittable_join(signed, keys.withColumn("_likely", F.lit(True)), step, "left")
    marked = written(marked, "marked")

    whole = marked.where("_likely").drop("_likely")
    if not digests:
        ids = whole.select(F.col("doc_id").alias("_id")).distinct()
        again = held.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        # Rows of the same id with other texts come along, and go again.
        whole = splittable_join(_signatures(again, prefix, True), keys, step, "left_semi")
    whole = written(whole.withColumn("_row", F.monotonically_increasing_id()), "digests")
    groups = whole.groupBy("sha256").agg(
        F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"), F.min_by("_row", _place()).alias("_keep")
    )
    grouped = splittable_join(whole, groups, ["sha256"]).withColumn("kept", F.col("_row") == F.col("_keep"))
    alone = marked.where("_likely is null").select(
        "doc_id",
        "length",
        (F.col("sha256") if digests else F.lit(None).cast("string")).alias("sha256"),
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    return alone.unionByName(grouped.select(*alone.columns))
