"""How filters interact: what each one removes in every order of them.

Every document gets one bit per filter that it fails. Four filters look at the text alone; the fifth
one, for copies, is an existential self-join. Orders matter only through the combination of bits, so
documents are counted by combination, and the counts are spread over the orders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashwave.llm.common import text_or_empty, written
from hashwave.operators.joins import splittable_join

#: The filters by letter; the place is the bit.
FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"


def failed_bits(text: str, least_words: int = 100, least_distinct: int = 80, most_upper: int = 10) -> int:
    """Bits of the filters on the text alone: too short, too few different words, too many capitals, symbols."""
    data = text.encode()
    words = data.split()  # on bytes, at ASCII white space alone
    distinct, n_words = len(set(words)), len(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    fails = (
        n_words < least_words,
        100 * distinct < least_distinct * n_words,
        100 * upper > most_upper * len(text),
        len(data.translate(None, _SYMBOLS)) < len(data),
    )
    return sum(1 << i for i, fail in enumerate(fails) if fail)


def text_failures(docs: DataFrame, **limits: int) -> DataFrame:
    """``doc_id``, ``hash`` (of the text), ``part`` and ``bits`` of every row; null texts count as empty. No shuffle.

    Texts are looked at one by one, so what a task holds beside its batch is the words of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [failed_bits(t.as_py(), **limits) for t in batch.column("_text")]
            columns = [batch.column(n) for n in ("doc_id", "hash", "part")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.int32())], ["doc_id", "hash", "part", "bits"])

    texts = _texts(docs)
    schema = texts.select("doc_id", "hash", "part", F.lit(0).alias("bits")).schema
    return texts.mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty("text")
    return docs.select(
        "doc_id", F.xxhash64(text).alias("hash"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("_text")
    )


def copies(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """``doc_id``, ``hash`` and ``part`` of rows whose text a smaller ``doc_id`` has, by an existential self-join.

    ``hashed`` has ``doc_id`` and ``hash`` of all rows. Only rows whose hash has a smaller id, and one row for each
    such hash and text, are joined with their texts; the rest is ruled out by numbers. The right side is reduced to
    the smallest id of each text, since a smaller id exists if that one is smaller: so a group of copies
    meets one row, not itself, and the join can be split. Null ids are smaller than none and have none smaller.
    """
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    first = written(first.where("_first < _last"), "shared-hashes")
    texts = splittable_join(_texts(docs), first.select("hash"), ["hash"], "left_semi").where("doc_id is not null")
    smallest = texts.groupBy("hash", "_text").agg(F.min("doc_id").alias("_smallest"))
    key = F.xxhash64("hash", "_text")
    left, right = texts.withColumn("_spread", key), smallest.withColumn("_spread", key)
    same = [left[c] == right[c] for c in ("hash", "_text", "_spread")]
    return left.join(right, [*same, right["_smallest"] < left["doc_id"]], "left_semi").select("doc_id", "hash", "part")


def combinations(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """Documents counted by ``part``, ``bits``, ``good`` and ``toxic``: at most 128 rows a part.

    Failures are rows of a bit; those of one document are united by id, text hash and part, so rows repeated in all of
    these are counted as often as they are there.
    """
    failures = written(text_failures(docs, **limits).withColumn("n", F.lit(1).cast("long")), "failures")
    marked = copies(docs, failures.select("doc_id", "hash"))
    marked = marked.select("doc_id", "hash", "part", F.lit(_COPY).alias("bits"), F.lit(0).cast("long").alias("n"))
    united = failures.unionByName(marked).groupBy("doc_id", "hash", "part").agg(
        F.bit_or("bits").alias("bits"), F.sum("n").alias("n")
    )
    # A hot combination without labels is one row per task before it meets anything.
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    labelled = splittable_join(united, known, ["doc_id"], "left")
    no = F.lit(False)
    return labelled.groupBy(
        "part", "bits", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    ).agg(F.sum("n").alias("n"))


def interactions(counted: DataFrame) -> DataFrame:
    """One row per ``part``, ``filter_order`` and ``step``, from documents counted by combination.

    Each counted row meets the steps of all orders as an array of constants; nothing is joined.
    """
    steps = [
        (order, step, 1 << FILTERS.index(order[step - 1]), sum(1 << FILTERS.index(f) for f in order[: step - 1]))
        for order in map("".join, permutations(FILTERS))
        for step in range(1, len(FILTERS) + 1)
    ]
    listed = F.from_json(
        F.lit("[" + ",".join(f'["{o}",{s},{b},{e}]' for o, s, b, e in steps) + "]"), "array<array<string>>"
    )
    spread = counted.select("*", F.explode(listed).alias("_step")).select(
        "part",
        "bits",
        "good",
        "toxic",
        "n",
        F.col("_step")[0].alias("filter_order"),
        *(F.col("_step")[i].cast("int").alias(name) for i, name in enumerate(("step", "_bit", "_earlier"), 1)),
    )
    bits, bit, earlier = F.col("bits"), F.col("_bit"), F.col("_earlier")
    fails, gone = bits.bitwiseAND(bit) != 0, bits.bitwiseAND(earlier) != 0
    removed = fails & ~gone
    # A document with k failing filters falls to each of them in one k-th of the orders.
    orders = math.factorial(len(FILTERS))
    share = F.lit(orders) / F.greatest(F.bit_count(bits), F.lit(1))

    def total(when, value=F.col("n")):
        return F.sum(F.when(when, value).otherwise(0)).cast("long")

    return spread.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(bits == bit).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """For each language, order of the filters and step: what the step keeps, removes and need not remove.

    Filters: A too short, B too few different words, C too many capitals, D symbols, E a copy of a text with a smaller
    ``doc_id`` anywhere in the table. Null texts are empty, so they are copies of one another; null languages
    form the part of the empty string. Of several labels of one id, any that says good (or toxic) counts; labels
    without an id count for nothing. Texts are looked at whole, however long. Rows without an id are no
    copies, nor others of them. Only ``doc_id``, ``text`` and ``lang`` are used, so other columns cannot clash.
    An empty table has no parts and gives no rows.
    """
    return interactions(combinations(docs, labels, **limits))
