"""Exact dedup against grouping by the normalised text."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hashwave.llm import exact

SCHEMA = "doc_id long, text string, length string, sha256 string, kept int, _row long"


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def checked(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x", "y", 7, 3) for i, t in rows], SCHEMA).repartition(4)
    found = exact.equal_texts(frame, **options).collect()
    assert len(found) == len(rows)
    ids = defaultdict(list)
    for i, t in rows:
        ids[hashlib.sha256(normal(t).encode()).hexdigest()].append(i)
    lengths = defaultdict(list)
    for i, t in rows:
        lengths[i].append(len(normal(t)))
    by_row = defaultdict(list)
    for r in found:
        assert r.length in lengths[r.doc_id]
        by_row[r.doc_id].append(r)
    stays = 0
    for digest, members in ids.items():
        known = [i for i in members if i is not None]
        first = min(known, default=None)
        kept = 0
        for i in set(members):
            mine = [r for r in by_row[i] if r.sha256 == digest] or [r for r in by_row[i] if r.sha256 is None and r.group_size == 1]
            assert mine and all((r.keep_id, r.group_size) == (first, len(members)) for r in mine if r.sha256)
            kept += sum(r.kept for r in mine if r.sha256)
        if all(r.sha256 for r in found):
            assert kept == 1
            stays += 1
    assert sum(r.kept for r in found) == len(ids)
    return found


@pytest.mark.parametrize("digests", [True, False])
@pytest.mark.parametrize("prefix", [1, 8, 256])
def test_same_groups_as_by_text(spark, digests, prefix):
    dice = random.Random(5)
    long = "word " * 50_000
    texts = ["same text"] * 300 + ["same\ttext", " same text", "same \n text ", "same  text", "some text", "samE text", None, "", " ", "\n\t", "\xa0", "tail a", "tail b"]
    texts += [long, long + "x", long + "y", long.replace(" ", "\r\n")] + ["".join(dice.choices("ab ", k=5)) for _ in range(200)]
    ids = list(range(len(texts)))
    dice.shuffle(ids)
    found = checked(spark, list(zip(ids, texts)), digests=digests, prefix=prefix)
    if not digests:
        assert any(r.sha256 is None for r in found)


@pytest.mark.parametrize("digests", [True, False])
def test_rows_without_id_and_repeated_rows(spark, digests):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (-5, "d"), (2, "d"), (None, "e"), (None, None), (7, "")]
    found = checked(spark, rows, digests=digests)
    a = [r for r in found if r.keep_id == 1 and r.group_size == 3]
    assert [sorted((r.doc_id, r.kept) for r in a if r.doc_id), [r.kept for r in a if r.doc_id is None]] == [[(1, False), (1, True)], [False]]
    assert sorted(r.kept for r in found if r.keep_id is None and r.group_size == 2) == [False, True]
    assert [(r.doc_id, r.kept) for r in sorted(found, key=lambda r: r.doc_id or 0) if r.keep_id == -5] == [(-5, True), (2, False)]


def test_no_rows_and_no_python(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert exact.equal_texts(frame).count() == 0
    plan = exact.equal_texts(frame, digests=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert exact.equal_texts(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("q").alias("body")), text="body").where("kept").count() == 1
