"""Points and leaves of the Jaccard join: bounds that hold, and few pairs left to verify."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from hashwave import session as spark_session
from hashwave.llm import common, jaccard


def test_points_never_tell_less_than_is_shared():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 63, 64, 65, 130, 700, 1500):
        own = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        sets += [own, np.unique(np.concatenate([own[: 9 * n // 10 + 1], rng.integers(0, 1 << 63, n // 10, np.uint64)]))]
    # Counts above those that a point tells: all shingles in one group, even and odd ones.
    sets += [np.arange(1, 60, dtype=np.uint64) << np.uint64(20), (np.arange(1, 58, dtype=np.uint64) << np.uint64(20)) + np.uint64(1)]
    sets += [sets[-2][3:], np.concatenate([sets[-2][:50], sets[-1][:5]])]
    points = jaccard._Points(pa.array([jaccard._point(s) for s in sets], pa.binary()), np.array([len(s) for s in sets]))
    every = np.arange(len(sets))
    a, b = np.repeat(every, len(sets)), np.tile(every, len(sets))
    for percent in (30, 80, 100):
        similar = np.array([100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)])
        allowed = points.allow(a, b, percent)
        assert allowed[similar].all()
        unlike = [i for i, j in zip(a, b) if percent == 80 and i < j < 16 and i // 2 != j // 2 and len(sets[i]) > 60]
        assert not unlike or not allowed[(a < b) & (b < 16) & (a // 2 != b // 2) & (points.sizes[a] > 60)].any()


def test_every_later_row_of_a_cell_is_met_once(monkeypatch):
    monkeypatch.setattr(jaccard, "_PAIRS", 5)
    cells = np.repeat([-3, 0, 7, 9], [1, 6, 2, 4])
    found = [(int(i), int(j)) for a, b in jaccard._later(cells) for i, j in zip(a, b)]
    assert found == [(i, j) for i in range(13) for j in range(i + 1, 13) if cells[i] == cells[j]]
    assert list(jaccard._later(cells[:0])) == []


def passage_texts(n, seed=1):
    """Texts that share one passage and hold own words, any two just below the similarity."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    passage = [word() for _ in range(250)]
    return [" ".join(passage + [word() for _ in range(44)]) for _ in range(n)]


@pytest.mark.parametrize("stars", [0, 2])
def test_few_pairs_below_the_similarity_are_verified(spark, monkeypatch, stars):
    counted, verify = [], jaccard._verified

    def spy(pairs, *rest):
        counted.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard, "STARS", stars)
    monkeypatch.setattr(jaccard, "_verified", spy)
    texts = passage_texts(400)
    twins = [texts[7] + " tail", texts[300].rsplit(" ", 1)[0]]
    docs = spark.createDataFrame(list(enumerate(texts + twins)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.similar_texts(docs).collect()}
    assert found == {i: i for i in range(400)} | {400: 7, 401: 300}
    # Of some 80,000 pairs at a similarity of 0.74. Each star tries every set with at most one other.
    assert len(counted) == stars + 1
    assert all(n <= 402 for n in counted[:stars]) and counted[-1] <= 40


def test_points_of_small_counts_are_short():
    rng = np.random.default_rng(5)
    shingles = np.unique(rng.integers(0, 1 << 63, 500, np.uint64))
    # Half a byte for each of 512 groups is 256.
    assert len(jaccard._point(shingles)) < 180


def test_tables_are_deleted_as_soon_as_nothing_reads_them(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(spark_session, "shared_dir", lambda spark, purpose: made.append(f"{tmp_path}/{purpose}-{len(made)}") or made[-1])
    monkeypatch.setattr(common, "shared_dir", spark_session.shared_dir)
    texts = passage_texts(60)
    docs = spark.createDataFrame(list(enumerate([*texts, texts[7] + " tail"])), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.similar_texts(docs).collect()}
    assert found == {i: i for i in range(60)} | {60: 7}
    left = {Path(path).name.split("-")[0] for path in made if Path(path).exists()}
    assert {Path(path).name.split("-")[0] for path in made} >= {"summaries", "cells", "several", "points", "placed", "members", "pairs", "sets"}
    assert not left & {"summaries", "cells", "several", "points", "placed", "members", "pairs", "sets"}
    assert "rows" in left


def test_only_rows_that_the_bits_name_are_asked(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(-50, 1000)] + [(None, "none")], "_key long, _row string")
    keys = spark.createDataFrame([(-7,), (12,), (999,), ((1 << jaccard.DOC_BITS) + 40,)], "_key long")
    alone, asked = jaccard._by_bits(docs, keys)
    # The last key has the low bits of another row.
    assert sorted(r._key for r in asked.collect()) == [-7, 12, 40, 999]
    assert alone.count() == 1051 - 4 and alone.where("_key is null").count() == 1
