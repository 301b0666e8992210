"""The filter audit against walking every document through every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from hashwave.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0d]+")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(doc_id, text, docs):
    words = WORD.findall(text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in docs),
    }


def walked(docs, labels):
    out = defaultdict(lambda: dict.fromkeys(COUNTS, 0))
    for doc_id, text, lang in docs:
        good = any(i == doc_id and q == 1 for i, q, _ in labels) and doc_id is not None
        toxic = any(i == doc_id and t == 1 for i, _, t in labels) and doc_id is not None
        fails = failing(doc_id, text or "", docs)
        for order in permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                row = out[lang or "", "".join(order), step]
                row["kept"] += not gone and not fails[letter]
                row["removed"] += not gone and fails[letter]
                row["redundant"] += gone and fails[letter]
                row["unique_fails"] += fails[letter] and sum(fails.values()) == 1
                row["good_lost"] += not gone and fails[letter] and good
                row["toxic_lost"] += not gone and fails[letter] and toxic
                gone = gone or fails[letter]
    shares = defaultdict(int)
    for (part, order, step), row in out.items():
        shares[part, order[step - 1]] += row["removed"]
    for (part, order, step), row in out.items():
        row["shapley"] = shares[part, order[step - 1]]
    return dict(out)


def audited(spark, docs, labels):
    rows = [(i, t, g, "clash", 1, 2) for i, t, g in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, hash string, bits int, n int").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): {c: r[c] for c in COUNTS} for r in audit.audit(frame, known).collect()}


def test_same_as_walking_every_order(spark):
    dice = random.Random(2)
    pool = ["lorem", "Ipsum", "DOLOR", "sit amet", "été", "#tag", "a|b", "plain", "text", "more"]
    distinct = " ".join(f"w{i}" for i in range(120))
    texts = [distinct, distinct, distinct.upper(), distinct + " #", "short", None, "", " \t\n", "x " * 30_000, " " * 200]
    texts += [" ".join(dice.choices(pool, k=dice.choice([1, 3, 150]))) for _ in range(40)] + ["hot copy"] * 40
    docs = [(i, t, dice.choice(["en", "de", "", None])) for i, t in enumerate(texts)]
    docs += [(7, "again", "en"), (7, "again", "en"), (7, "again", "de"), (7, distinct, "en"), (None, "hot copy", "en"), (None, "alone", "xx"), (-3, "low", None), (9, "low", "en")]
    dice.shuffle(docs)
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in range(0, 60, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == walked(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    found = audited(spark, [(1, "a", None)], [])
    assert len(found) == 600 and found["", "ABCDE", 1]["removed"] == 1 and found["", "EDCBA", 5]["unique_fails"] == 1


@pytest.mark.parametrize("text, bits", [("", 1), ("A", 5), ("É É", 3), ("a#", 9)])
def test_bits(text, bits):
    assert audit.failed_bits(text) == bits
