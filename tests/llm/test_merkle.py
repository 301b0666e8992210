"""The Merkle manifest against trees built and folded whole."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hashwave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    read = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(read, row))


def climb(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def siblings(levels, at, arity):
    """Of one path, for each level those on the left and on the right."""
    out = []
    for nodes in levels[:-1]:
        low = at - at % arity
        out.append((nodes[low:at], nodes[at + 1 : low + arity]))
        at //= arity
    return out


def proved(docs, changed, arity):
    """The rows that the operator gives, from trees in memory."""
    langs = sorted({d[2] for d in docs}, key=lambda v: (v is not None, (v or "").encode()))
    order = {}
    for lang in langs:
        of = [(d, leaf(d)) for d in docs if d[2] == lang]
        order[lang] = sorted(of, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {lang: climb([digest for _, digest in order[lang]], arity) for lang in langs}
    top = climb([trees[lang][-1][0] for lang in langs], arity)
    out = []
    for k, lang in enumerate(langs):
        for i, (doc, digest) in enumerate(order[lang]):
            path = siblings(trees[lang], i, arity) + siblings(top, k, arity)
            folded = leaf(changed(doc))
            for before, after in path:
                folded = h(*before, folded, *after)
            proof = h(*(x for before, after in path for x in [*before, *after]))
            root = top[-1][0]
            out.append((doc[0], lang, digest, trees[lang][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def longer(doc):
    return (*doc[:3], None if doc[3] is None else doc[3] + 1, doc[4]) if doc[0] is not None and doc[0] % 3 == 0 else doc


def given(spark, docs, arity):
    frame = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA).repartition(5)
    leaves = merkle.document_leaves(frame, F.col("doc_id") % 3 == 0, n_chars=F.col("n_chars").cast("decimal(19,0)") + 1)
    return sorted((tuple(r) for r in merkle.manifest(leaves, arity).proofs("changed").collect()), key=str)


def documents(seed, n):
    dice = random.Random(seed)
    langs = ["en"] * 8 + ["de", "é", "z", "", None]
    docs = [(i, dice.choice(["a", None]), dice.choice(langs), dice.choice([5, None]), f"text {i} é") for i in dice.sample(range(10 * n), n)]
    docs += [docs[0], docs[0], (docs[0][0], "other", *docs[0][2:]), (None, None, "en", None, None), (None, None, None, 1, "")]
    return docs + [(-4, "s", "alone", 1 << 62, "long " * 100_000), (0, "s", "en", (1 << 63) - 1, "-"), (3, "", "two", 1, ""), (4, "", "two", 1, "")]


@pytest.mark.parametrize("arity, block, n", [(2, 1024, 60), (2, 4, 90), (3, 9, 70), (2, 2, 33)])
def test_same_as_whole_trees(spark, monkeypatch, arity, block, n):
    monkeypatch.setattr(merkle, "BLOCK_NODES", block)
    docs = documents(arity + n, n)
    assert given(spark, docs, arity) == proved(docs, longer, arity)


@pytest.mark.parametrize("n", [1, 2])
def test_few_documents(spark, n):
    docs = [(3 * i, "s", "en", 1, "t") for i in range(n)]
    assert given(spark, docs, 2) == proved(docs, longer, 2)


def test_empty_table(spark):
    assert given(spark, [], 2) == []
    leaves = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert merkle.manifest(leaves).root is None


def test_states_before_each_slot():
    nodes = [h(str(i)) for i in range(7)]
    tree = merkle.Subtree(nodes, 3, 2)
    for i in range(7):
        replaced = [*nodes[:i], h("new"), *nodes[i + 1 :]]
        assert tree.folded(i, h("new")) == climb(replaced, 2)[-1][0] != tree.top
        assert tree.folded(i, nodes[i]) == tree.top
