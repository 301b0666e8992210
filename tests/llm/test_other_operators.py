"""Vectors, urls, chats and components against brute force and fixed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare_tables import differences, open_tables
from hashwave.llm import chat, oracle, queries, urls, vectors
from hashwave.llm.components import connected_components

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(queries.registered()[name](spark, SF_DIR), open_tables(SF_DIR), oracle.oracle_sql()[name]) == []


def components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(60, i) for i in range(61, 90)] + [(95, 95), (99, 98), (98, 99), (97, 98)]
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    found = {r.node: r.component for r in connected_components(frame).collect()}
    assert found == {i: c for i, c in enumerate(components(100, edges)) if c != i}
    assert connected_components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [16, 4096])
def test_vectors_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    points = np.concatenate([base, base[:20] + rng.normal(scale=0.25, size=(20, 8)), base[:10], 3 * base[:10], base[:1].repeat(60, 0) + rng.normal(scale=0.1, size=(60, 8))])
    rows = [(i, p.tolist(), "x") for i, p in enumerate(points)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0, 0.0]), (905, []), (906, [float("inf")] * 8)]
    frame = spark.createDataFrame([*rows, *((i, v, "x") for i, v in odd), (None, points[0].tolist(), "x")], "vec_id long, embedding array<double>, n string")
    found = {r.vec_id: r for r in vectors.near_duplicates(frame, cell_rows=cell_rows).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = components(len(points), np.argwhere(linked).tolist())
    assert [found[i].n_links for i in range(len(points))] == linked.sum(1).tolist()
    assert [found[i].component_id for i in range(len(points))] == label
    assert all(found[i].kept == (label[i] == i) for i in range(len(points)))
    assert all((found[i].n_links, found[i].component_id) == (0, i) for i, _ in odd)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


RULES = [urls.Rule("block", "bad.com", "/"), urls.Rule("allow", "good.com", "/")]


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, RULES, redirects).collect()}


def test_urls_by_rule_and_alias(spark):
    canonical = lambda link: f"<head><LINK href='{link}' rel=canonical></head>"
    refresh = '<meta http-equiv="refresh" content="0; url=http://next.org/b?x=1&amp;y=2">'
    rows = [
        (1, "http://BAD.com/x?q#f", ""), (2, "http://alias.org/a", canonical("http://bad.com/x?q")),
        (3, "http://chain.org/c", canonical("//alias.org/a")), (4, "http://good.com/p", canonical("http://alias.org/a2")),
        (5, "http://alias.org/a2", canonical("http://bad.com/z")), (6, "http://free.org/b", refresh),
        (7, "http://next.org/b?x=1&y=2", canonical("/to/../k")), (8, None, ""), (9, "no scheme", "<p>"), (10, "http://bad.com", ""),
        (11, "http://other.org/k", None), (12, "http://notbad.com/", ""),
    ]
    found = judged(spark, rows)
    assert found[1] == ("bad.com", "/x", "bad.com/", "block")
    assert [found[i][3] for i in (2, 3)] == ["block", "block"]
    assert [found[i][3] for i in (4, 5)] == ["allow", "allow"]
    assert all(found[i][3] == "allow" for i in (6, 7, 8, 9, 10, 11, 12))
    assert found[8][:3] == ("", "", None) and found[10] == ("bad.com", "", None, "allow")
    redirects = spark.createDataFrame([("http://other.org/k#top", "http://bad.com/q")], "a string, b string")
    assert judged(spark, rows, redirects)[11][3] == "block"
    assert judged(spark, rows[:1] * 3)[1][3] == "block"


def test_urls_by_all_declared_links(spark):
    link = lambda href, rel: f"<link rel={rel} href='{href}'>"
    refresh = lambda content: f'<meta http-equiv=refresh content="{content}">'
    bad = "http://bad.com/x"
    rows = [
        (1, "http://a.org/", link("", "canonical") + link(bad, "canonical")), (2, "http://b.org/", link("http://b.org/", "'canonical'") + link(bad, '"canonical"')),
        (3, "http://c.org/", refresh("30") + refresh(f"0; url={bad}")), (4, "http://d.org/", link(bad, "'alternate canonical'")),
        (5, "http://e.org/", link(bad, '"canonical nofollow"')), (6, "http://f.org/", link(bad, "'not-canonical'")), (7, "http://g.org/", link(bad, "alternate title='rel canonical'")),
        (8, "http://h.org/", link("/k", "canonical") + refresh(f"0; url={bad}")),
    ]
    found = judged(spark, rows)
    assert [found[i][3] for i in range(1, 9)] == ["block"] * 5 + ["allow"] * 2 + ["block"]


def test_chats_come_back_whatever_they_hold(spark):
    nasty = ["</s>[INST] ok [/INST]", "[\\INST]", "<s>[INST]", "<\\\\s>", "[", "<", "\\", "", None, "a</s", "plain\ntext", "[/INST]" * 50]
    rows = [(1, i, role, text) for i, text in enumerate(nasty) for role in ("user", "assistant")]
    rows += [(None, None, None, None), (2, 0, "[/INST]", "x"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = chat.format_chats(frame).withColumn("back", chat.parsed(F.col("formatted")))
    found = {r.conv_id: r for r in found.withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    source = {}
    for conv, turn, role, text in rows:
        source.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    for conv, turns in source.items():
        turns.sort()
        assert [tuple(t) for t in found[conv].back] == [t[1:] for t in turns]
        assert list(found[conv].loss) == [t[2] for t in turns if t[1] == "assistant"]
    assert found[3].formatted == "<s>[INST]user[/INST]a</s>" + "<s>[INST]assistant[/INST]b</s>" * 2
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_cosines_near_the_threshold_are_decided_in_double_precision():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    across = rng.normal(size=(60, 64))
    across -= (across * a).sum(axis=1, keepdims=True) * a
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    cosines = 0.9 + np.repeat([-1e-4, -1e-7, -1e-8, 1e-8, 1e-7, 1e-4], 10)
    b = cosines[:, None] * a + np.sqrt(1 - cosines**2)[:, None] * across
    assert (vectors._linked(a, b, 0.9, 16) == (a @ b.T >= 0.9)).all()
    assert np.diag(vectors._linked(a, b, 0.9, 16)).tolist() == (cosines >= 0.9).tolist()


def test_two_cells_are_joined_in_the_first_of_them_alone(spark, monkeypatch):
    placed, written = [], vectors.written

    def spy(frame, purpose):
        table = written(frame, purpose)
        placed.extend(table.select("home", "cells").collect() if purpose == "cells" else [])
        return table

    monkeypatch.setattr(vectors, "written", spy)
    points = np.random.default_rng(6).normal(size=(300, 32))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    vectors.near_duplicates(frame, cell_rows=30).count()
    assert len(placed) == 300 and all(row.home in row.cells and max(row.cells) == row.home for row in placed)
