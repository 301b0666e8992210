"""Operators on texts against brute force, with nulls, blanks, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashwave.llm import bpe, html, jaccard, mixing, quality, token_counts, tokenfile
from hashwave.llm.common import tokenizer_path

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    None, "", "  ", "\n\n", "a", "A a A a A a A a", "x  y", " \n b\tc ", "don't WE'LL  go", "<|endoftext|>", "x  <|endoftext|>  y",
    "日本語　テキスト 1²Ⅷ", "é \x1c x\x85   z", "one two three four", "one two three four five", "🙂 " * 50, "same line\nsame line\n\nsame line", "word " * 3000,
    "a" * 5000, "#$% | & <b> " * 20,
]


def table(spark, texts, **columns):
    rows = [(i, t, *(c[i % len(c)] for c in columns.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in columns))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda texts: [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoding_equals_the_library_and_decodes(spark, library):
    docs = table(spark, ODD + ODD, ids=["kept?"], decoded=["kept?"])
    found = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).orderBy("doc_id").collect()
    assert [r.ids for r in found] == library(ODD + ODD)
    assert [r.decoded for r in found] == [t or "" for t in ODD + ODD]
    assert bpe.encode(docs.limit(0), tokenizer_path()).count() == 0
    both = bpe.round_trip(docs, tokenizer_path())
    assert both.columns == ["doc_id", "ids", "decoded"] and bpe.round_trip(docs.limit(0), tokenizer_path()).count() == 0
    again = both.orderBy("doc_id").collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in again] == [(r.doc_id, r.ids, r.decoded) for r in found]


def test_token_file_gives_places_checksums_and_single_ids(spark, library):
    docs = table(spark, ODD).union(spark.createDataFrame([(None, "null id"), (3, "a second row")], "doc_id long, text string"))
    folder = tokenfile.token_file(docs, tokenizer_path(), segment_ids=700, parts=3)
    segments = tokenfile.read_segments(spark, folder)
    found = tokenfile.read_documents(segments).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    everything = []
    for row in found:
        assert row.last_id == 0 and row.first_id == np.frombuffer(row.ids, "<u4")[0]
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert row.start == len(everything) and row.n_tokens == len(ids) and ids[-1] == 0
        everything += ids
    by_doc = {r.doc_id: r for r in found if r.doc_id not in (None, 3)}
    for i, ids in enumerate(library(ODD)):
        if i != 3:
            assert zlib.crc32(by_doc[i].ids) == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
    places = spark.createDataFrame([(p,) for p in [0, 1, 699, 700, len(everything) - 1, len(everything), None]], "place long")
    single = {r.place: r.id for r in tokenfile.tokens_at(segments, places, span=512).collect()}
    assert single == {p: everything[p] for p in (0, 1, 699, 700, len(everything) - 1)}
    many = spark.range(0, 60 * len(everything), 1, 7).select((F.col("id") % len(everything)).alias("place"))
    read = tokenfile.tokens_at(segments, many).groupBy("place").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y"))
    assert {r.place: (r.n, r.x, r.y) for r in read.collect()} == {p: (60, id, id) for p, id in enumerate(everything)}


def test_token_files_of_other_tokenizers_are_refused(tmp_path):
    import json

    spec = json.loads(open(tokenizer_path()).read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            tokenfile.library_encoder.__wrapped__(str(path))


def test_letters_and_marks_are_encoded_without_the_pattern(library):
    texts = ["ab***", " ab,", " Word).", " x#$%&*|", " a-b", " it's", " 'll", " end.'s", " caf\u00e9!", " a1!", " a! b", " \u0111\u00e0,", "a~", " tab\t!"]
    encoder = tokenfile.library_encoder.__wrapped__(tokenizer_path())
    assert [np.frombuffer(encoder(text), "<u4").tolist() for text in texts] == library(texts)
    plain = tokenfile.library_encoder.__wrapped__(tokenizer_path())
    assert plain("\n") == encoder("\n")  # kept for the end of lines
    plain._pre_tokens = None
    assert plain("ab*** cd,") == encoder("ab*** cd,")


def test_texts_are_encoded_together_and_each_piece_once(library):
    texts = ["", "ab cd, ab", " ab  cd \n\n ab", "ab\ncd\nab ", "cd caf\u00e9! \u00b2! a\u00b2, x_y", " \u00a0ab \tcd", "a<|endoftext|> ab\n", "ab " * 300]
    encoder = tokenfile.library_encoder.__wrapped__(tokenizer_path())
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_many(texts)] == library(texts)
    assert encoder.encode_many([]) == [] and encoder.encode_many([""]) == [b""]
    fresh, asked = tokenfile.library_encoder.__wrapped__(tokenizer_path()), []
    encode = fresh._spaced._encode
    fresh._spaced._encode = lambda piece: asked.append(piece) or encode(piece)
    long = "zzqzzq" * 20  # too long to be kept
    fresh.encode_many([f"ab {long} {long}", f"{long} {long}"])
    assert asked == [f" {long}"]


def test_direct_codes_of_many_levels():
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1, 7] * 300, np.uint32)
    codes = tokenfile.DirectCodes(*tokenfile.DirectCodes.pack(ids))
    assert (codes.all() == ids).all() and [codes[i] for i in range(len(ids))] == ids.tolist()
    places = np.random.default_rng(1).integers(0, len(ids), 40_000)
    assert (codes.at(places) == ids[places]).all() and len(codes.at(places[:0])) == 0
    assert len(tokenfile.DirectCodes(*tokenfile.DirectCodes.pack(ids[:0])).all()) == 0


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


def test_quality_counts_equal_brute_force(spark):
    found = quality.with_features(table(spark, ODD, n_words=["old"])).orderBy("doc_id").collect()
    assert [tuple(r[f] for f in quality.FEATURES) for r in found] == [brute_counts(t) for t in ODD]


def test_quality_model_is_estimated_from_votes_and_keeps_clean_rows(spark):
    clean = [" ".join(f"word{chr(97 + (i * j) % 23)}{chr(97 + j % 26)}x" for j in range(60 + i)) + "." for i in range(80)]
    clean = [re.sub(r"\d", "", t) for t in clean]
    junk = [t.replace(" ", "### ") for t in clean[:12]]
    docs = table(spark, clean + junk + [None, ""], _row=["clash"], n_words=["clash"])
    features = quality.with_features(docs.select("doc_id", "text"))
    kept = quality.keep_good(docs, features)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    ok = {r.doc_id for r in features.where(~quality.base_failed()).collect()}
    assert ids == {i for i in range(len(clean)) if i in ok}
    model = quality.fit(features.limit(0))
    assert model.good == 0.5 and set(model.on_good) == {0.5}


#: Votes of the 10,000 documents of sf0.1 by pattern, those of 2 and more documents.
VOTES = {
    (1, 1, 1, 1, 1, 1, 1): 7708, (-1, -1, 1, 1, 1, 0, 1): 330, (1, 1, 1, 0, 1, 1, 1): 290, (-1, -1, 1, 1, 1, 1, 1): 290, (1, 0, 1, 1, 1, 1, 1): 92,
    (1, 1, 1, 0, 0, 1, 1): 58, (1, -1, 1, 1, 1, 1, 1): 28, (1, 1, 1, -1, 0, 1, 1): 19, (-1, -1, 1, 1, 1, 0, -1): 13, (-1, -1, 1, 1, 0, 1, 1): 11,
    (-1, -1, 1, 0, 1, 0, 1): 9, (-1, -1, 1, 0, 0, 1, 1): 9, (-1, -1, 1, 0, 1, 1, 1): 7, (-1, -1, 1, 1, 1, 1, -1): 5, (1, 1, 1, -1, 1, 1, 1): 4,
    (1, 0, 1, 0, 1, 1, 1): 2, (-1, 0, 1, 1, 1, 1, 1): 2, (-1, -1, 1, 0, 0, 0, 1): 2,
}


@pytest.mark.parametrize("times", [0.1, 1, 1000])
def test_one_objecting_rule_does_not_decide_at_any_size(spark, times):
    model = quality.estimate({pattern: n * times for pattern, n in VOTES.items()})
    for rule in range(7):
        assert quality._posterior(model, tuple(-1 if i == rule else 1 for i in range(7))) >= 0.5
    assert all(quality._posterior(model, pattern) < 0.5 for pattern in VOTES if pattern[:2] == (-1, -1))


def test_marks_and_figures_are_no_objection(spark):
    hindi = "यह हिन्दी में लिखा हुआ एक साधारण लेख है और इसमें कई शब्द हैं। " * 5
    phones = "Call us at 5550199 or 5550142 before 1830 in room 12 of house 7. " * 5
    found = quality.with_features(table(spark, [hindi, phones, "#$% | & <b> " * 20])).orderBy("doc_id")
    assert [r.vote for r in found.select(quality.votes()[1].alias("vote")).collect()] == [1, 1, -1]


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(texts, percent=80):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= percent * len(a | sets[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def near_copies(n=240, seed=5, least=3):
    """Chains of edited texts, shared passages, and texts at the border of the similarity."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    passage, texts = [word() for _ in range(40)], []
    for i in range(n):
        if i % 3 and texts:
            words = texts[int(rng.integers(len(texts)))].split()
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = word()
        else:
            words = [word() for _ in range(int(rng.integers(least, 90)))]
            words += passage if i % 2 else []
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("stars", [0, 2])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, stars):
    monkeypatch.setattr(jaccard, "STARS", stars)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    texts = near_copies() + ODD
    found = jaccard.similar_texts(table(spark, texts, component=["clash"])).orderBy("doc_id").collect()
    sizes, components = brute_components(texts)
    assert [r.n_shingles for r in found] == sizes
    assert [r.component_id for r in found] == components


def test_jaccard_on_empty_tables_null_ids_and_repeats(spark):
    assert jaccard.similar_texts(table(spark, ["a"]).limit(0)).count() == 0
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (2, None)], "doc_id long, text string")
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_texts(docs).collect())
    assert found == [("2", 0, "2"), ("5", 3, "5"), ("5", 3, "5"), ("9", 3, "5"), ("None", 3, "None")]
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(docs).collect()) == ["2", "5", "None"]


def test_jaccard_keeps_different_texts_of_one_id(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "x y z u v w"
    rows = [(3, a), (5, a), (5, b), (5, ""), (5, None), (7, c), (7, c), (9, c), (None, b), (11, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = lambda rows: sorted((str(r.doc_id), str(r.text)) for r in rows)
    expected = sorted([("3", a), ("5", b), ("5", ""), ("5", "None"), ("7", c), ("None", b)])
    assert text(jaccard.one_of_each(docs).collect()) == expected
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_texts(docs).collect())
    assert found == sorted([("3", 3, "3"), ("5", 3, "3"), ("5", 2, "3"), ("5", 0, "3"), ("5", 0, "3"), ("7", 2, "7"), ("7", 2, "7"), ("9", 2, "7"), ("None", 2, "None"), ("11", 2, "3")])
    empty = spark.createDataFrame([(1, ""), (1, None), (1, " "), (2, "")], "doc_id long, text string")
    assert jaccard.one_of_each(empty).count() == 4


def test_mix_reaches_targets_and_repeats_rows(spark):
    texts = [" ".join(["w"] * (1 + i % 7)) for i in range(900)] + [None, ""]
    docs = table(spark, texts, source=["b", "a", None], rate=["clash"], size=["clash"])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    again = mixing.mix(docs.repartition(7))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.size()).alias("n")).collect()}
    for row in mixing.source_targets(docs.select("source", mixing.size().alias("size"))).collect():
        assert abs(taken[row.source] - row.target) <= 7
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_misses_targets_by_one_document_at_most(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    for seed in ("mix-1", "another"):
        rows = mixing.sized(docs, "doc_id", seed=seed)
        taken = mixing.times(rows, seed).drop("source")
        by_source = rows.join(taken, "key").groupBy("source").agg(
            F.sum(F.col("size") * F.col("times")).alias("n"), F.max("size").alias("most"), F.min("target").alias("target")
        )
        found = by_source.collect()
        assert len(found) > 3
        assert all(abs(r.n - r.target) <= r.most + 1e-6 for r in found)


def test_mix_takes_each_document_at_its_rate(spark):
    docs = table(spark, [" ".join("w" * n) for n in (1, 2, 3, 5, 8, 13, 300)], source=["a", "b"]).select("doc_id", "source", "text")
    rate = {r.source: r.rate for r in mixing.source_targets(docs.select("source", mixing.size().alias("size"))).collect()}
    chances = [mixing._fraction(F.concat(F.lit("offset:"), F.lit(s)), f"seed-{i}").alias(f"{s}{i}") for s in "ab" for i in range(400)]
    offsets = spark.range(1).select(*chances).first().asDict()
    for source, n in (("a", 4), ("b", 3)):
        fraction = rate[source] % 1
        for k in range(n):
            taken = [int((k + 1) * fraction + offsets[f"{source}{i}"]) - int(k * fraction + offsets[f"{source}{i}"]) for i in range(400)]
            assert abs(sum(taken) / 400 - fraction) < 0.1


def test_mix_of_rows_without_ids_and_of_repeated_rows(spark):
    rows = [(None, "a", "x y"), (None, "a", "z"), (None, None, None), (1, "a", "x y"), (1, "a", "x y"), (1, "a", "other words here"), (2, None, ""), (3, "b", "w " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("times", F.lit("clash")).withColumn("_key", F.lit(0))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    assert all(n <= 2 * rows.count((d, s, t)) for d, s, t in rows for n in [counts.get((d, t), 0)])
    assert counts.get((1, "x y"), 0) % 2 == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000], [5], [0, 0], [3, 0, 50, 7, 7, 7, 900]])
def test_source_targets_equal_repeated_resharing(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    found = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    weights, left, target = [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_ and left > 1e-9:
        share = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if share * weights[i] >= 2 * sizes[i]}
        for i in full or open_:
            target[i] = 2.0 * sizes[i] if full else share * weights[i]
            left -= target[i]
        open_ = open_ - full if full else set()
    assert found == pytest.approx({f"s{i}": t for i, t in enumerate(target)})


def test_token_rollup_counts_each_batch_once(spark, tmp_path):
    files = {"v1": tokenizer_path("byte_bpe_50k.tiktoken")}
    docs = table(spark, ODD, source=["a", None], lang=["en"], n_v1=["clash"])
    counts = token_counts.count_tokens(docs, files)
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit(token_counts.inserts(counts, "v1", "n_v1"), "1")
    assert not rollup.commit(token_counts.inserts(counts, "v1", "n_v1"), "1")
    total = lambda: {r.source: (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    whole = total()
    assert sum(n for n, _ in whole.values()) == len(ODD)
    rollup.commit(token_counts.revisions(counts, ("v1", "n_v1"), ("v2", "n_v1")), "2")
    rollup.compact()
    assert {r.tokenizer for r in rollup.totals().collect()} == {"v2"} and total() == whole
    rollup.commit(token_counts.deletes(counts, "v2", "n_v1"), "3")
    assert total() == {}


def test_token_totals_equal_the_library(spark, tmp_path):
    """Whole documents, counted by the library one by one, through inserts, deletes, revisions and repeated batches."""
    import base64

    import tiktoken

    files = {v: tokenizer_path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, None), (-2, None, "en", "  odd \n\t text's  ")], docs.schema))
    rows = docs.collect()
    library = {}
    for version, path in files.items():
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(path, "rb"))}
        encoding = tiktoken.Encoding("whole", pat_str=token_counts.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        library[version] = {r.doc_id: len(encoding.encode_ordinary(r.text or "")) for r in rows}
    counts = token_counts.count_tokens(docs, files)
    old, new = files
    gone, again = (F.pmod("doc_id", F.lit(3)) == n for n in (0, 1))
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "totals"), fold_every=2)
    batches = [
        token_counts.inserts(counts, old, f"n_{old}"),
        token_counts.deletes(counts.where(gone), old, f"n_{old}"),
        token_counts.revisions(counts.where(again), (old, f"n_{old}"), (new, f"n_{new}")),
    ]
    for n, changes in enumerate(batches):
        assert rollup.commit(changes, f"run-{n}") and not rollup.commit(changes, f"run-{n}")
    expected = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        if r.doc_id % 3:
            version = new if r.doc_id % 3 == 1 else old
            expected[r.source, r.lang, version][0] += 1
            expected[r.source, r.lang, version][1] += library[version][r.doc_id]
    found = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in rollup.totals().collect()}
    assert found == dict(expected)
    assert token_counts.TokenRollup(spark, str(tmp_path / "none")).totals().count() == 0


def test_rollup_folders_have_few_files(spark, tmp_path):
    """Each file written by Hadoop's local file system starts a process; a folder has as many as there are parts, not shuffle partitions."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        docs = spark.range(400).select(F.concat(F.lit("s"), F.pmod("id", F.lit(100))).alias("source"), F.lit("en").alias("lang"), F.col("id").alias("n"))
        rollup = token_counts.TokenRollup(spark, str(tmp_path / "files"), parts=3)
        for batch in ("1", "2"):
            assert rollup.commit(token_counts.inserts(docs, "v1", "n"), batch)
        rollup.compact()
        folders = list((tmp_path / "files" / "data").iterdir())
        assert len(folders) == 3 and all(1 <= len(list(f.glob("part-*"))) <= 3 for f in folders)
        found = {r.source: (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
        assert found == {f"s{i}": (8, 2 * (4 * i + 600)) for i in range(100)}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_one_counter_counts_for_all_tokenizers():
    """Against the library on whole texts; a piece is counted once for both files, and pieces are bounded by number."""
    import base64

    import tiktoken

    files = tuple(tokenizer_path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    texts = ["", " ", "\n", "a\n\nb", " \t x\r\n\n y  ", "x" * 300, "ab1" * 99, "\n " * 50 + "é", "don't it's", "漢字 " * 70, "a" * 64 + " " + "b." * 33, "z\x1c q\u2028w"]
    texts += [f"word{i} rare {i},{i}" for i in range(500)]
    counter = token_counts.rank_counter(files)
    small = token_counts.PieceCounter(counter._counts, most=50)
    for n, path in enumerate(files):
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(path, "rb"))}
        encoding = tiktoken.Encoding("whole", pat_str=token_counts.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        whole = [len(encoding.encode_ordinary(t)) for t in texts]
        assert [counter.per_tokenizer(t)[n] for t in texts] == whole == [small.per_tokenizer(t)[n] for t in texts]
    assert len(small._spaced) <= 50 and len(small._spaced._old) <= 50


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="ad">Buy this, now. It is cheap, and good.</div>
<article><h1>The &amp; title</h1><p>First paragraph, with <b>bold</b> and <a href=x>a link</a>. It goes
on, and on.<br>A line.<p>Second paragraph, unclosed, 1 < 2. And more of it, still.</p><aside>See also, here.</aside>
<form>Name <input></form></article><section id="comments"><p>I think, that this is long, very long. Long, long comment, indeed, it is. And so on, and on, and on.</p></section>
<footer>&copy; us.</footer></body></html>"""


def test_main_text_of_a_page(spark):
    expected = "The & title\nFirst paragraph, with bold and a link. It goes on, and on. A line.\nSecond paragraph, unclosed, 1 < 2. And more of it, still."
    pages = [PAGE, PAGE, None, "", "plain text", "<p></p>", "<!-- <p>x</p>", "<a href='"]
    rows = spark.createDataFrame([(i, p, "old") for i, p in enumerate(pages)], "page_id long, html string, text string")
    found = [r.text for r in html.extract_text(rows).orderBy("page_id").collect()]
    assert found[:6] == [expected, expected, "", "", "plain text", ""] and found[6] == ""
    long = "<body><article>" + "<p>Some words, again.</p>" * 5000 + "</article>"
    assert html.main_text(long).count("\n") == 4999


LONG = "A sentence of the article, with some words, and commas. It goes on for a while, as sentences do. " * 3
SHORT = "Short, but part of it."
LINKS = "<div><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>"


@pytest.mark.parametrize(
    "body",
    [
        f"<article><header><h1>Title</h1><p>Lede</p></header><div class=body>{f'<p>{LONG}</p>' * 4}</div></article>",
        f"<div><header><h1>Title</h1><p>Lede</p></header><div class=body>{f'<p>{LONG}</p>' * 4}</div></div>",
        f"<div><section>{f'<p>{LONG}</p>' * 7}</section><section><h2>More</h2>{f'<p>{LONG}</p>' * 3}<p>{SHORT}</p></section></div>",
        f"<div><div>{f'<p>{LONG}</p>' * 7}</div><section><blockquote>{LONG[:99]}</blockquote><p>{SHORT}</p></section></div>",
        *(f"<div><p>{LONG}</p><p>{SHORT}</p><{tag}>{LONG * 20}</{tag}><p>{LONG}</p></div>" for tag in ("blockquote", "pre", "h1")),
        f"<div><p>{LONG}</p><table><tr><td>{LONG * 20}</td><td>{SHORT}</td></tr></table><p>{LONG}</p></div>",
        f"<div><div><p>{LONG}</p></div><div><pre>{LONG * 50}</pre></div></div>",
        f"<p>{LONG}<a href=x>a link</a> and more.</p><p>{LONG}</p>",
    ],
)
def test_main_text_is_the_whole_article(body):
    words = re.sub("<[^>]*>", " ", body).split()
    assert html.main_text(f"<html><body>{LINKS}{body}{LINKS}</body></html>").split() == words


@pytest.mark.parametrize(
    "opening",
    [
        "<div class='site-content sidebar-right'>", "<div class='layout with-sidebar'>", "<main id='content-menu-wrapper'>", "<article class='post no-comments'>",
        "<article class='post social-share'>", "<div class='newsletter-issue'>", "<div class=newsletter>", "<form id=aspnetForm>", "<section class='post social-share'>",
    ],
)
def test_marks_on_what_holds_the_content_are_ignored(opening):
    closing = f"</{opening[1:].split()[0]}>"
    part = f"{opening}<h1>Title</h1><p>{LONG}</p><p>{SHORT}</p><div class=related>See also this, and that, too.</div><p>{LONG}</p>{closing}"
    article = f"Title\n{LONG.strip()}\n{SHORT}\n{LONG.strip()}"
    page = f"<body><nav><a href=/>Home</a></nav><div class=ad>Buy this, now.</div>{part}{{}}<footer>Us, and them.</footer></body>"
    assert html.main_text(page.format("")) == article
    assert html.main_text(page.format(part)) == f"{article}\n{article}"


PROSE = "One more sentence that is no part of the article, as it stands beside it and speaks of something else."


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{{}}</article><div class=gdpr-bar>{PROSE}</div>",
        f"<article>{{}}</article><div class=plain-bar>{PROSE}</div>",
        f"<article>{{}}</article><div class=discussion><p>{LONG}</p><p>{LONG}</p></div>",
        f"<div class=post>{{}}</div><div class=plain-bar>{PROSE}</div>",
        f"<article>{{}}{LINKS}</article>",
        f"<div class=post>{{}}{LINKS}</div>",
    ],
)
def test_what_stands_beside_the_article_is_left_out(page):
    text = f"<h1>Title</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p>"
    expected = f"Title\n{LONG.strip()}\n{SHORT}\n{LONG.strip()}"
    assert html.main_text(f"<body><div><a href=/>Site</a></div>{page.format(text)}<div><a href=/x>About</a></div></body>") == expected


def test_links_between_parts_of_an_article_are_left_out():
    page = f"<div id=wrap><div><h1>Title</h1><p>{LONG}</p></div>{LINKS}<div><p>{LONG}</p><p>{SHORT}</p></div></div>"
    assert html.main_text(f"<body>{page}</body>") == f"Title\n{LONG.strip()}\n{LONG.strip()}\n{SHORT}"


def test_a_paragraph_of_links_as_long_as_content_stays():
    page = f"<article><p>{LONG}</p><p><a href=x>{LONG}</a></p><h2><a href=y>More</a></h2><p>{LONG}</p></article>"
    assert html.main_text(page) == f"{LONG.strip()}\n{LONG.strip()}\nMore\n{LONG.strip()}"


def test_marked_pages_have_text_and_comments_are_left_out():
    assert html.main_text("<nav>Only, this.</nav>") == "Only, this."
    assert html.main_text("<div class=ad>One.</div><footer>Two.</footer>")
    assert html.main_text(f"<main><h1>Title</h1><div class=newsletter><p>{LONG}</p></div></main><footer>Us.</footer>") == f"Title\n{LONG.strip()}"
    page = f"<article><p>{LONG}</p></article><div id=comments>{f'<div class=comment><p>{LONG}</p></div>' * 3}</div>"
    assert html.main_text(page) == LONG.strip()


def test_pipeline_stages_agree_with_their_operators(spark):
    import corpus_pipeline

    texts = [f"{t}." for t in near_copies(60, least=60)]
    docs = table(spark, texts, lang=["en"], source=["a", "b"]).withColumn("n_chars", F.length("text").cast("long"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
    final = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    digest = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    rows = final.collect()
    assert rows and all(r.decoded_sha256 == digest[r.doc_id] for r in rows)
    good = corpus_pipeline.good_quality(spark, docs, "")
    sizes, components = brute_components([r.text for r in good.orderBy("doc_id").collect()])
    ids = [r.doc_id for r in good.orderBy("doc_id").collect()]
    single = corpus_pipeline.without_near_copies(spark, good, "")
    assert {r.doc_id for r in single.collect()} == {ids[c] for c in components}
