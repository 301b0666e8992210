"""An exact join of texts by the Jaccard similarity of their word shingles.

Shingles are hashed into groups, and the counts of a set's shingles by group are its point. What two sets
share is at most the sum over the groups of the smaller count, and the same holds for boxes around
points: the tree's leaves are boxes of points, and a pair of leaves, and then a pair of points, is
looked at only if that sum allows the threshold. Survivors are verified on the shingles.

A point has about as many groups as its set has shingles, since with many shingles to a group any two sets
seem to share most of theirs. Points of different sizes meet at the smaller number of groups, to which
the larger one is folded.

Points of so many dimensions all lie far from one another, so boxes alone would let every pair
of leaves through. The upper level of the tree therefore cuts the sets exactly: sets that are
similar enough share one of their first shingles in any order common to all, so each of these is a cell.
Rare shingles come first, which keeps passages that very many texts share from making large cells.
A cell of few sets is a leaf. The sets of a larger one are sorted by place (size first, then the groups that hold
more than their share, sets already connected side by side) and cut into leaves.
Sets that do share much are first joined with the best connected set of their cells; what
that connects is not compared again, so a group of near copies costs no pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashwave.llm.common import discard, rows_per_batch, written
from hashwave.llm.components import connected_components
from hashwave.llm.shingles import Shingler
from hashwave.operators.joins import splittable_join
from hashwave.operators.numbering import numbered

#: Groups of the smallest points, and of boxes.
GROUPS = 64
#: The greatest count that a point tells, and the value that stands for any count from there on.
_MOST, _ANY = 15, 100
#: Rounds in which each set is tried with one other set, before all pairs still apart are looked at.
STARS = 2
#: Sets of a leaf, at most.
LEAF = 128
#: Pairs and counts looked at together.
_PAIRS, _COUNTS = 1 << 18, 1 << 22
#: The list of frequent shingles: at most so many, each in so many texts of one batch.
FREQUENT = 1 << 16
OFTEN = 5
_COUNTED = 1 << 20
_PART_BYTES = 1 << 21
#: Rows that go to Python at once. A pair of sets may be large, and a batch is held on both sides.
BATCH = 512
#: Bits of the two filters that tell a scan which rows matter; a full filter lets rows through.
KEY_BITS, DOC_BITS = 26, 24


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``_PART_BYTES`` of text, so that little is worked on at once."""
    ends = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + _PART_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _scan(docs: DataFrame, each, schema: str, width: int) -> DataFrame:
    """Runs over all texts; ``each`` makes record batches from (ids, sorted shingles of each text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        parts = (part for batch in batches for part in _parts(batch))
        yield from each((part.column(0).to_pylist(), shingler(part.column(1))) for part in parts)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _signed(values: np.ndarray) -> pa.Array:
    """Hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums that tell sets apart."""
    odd = (shingles ^ (shingles >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return shingles.sum(dtype=np.uint64), (odd ^ (odd >> np.uint64(32))).sum(dtype=np.uint64)


def _group_counts(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def _point(shingles: np.ndarray) -> bytes:
    """Group counts, most of them small and so in Huffman's code; the greatest stands for itself and all above."""
    groups = max(GROUPS, 1 << (len(shingles) - 1).bit_length())
    code = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS, strategy=zlib.Z_HUFFMAN_ONLY)
    return code.compress(np.minimum(_group_counts(shingles, groups), _MOST).astype(np.uint8).tobytes()) + code.flush()


def _place(shingles: np.ndarray) -> int:
    """Where a set comes among others: by size in steps, then by the groups that hold more than their share."""
    over = _group_counts(shingles, GROUPS)[:32] * GROUPS > len(shingles)
    return int(8 * np.log2(max(1, len(shingles)))) << 32 | int(np.packbits(over).view(">u4")[0])


class _Points:
    """The points of some sets, with their sizes."""

    def __init__(self, points: pa.Array, sizes: np.ndarray):
        held = [zlib.decompress(point, -zlib.MAX_WBITS) for point in points.to_pylist()]
        self.sizes, self.groups = sizes, np.array([len(counts) for counts in held], np.int64)
        self._row, self._tables = np.empty(len(held), np.int64), {}
        for groups in np.unique(self.groups).tolist():
            of = np.flatnonzero(self.groups == groups)
            counts = np.frombuffer(b"".join([held[i] for i in of.tolist()]), np.uint8).reshape(len(of), groups).copy()
            counts[counts == _MOST] = _ANY
            self._row[of], self._tables[groups] = np.arange(len(of)), counts

    def counts(self, of: np.ndarray, groups: int) -> np.ndarray:
        """The counts of some sets, folded to fewer groups where they have more."""
        found = np.empty((len(of), groups), np.uint8)
        for own in np.unique(self.groups[of]).tolist():
            at = np.flatnonzero(self.groups[of] == own)
            rows = self._tables[own][self._row[of[at]]]
            while rows.shape[1] > groups:
                half = rows.shape[1] // 2
                rows = np.minimum(rows[:, :half], 127) + np.minimum(rows[:, half:], 127)
            found[at] = rows
        return found

    def allow(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the points of the sets a and b, pair by pair, allow the similarity."""
        kept = np.zeros(len(a), bool)
        groups = np.minimum(self.groups[a], self.groups[b])
        for common in np.unique(groups).tolist():
            of = np.flatnonzero(groups == common)
            for at in np.array_split(of, -(-len(of) * common // _COUNTS)):
                least = np.minimum(self.counts(a[at], common), self.counts(b[at], common))
                shared = least.sum(axis=1, dtype=np.int64)
                kept[at] = _enough(shared, self.sizes[a[at]] + self.sizes[b[at]], percent) | (least.max(axis=1) >= _ANY)
        return kept


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """A row for each text (size, signature, point), and rows of shingles that one batch holds often."""

    def each(rows):
        held, size = [], 0

        def often() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= OFTEN
            n = int(many.sum())
            none = [pa.nulls(n, t) for t in (*[pa.int64()] * 5, pa.binary())]
            return pa.RecordBatch.from_arrays([*none, _signed(values[many]), pa.array(counts[many], pa.int64())], names)

        names = ["doc_id", "n", "s1", "s2", "place", "point", "often", "texts"]
        for ids, sets in rows:
            sizes, ones, twos, places, points = [], [], [], [], []
            for shingles in sets:
                one, two = _signature(shingles)
                sizes.append(len(shingles))
                ones.append(one)
                twos.append(two)
                places.append(_place(shingles))
                points.append(_point(shingles))
                held.append(shingles)
                size += len(shingles)
                if size >= _COUNTED:
                    yield often()
                    held, size = [], 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _signed(np.array(ones, np.uint64)), _signed(np.array(twos, np.uint64)),
                 pa.array(places, pa.int64()), pa.array(points, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                names,
            )
        if size:
            yield often()

    return _scan(docs, each, "doc_id long, n long, s1 long, s2 long, place long, point binary, often long, texts long", width)


def _frequent(summaries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in ascending order, with their places by frequency.

    A bounded list. Which shingles are on it changes what is fast and not what is found, as any order
    common to all sets is right.
    """
    counted = summaries.where("often is not null").groupBy("often").agg(F.sum("texts").alias("texts"))
    rows = counted.orderBy(F.desc("texts"), "often").limit(FREQUENT).collect()
    values = np.array([row.often for row in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(rows) - np.arange(len(rows)))[order]


def _prefixes(docs: DataFrame, percent: int, width: int, frequent: tuple, wanted: np.ndarray | None) -> DataFrame:
    """A row for each of the first shingles of each set: rare ones by hash, then frequent ones.

    Sets of similarity t and more share one of their first n - ceil(t n) + 1 shingles.
    """

    def each(rows):
        listed, places = frequent
        for ids, sets in rows:
            keys, owners, sizes, sums = [], [], [], []
            for doc_id, shingles in zip(ids, sets):
                n = len(shingles)
                if not n or doc_id is None:
                    continue
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, shingles), len(listed) - 1)
                    common = listed[at] == shingles
                    if common.any():
                        last = shingles[common][np.argsort(places[at[common]], kind="stable")]
                        shingles = np.concatenate([shingles[~common], last])
                key = shingles[: n - -(-percent * n // 100) + 1]
                total = _signature(shingles)[0]
                if wanted is not None:
                    key = key[_marked(wanted, key & np.uint64((1 << KEY_BITS) - 1))]
                keys.append(key)
                owners.append(np.full(len(key), doc_id, np.int64))
                sums.append(np.full(len(key), total, np.uint64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(keys)), pa.array(np.concatenate(owners)), _signed(np.concatenate(sums))],
                    ["key", "doc_id", "s1"],
                )

    return _scan(docs, each, "key long, doc_id long, s1 long", width)


def _bits(values: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits with those of the values set: of fixed size, however many there are."""
    low = F.col(values.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(low, 6).cast("int").alias("word")
    set_bits = values.select(word, F.expr(f"shiftleft(1L, cast({values.columns[0]} & 63 as int))").alias("bit"))
    rows = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return table.view(np.uint64)


def _marked(table: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sets(docs: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """The shingles of the wanted texts, and perhaps of a few more. Of other texts none are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(0)))
            low = batch.column(0).to_numpy() & ((1 << DOC_BITS) - 1)
            for part in _parts(batch.filter(pa.array(_marked(wanted, low.astype(np.uint64))))):
                sets = pa.array([shingles.tobytes() for shingles in shingler(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def _enough(shared, sizes, percent: int):
    """Whether so many shared shingles of sets with so many together make the similarity."""
    return 100 * shared >= percent * (sizes - shared)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points allow the similarity."""
    point = lambda side: points.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("point").alias(f"point_{side}"))
    both = pairs.join(point("a"), "a").where("n_a > 0").join(point("b"), "b")
    both = both.where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = pa.concat_arrays([batch.column("point_a"), batch.column("point_b")])
            sizes = np.concatenate([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()])
            rows = np.arange(batch.num_rows)
            kept = pa.array(_Points(points, sizes).allow(rows, rows + batch.num_rows, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "point_a", "point_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose sets are similar enough, stored. Only sets in pairs leave the scan of the texts."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = written(_sets(docs, width, _bits(ends, DOC_BITS)), "sets")
    side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(two.as_py(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(bool(_enough(shared, len(a) + len(b), percent)))
            kept = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    links = written(both.mapInArrow(run, "a long, b long"), "links")
    discard(pairs, sets)
    return links


def _sizes_near(n, m, percent: int):
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def _near(sets: pa.Table, pairs: Iterator[tuple[np.ndarray, np.ndarray]], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of rows whose sets lie in different components and whose points allow the similarity."""
    rep, component, n = (sets.column(c).to_numpy() for c in ("rep", "component", "n"))
    points = _Points(sets.column("point").combine_chunks(), n)
    for a, b in pairs:
        met = np.flatnonzero((component[a] != component[b]) & _sizes_near(n[a], n[b], percent))
        a, b = a[met], b[met]
        kept = points.allow(a, b, percent)
        a, b = rep[a[kept]], rep[b[kept]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _later(cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with the rows behind it in its cell, about ``_PAIRS`` at a time; the rows are sorted by cell."""
    behind = np.searchsorted(cells, cells, "right") - np.arange(len(cells)) - 1
    ends, low = np.cumsum(behind), 0
    while low < len(cells):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        a = np.repeat(np.arange(low, high), behind[low:high])
        first = ends[low:high] - behind[low:high] - done
        yield a, a + 1 + np.arange(len(a)) - np.repeat(first, behind[low:high])
        low = high


def _pairs_within(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of one leaf, for leaves of at most ``LEAF`` sets, each in a run of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held else table
            keys = table.column("key").to_numpy()
            if len(keys):
                last = int(np.searchsorted(keys, keys[-1], "left"))
                yield from _near(table.slice(0, last), _later(keys[:last]), percent)
                held = table.slice(last).combine_chunks()
        if held:
            yield from _near(held, _later(held.column("key").to_numpy()), percent)

    rows = members.select("key", "rep", "component", "n", "point").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long")


def _in_leaves(members: DataFrame) -> DataFrame:
    """The sets of large cells in leaves by place, each leaf with its box: ``top`` counts, sizes and components."""
    first = members.groupBy("key", "component").agg(F.min("place").alias("first"))
    by_place = numbered(splittable_join(members, first, ["key", "component"]), ["key"], ["first", "component", "rep"])
    sets = F.collect_list(F.struct("rep", "component", "n", "point")).alias("sets")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("n", "component") for f in (F.min, F.max)]
    leaves = by_place.groupBy("key", F.floor(F.col("number") / LEAF).alias("leaf")).agg(sets, *ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for sets in batch.column("sets"):
                n, point = (sets.values.field(c) for c in ("n", "point"))
                counts = _Points(point, n.to_numpy()).counts(np.arange(len(n)), GROUPS).max(axis=0).astype(np.int64)
                tops.append(np.where(counts >= _ANY, n.to_numpy().max(), counts))
            yield batch.append_column("top", pa.array(tops, pa.list_(pa.int64())))

    held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema)
    return leaves.mapInArrow(run, f"{held}, top array<bigint>")


def _pairs_across(leaves: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of two leaves of one cell whose boxes allow the similarity."""
    one, two = (leaves.select("key", *(F.col(c).alias(f"{c}_{s}") for c in leaves.columns if c != "key")) for s in "12")
    met = one.join(two, "key").where("leaf_1 < leaf_2")
    alike = "min_component_1 = max_component_1 and min_component_2 = max_component_2 and min_component_1 = min_component_2"
    met = met.where(f"not ({alike})")
    met = met.where(f"100 * max_n_1 >= {percent} * min_n_2 and 100 * max_n_2 >= {percent} * min_n_1")
    shared = "aggregate(zip_with(top_1, top_2, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)"
    met = met.where(f"100 * {shared} >= {percent} * (min_n_1 + min_n_2 - {shared})").select("sets_1", "sets_2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column("sets_1"), batch.column("sets_2")):
                sets = pa.concat_tables([pa.Table.from_struct_array(x.values) for x in (one, two)])
                left, right = len(one), len(two)
                pairs = np.repeat(np.arange(left), right), left + np.tile(np.arange(right), left)
                yield from _near(sets, iter([pairs]), percent)

    return met.mapInArrow(run, "a long, b long")


def _leaf_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components that meet in a cell and whose points allow the similarity.

    ``members`` has (key, size, component, rep, n, place, point) for cells of ``size`` sets in several components.
    """
    pairs = _pairs_within(members.where(F.col("size") <= LEAF), percent)
    large = members.where(F.col("size") > LEAF)
    if not large.isEmpty():
        leaves = written(_in_leaves(large), "leaves")
        inside = leaves.select("key", "leaf", F.inline("sets"))
        inside = inside.withColumn("key", F.xxhash64("key", "leaf")).drop("leaf")
        pairs = pairs.unionByName(_pairs_within(inside, percent)).unionByName(_pairs_across(leaves, percent))
    return pairs.distinct()


def _placed(cells: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of all cells with the component that the links so far put each set in."""
    parts = connected_components(links).withColumnRenamed("node", "rep")
    placed = splittable_join(cells, parts, ["rep"], "left").withColumn("component", F.coalesce("component", "rep"))
    return written(placed, "placed")


def _key() -> Column:
    """Tells rows apart by id and text; null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))))


def _ids_name_texts(docs: DataFrame) -> bool:
    """Whether no id has several texts."""
    keys = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(_key()).alias("x"), F.max(_key()).alias("y"))
    return keys.where("x != y").isEmpty()


def _by_key(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """``_key``, ``n`` and ``part``, the component by text alone, once for each key; and a row without key for each without id."""
    found = _similar(docs.select(_key().alias("doc_id"), "text"), percent, width)
    found = written(found.toDF("_key", "n", "part"), "keys")
    known = found.where("_key is not null").groupBy("_key").agg(F.min("n").alias("n"), F.min("part").alias("part"))
    return written(known.unionByName(found.where("_key is null")), "keys")


def similar_texts(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row with (doc_id, text).

    Texts link when their shingle sets have a Jaccard similarity of ``percent`` or more. Null, empty and
    blank texts have no shingles and link with nothing, nor do rows without an id. Rows that share an id
    are one node with the links of all of them. The component of a text without links is its own id.
    """
    if _ids_name_texts(docs):
        return _similar(docs, percent, width)
    keys = _by_key(docs, percent, width)
    rows = splittable_join(docs.select("doc_id", _key().alias("_key")).where("_key is not null"), keys, ["_key"])
    rows = written(rows.select("doc_id", "n", "part"), "rows")
    # Parts that share an id are one.
    first = rows.groupBy("doc_id").agg(F.min("part").alias("first"))
    whole = connected_components(splittable_join(rows, first, ["doc_id"]).select("part", "first")).toDF("part", "whole")
    rows = splittable_join(rows, whole, ["part"], "left").withColumn("whole", F.coalesce("whole", "part"))
    rows = written(rows, "rows")
    named = splittable_join(rows, rows.groupBy("whole").agg(F.min("doc_id").alias("component_id")), ["whole"])
    named = named.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = F.lit(None).cast("long")
    return named.unionByName(keys.where("_key is null").select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id")))


def _similar(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """As ``similar_texts``, where an id has one text."""
    with rows_per_batch(docs.sparkSession, BATCH):
        return _components(docs, percent, width)


def _components(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """All steps that use Python are run here; what is returned is a join of stored tables."""
    summaries = written(_summaries(docs, width), "summaries")
    texts = summaries.where("often is null")
    classes = texts.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    rows = splittable_join(texts.select("doc_id", "n", "s1", "s2"), classes, ["n", "s1", "s2"], "left")
    rows = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    rows = written(rows, "rows")

    frequent = _frequent(summaries)
    first = _prefixes(docs, percent, width, frequent, None).groupBy("key").agg(F.min("s1").alias("x"), F.max("s1").alias("y"))
    shared = _bits(first.where("x != y").select("key"), KEY_BITS)
    cells = _prefixes(docs, percent, width, frequent, shared).select("key", "doc_id")
    cells = cells.join(rows.where("rep is not null").select("doc_id", "rep").distinct(), "doc_id").groupBy("key", "rep").agg(F.lit(1).alias("one"))
    cells = written(cells.select("key", "rep"), "cells")

    # Tables are deleted as soon as nothing reads them any more.
    # The more of a set's first shingles others have too, the more of them can link with it: each set is
    # tried with the best of its cells, and those still apart with the best of another component.
    sizes = cells.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    several = written(splittable_join(cells, sizes, ["key"]), "several")
    discard(cells)
    scores = several.groupBy("rep").agg(F.sum("size").alias("score"))
    points = texts.select(F.col("doc_id").alias("rep"), "n", "place", "point").join(scores, "rep")
    points = points.groupBy("rep", "n", "place", (F.col("score") / F.col("n")).alias("score")).agg(F.first("point").alias("point"))
    points = written(points, "points")
    cells = written(splittable_join(several.select("key", "rep"), points.select("rep", "score"), ["rep"]), "cells")
    discard(summaries, several)
    links = cells.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    for _ in range(STARS):
        placed = _placed(cells, links)
        best = placed.groupBy("key").agg(F.max_by("rep", "score").alias("b"), F.max_by("component", "score").alias("c"), F.max("score").alias("best"))
        tried = splittable_join(placed, best, ["key"]).where("component != c")
        stars = tried.groupBy(F.col("rep").alias("a")).agg(F.max_by("b", "best").alias("b"))
        found, before = _verified(_bounded(stars, points, percent), docs, percent, width), links
        links = written(links.unionByName(found), "links")
        discard(placed, found, before)

    # What these have not connected meets in leaves. Cells with the same sets, as the shingles of one
    # shared passage make them, are one cell.
    placed = _placed(cells, links)
    discard(cells)
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("rep")).alias("h1"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("h2"),
    )
    mixed = mixed.where("x != y").groupBy("x", "y", "size", "h1", "h2").agg(F.min("key").alias("key")).select("key", "size")
    members = written(splittable_join(placed, mixed, ["key"]).drop("score").join(points.drop("score"), "rep"), "members")
    discard(placed, points)
    rest = _verified(_leaf_pairs(members, percent), docs, percent, width)
    discard(members)

    parts = connected_components(links.unionByName(rest)).withColumnRenamed("node", "rep")
    labelled = splittable_join(rows, parts, ["rep"], "left")
    return labelled.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")
    )


def _by_bits(held: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``_key`` is surely not among ``keys``, and all others, so that few texts are shuffled for a join.

    A broadcast table of 2**DOC_BITS bits tells, however many keys there are; a full table has all rows asked.
    """
    low = F.col("_key").bitwiseAND(F.lit((1 << DOC_BITS) - 1))
    bit, word = F.expr("shiftleft(1L, cast(_key & 63 as int))"), F.shiftright(low, 6).alias("_word")
    words = written(keys.select(word, bit.alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits")), "words")
    marked = held.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    asked = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(~asked).select("_key", "_row"), marked.where(asked).select("_key", "_row")


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of texts the smallest id stays.

    Only a text's copies and near copies take its place: texts that share an id and no more all stay. Of rows
    with the same id and text one stays, and of near copies with the same id the one with the smallest hash.
    Rows without an id, and texts without shingles, all stay.
    """
    if _ids_name_texts(docs):
        key, found = F.col("doc_id"), written(_similar(docs, percent, width), "components").toDF("_key", "n", "part")
        known = found.where("_key is not null and n > 0").groupBy("_key")
        known = known.agg(F.min("part").alias("part"), F.count("*").alias("copies")).withColumn("stays", F.col("_key") == F.col("part"))
    else:
        key, found = _key(), _by_key(docs, percent, width).where("_key is not null and n > 0").drop("n")
        rows = docs.select("doc_id", _key().alias("_key")).where("_key is not null")
        rows = rows.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        rows = written(rows.join(found, "_key"), "keys")
        best = rows.groupBy("part").agg(F.min(F.struct("doc_id", "_key")).getField("_key").alias("best"))
        known = splittable_join(rows, best, ["part"]).withColumn("stays", F.col("_key") == F.col("best"))
    known = written(known.select("_key", "copies", "stays"), "known")
    held = docs.select(key.alias("_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    taken_out = known.where("not stays or copies > 1").select("_key")
    alone, asked = _by_bits(held, taken_out)
    kept = alone.unionByName(asked.join(taken_out, "_key", "left_anti")).select("_row.*")
    repeated = known.where("stays and copies > 1").select("_key")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(asked.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*"))
