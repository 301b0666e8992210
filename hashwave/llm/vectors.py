"""Near duplicates among embeddings: an exact metric range join.

Cosine of at least t between two vectors is a chord of at most sqrt(2 - 2t) between their directions.
Pivots cut the directions into cells of what is nearest to each. A direction is a member of its own
cell, and a visitor of every other cell that could hold a partner: by the triangle inequality a
point nearer to pivot c than to pivot h is at least (d(x, c)^2 - d(x, h)^2) / (2 d(c, h)) away from x.
So each vector finds all its partners within its own cell, and cells are joined independently. Two vectors
of different cells border on each other's; they are compared in the first of the two cells alone, and count for both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashwave.llm.common import written
from hashwave.llm.components import connected_components
from hashwave.operators.joins import splittable_join

#: Rounding of a chord; a cosine this close to the threshold is computed again.
_SLACK = 1e-9
#: Cosines computed again together.
_AGAIN = 1 << 14


def _directions(vectors: pa.Array) -> np.ndarray:
    """Unit vectors as rows, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def valid(vector: str) -> F.Column:
    """Whether a vector has a direction: not null, not all zero, every component finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(
        F.forall(vector, lambda v: F.coalesce(finite(v), F.lit(False))) & F.exists(vector, lambda v: v != 0),
        F.lit(False),
    )


def _pivots(classes: DataFrame, n_pivots: int) -> np.ndarray:
    """A bounded sample in hash order. Any pivots give the same links."""
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(n_pivots).select("vector").collect()
    return _directions(pa.array([row.vector for row in rows], pa.list_(pa.float64())))


def _cells(classes: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """Adds each vector's own cell and all cells that it takes part in."""
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            squared = 2 - 2 * _directions(batch.column("vector")) @ pivots.T
            home = squared.argmin(axis=1)
            ahead = squared - squared[np.arange(len(home)), home][:, None]
            apart = 2 * between[home]
            # Equal pivots border everywhere.
            takes_part = ahead <= (radius + _SLACK) * apart + _SLACK
            takes_part[np.arange(len(home)), home] = True
            cells = [np.flatnonzero(row).tolist() for row in takes_part]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                [*batch.schema.names, "home", "cells"],
            )

    schema = classes.select("*", F.lit(0).alias("home"), F.array(F.lit(0)).alias("cells")).schema
    return classes.mapInArrow(assign, schema)


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges (row, column) that connect what a matrix of links connects, at most one for each row and column."""
    new_row, new_column = linked.any(axis=1), linked.any(axis=0)
    for start in np.flatnonzero(new_row):
        if not new_row[start]:
            continue
        rows = np.array([start])
        new_row[start] = False
        while len(rows):
            columns = np.flatnonzero(new_column & linked[rows].any(axis=0))
            if not len(columns):
                break
            new_column[columns] = False
            yield from zip(rows[linked[np.ix_(rows, columns)].argmax(axis=0)], columns)
            found = np.flatnonzero(new_row & linked[:, columns].any(axis=1))
            new_row[found] = False
            yield from zip(found, columns[linked[np.ix_(found, columns)].argmax(axis=1)])
            rows = found


def _linked(a: np.ndarray, b: np.ndarray, cosine: float, step: int) -> np.ndarray:
    """Which rows of a link with which of b, in double precision.

    Sums in single precision are off by the length times half a unit in the last place at most, and by a little for the
    rounded components; only cosines that this leaves open are computed in double precision.
    """
    off = (a.shape[1] + 8) * 2.0**-24 + _SLACK
    short, across = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    linked = np.zeros((len(a), len(b)), bool)
    for i in range(0, len(a), step):
        cosines = short[i : i + step] @ across
        linked[i : i + step] = cosines >= np.float32(cosine + 2 * off)
        left_open = cosines >= np.float32(cosine - 2 * off)
        left_open ^= linked[i : i + step]
        xs, ys = np.nonzero(left_open)
        for low in range(0, len(xs), _AGAIN):
            x, y = i + xs[low : low + _AGAIN], ys[low : low + _AGAIN]
            again = np.einsum("ij,ij->i", a[x], b[y])
            linked[x, y] = again >= cosine
            for k in np.flatnonzero(np.abs(again - cosine) < _SLACK):
                # The sum in one order, whichever side a vector is on.
                linked[x[k], y[k]] = math.fsum(a[x[k]] * b[y[k]]) >= cosine
    return linked


def _join_block(cosine: float, step: int = 512):
    """The join of one block: rows at home against members of the cell. What is found counts for both."""

    def run(table: pa.Table) -> pa.Table:
        at_home, neighbour = (np.array(table.column(c).to_pylist(), bool) for c in ("at_home", "neighbour"))
        rep = table.column("rep").to_numpy()
        weight = table.column("n").to_numpy().astype(np.int64)
        points = _directions(table.column("vector").combine_chunks())
        a, b = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        linked = _linked(points[a], points[b], cosine, step)
        # Of two vectors at home here, each meets the other.
        near = np.flatnonzero(~neighbour[b])
        linked[:, near] &= rep[a][:, None] < rep[b[near]]
        x, y = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked, a, b = linked[np.ix_(x, y)], a[x], b[y]
        pairs = [(rep[a[i]], rep[b[j]]) for i, j in _forest(linked)]
        nodes = [*rep[a].tolist(), *rep[b].tolist(), *(int(x) for x, _ in pairs)]
        links = [*(linked @ weight[b]).tolist(), *(weight[a] @ linked).tolist()]
        return pa.table(
            {
                "node": pa.array(nodes, pa.int64()),
                "links": pa.array([*links, *[None] * len(pairs)], pa.int64()),
                "other": pa.array([*[None] * len(links), *(int(y) for _, y in pairs)], pa.int64()),
            }
        )

    return run


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.9,
    cell_rows: int = 2048,
    most_pivots: int = 1024,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Equal vectors are one class that is joined once; its copies are linked with one another. The number
    of pivots grows with the classes up to ``most_pivots``; a cell with more rows is dealt into blocks of
    ``cell_rows`` at home against four times as many members, so no task grows with the input. Blocks give
    counts and a spanning forest, never all pairs.

    Vectors without a direction (null, zero, or with null or non-finite components) and rows
    without an id link with nothing; vectors of different lengths do not meet. A row without links is
    its own component. Rows that share an id are one node with the links of all of them. Other
    columns are ignored.
    """
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = rows.where(F.col("vec_id").isNotNull() & valid("vector"))
    by_vector = good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = written(by_vector.withColumn("length", F.size("vector")), "classes")

    found = []
    for length, n in sorted(tuple(r) for r in classes.groupBy("length").count().collect()):
        alike = classes.where(F.col("length") == length)
        pivots = _pivots(alike, min(most_pivots, max(1, math.ceil(n / cell_rows))))
        placed = _cells(alike, pivots, math.sqrt(2 - 2 * cosine))
        placed = written(placed.withColumn("cells", F.filter("cells", lambda c: c <= F.col("home"))), "cells")
        # One row for each pivot.
        homes = dict(placed.groupBy("home").count().collect())
        members = dict(placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect())
        cells = range(len(pivots))
        home_blocks = F.array(*(F.lit(math.ceil(homes.get(c, 0) / cell_rows)) for c in cells))
        member_blocks = F.array(*(F.lit(math.ceil(members.get(c, 0) / (4 * cell_rows))) for c in cells))
        shuffled = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
        blocks = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        own = (
            placed.withColumn("cell", F.col("home"))
            .withColumn("_h", F.get(home_blocks, F.col("cell")))
            .withColumn("_m", F.get(member_blocks, F.col("cell")))
            .select("cell", shuffled(1, F.col("_h")).alias("h"), blocks(F.col("_m")).alias("m"), "rep", "n", "vector", F.lit(True).alias("at_home"), F.lit(False).alias("neighbour"))
        )
        guests = (
            placed.withColumn("cell", F.explode("cells"))
            .withColumn("_h", F.get(home_blocks, F.col("cell")))
            .withColumn("_m", F.get(member_blocks, F.col("cell")))
            .where("_h > 0")
            .select("cell", blocks(F.col("_h")).alias("h"), shuffled(2, F.col("_m")).alias("m"), "rep", "n", "vector", F.lit(False).alias("at_home"), (F.col("cell") != F.col("home")).alias("neighbour"))
        )
        joined = own.unionByName(guests).groupBy("cell", "h", "m")
        found.append(written(joined.applyInArrow(_join_block(cosine), "node long, links long, other long"), "links"))

    nodes = classes.select("rep", (F.col("n") - 1).alias("links"))
    edges = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    for part in found:
        nodes = nodes.unionByName(part.where("links is not null").select(F.col("node").alias("rep"), "links"))
        edges = edges.unionByName(part.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = nodes.groupBy("rep").agg(F.sum("links").alias("n_links"))
    parts = connected_components(edges).withColumnRenamed("node", "rep")
    by_class = classes.select("vector", "rep").join(links, "rep").join(parts, "rep", "left")
    by_class = by_class.select("vector", "n_links", F.coalesce("component", "rep").alias("_component"))
    usable = F.when(F.col("vec_id").isNotNull() & valid("vector"), F.col("vector")).alias("vector")
    return splittable_join(rows.select("vec_id", usable), by_class, ["vector"], "left").select(
        F.col("vec_id").alias(id),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("_component", "vec_id")).alias("kept"),
    )
