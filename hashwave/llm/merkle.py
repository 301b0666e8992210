"""A Merkle manifest of a table, one tree per language below one root.

Leaves are numbered by key over ranges, and subtrees of a bounded number of nodes are built by tasks of their own,
round by round, each round over so many times fewer nodes. On the way down every subtree learns what lies beside
the path from it to the root. Its parents keep a copy of the hash state before each child's slot, so
a changed leaf is folded in by resuming the state at its slot with the new digest and its right siblings alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashwave.llm.common import written
from hashwave.operators.numbering import numbered

#: At most so many nodes of one level are in a task's subtree.
BLOCK_NODES = 1024

_PATH = "array<struct<before:string,after:string>>"
_PATH_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def field(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself, or ``-`` if null: no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class Subtree:
    """Some consecutive nodes with ``lift`` levels above them, in one task."""

    def __init__(self, digests: list[str], lift: int, arity: int):
        self._arity, self.levels, self._states = arity, [[d.encode() for d in digests]], []
        for _ in range(lift):
            nodes, parents, states = self.levels[-1], [], []
            for at in range(0, len(nodes), arity):
                state, before = hashlib.sha256(), []
                for child in nodes[at : at + arity]:
                    before.append(state.copy())
                    state.update(child)
                states.append(before)
                parents.append(state.hexdigest().encode())
            self.levels.append(parents)
            self._states.append(states)

    @property
    def top(self) -> str:
        return self.levels[-1][0].decode()

    def beside(self, at: int) -> list[tuple[bytes, bytes]]:
        """For each level, the siblings left and right of the path from node ``at``."""
        path = []
        for nodes in self.levels[:-1]:
            low = at - at % self._arity
            path.append((b"".join(nodes[low:at]), b"".join(nodes[at + 1 : low + self._arity])))
            at //= self._arity
        return path

    def folded(self, at: int, digest: str) -> str:
        """The top after node ``at`` is replaced."""
        for nodes, states in zip(self.levels, self._states):
            state = states[at // self._arity][at % self._arity].copy()
            state.update(digest.encode())
            for right in nodes[at + 1 : at - at % self._arity + self._arity]:
                state.update(right)
            digest, at = state.hexdigest(), at // self._arity
        return digest


class Above:
    """The path from a subtree to the root, with the hash state before its slot on every level."""

    def __init__(self, path: list[dict]):
        self.siblings = "".join(p["before"] + p["after"] for p in path).encode()
        self._levels = [(hashlib.sha256(p["before"].encode()), p["after"].encode()) for p in path]

    def folded(self, digest: str) -> str:
        for before, after in self._levels:
            state = before.copy()
            state.update(digest.encode() + after)
            digest = state.hexdigest()
        return digest


def _depth(n: Column, arity: int) -> Column:
    """Levels above ``n`` nodes until one remains."""
    powers = [arity**j for j in range(63) if arity**j < 1 << 62]
    return sum(((n > p).cast("int") for p in powers), F.lit(0))


def _rounds(arity: int) -> int:
    """Levels of a subtree."""
    return max(j for j in range(1, 11) if j == 1 or arity**j <= BLOCK_NODES)


class Forest:
    """Trees over numbered nodes, as one stored table of nodes for every ``rounds`` levels.

    ``nodes`` has ``tree``, ``at`` (numbered from 0 in each tree), ``digest`` and ``depth`` (levels of the tree). A tree
    leaves the table of a round at its top; all pass the first round, so that a single node is one subtree too.
    """

    def __init__(self, nodes: DataFrame, arity: int):
        self.arity, self.rounds = arity, _rounds(arity)
        self.stored = [nodes]
        deepest = nodes.agg(F.max("depth")).first()[0] or 0
        while len(self.stored) == 1 or deepest > self._base(len(self.stored) - 1):
            self.stored.append(written(self._climbed(len(self.stored) - 1), "nodes"))

    def _base(self, r: int) -> int:
        return r * self.rounds

    def _blocks(self, r: int) -> DataFrame:
        """The nodes of a stored level in trees that go on, with the node that each comes under in the next."""
        nodes = self.stored[r] if r == 0 else self.stored[r].where(F.col("depth") > self._base(r))
        return nodes.withColumn("block", F.floor(F.col("at") / F.lit(self.arity**self.rounds)).cast("long"))

    def _ends(self, r: int) -> DataFrame:
        """The tops of the trees that end with a stored level."""
        return self.stored[r].where(F.col("depth") <= self._base(r))

    def subtrees(self, r: int) -> Callable[[pa.Table], Subtree]:
        """Makes the subtree of a block's sorted nodes."""
        base, rounds, arity = self._base(r), self.rounds, self.arity
        return lambda nodes: Subtree(nodes["digest"].to_pylist(), min(rounds, nodes["depth"][0].as_py() - base), arity)

    def _climbed(self, r: int) -> DataFrame:
        subtree = self.subtrees(r)

        def climb(nodes: pa.Table) -> pa.Table:
            top = subtree(nodes.sort_by("at")).top
            return pa.table({"tree": nodes["tree"][:1], "at": nodes["block"][:1], "digest": [top], "depth": nodes["depth"][:1]})

        nodes = self._blocks(r).select("tree", "at", "digest", "depth", "block")
        return nodes.groupBy("tree", "block").applyInArrow(climb, "tree long, at long, digest string, depth int")

    def tops(self) -> DataFrame:
        """``tree`` and its last ``digest``."""
        return _union([self._ends(r).select("tree", "digest") for r in range(1, len(self.stored))])

    def with_paths(self, roots: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], columns: list[str], schema: str) -> DataFrame:
        """``run`` on every subtree of leaves together with the one row of its path to the root.

        ``roots`` has the path above each tree: ``tree``, ``path``.
        """
        paths = None
        for r in reversed(range(1, len(self.stored))):
            ends = self._ends(r).select("tree", "at").join(roots, "tree").select("tree", "at", "path")
            if paths is not None:
                ends = ends.unionByName(self._descended(r, paths))
            paths = written(ends, "paths")
        return self._beside(0, paths, run, columns, schema)

    def paths(self, roots: DataFrame) -> DataFrame:
        """``tree``, ``at`` and ``path`` of every leaf."""
        return self.with_paths(roots, _descend(self.subtrees(0)), ["tree", "at", "digest", "depth"], f"tree long, at long, path {_PATH}")

    def _descended(self, r: int, paths: DataFrame) -> DataFrame:
        columns = ["tree", "at", "digest", "depth"]
        return self._beside(r, paths, _descend(self.subtrees(r)), columns, f"tree long, at long, path {_PATH}")

    def _beside(self, r: int, paths: DataFrame, run, columns: list[str], schema: str) -> DataFrame:
        nodes = self._blocks(r).select(*columns, "block").groupBy("tree", "block")
        paths = paths.select("tree", F.col("at").alias("block"), "path").groupBy("tree", "block")
        return nodes.cogroup(paths).applyInArrow(run, schema)


def _descend(subtree: Callable[[pa.Table], Subtree]):
    def run(nodes: pa.Table, path: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("at")
        tree, rest = subtree(nodes), path["path"][0].as_py()
        paths = [
            [{"before": b.decode(), "after": a.decode()} for b, a in tree.beside(i)] + rest for i in range(len(nodes))
        ]
        return pa.table({"tree": nodes["tree"], "at": nodes["at"], "path": pa.array(paths, _PATH_TYPE)})

    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first


@dataclass
class Manifest:
    """The trees of all languages, and the tree over their tops."""

    languages: Forest
    top: Forest
    subroots: DataFrame  # tree, lang, subroot
    root: str | None  # of an empty table, none

    def proofs(self, replacement: str) -> DataFrame:
        """For each leaf the digest of its siblings up to the root, level by level from the left, and the root that comes
        out with column ``replacement`` (or, where that is null, the leaf itself) in its place: ``doc_id``, ``lang``,
        ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.
        """
        forest = self.languages
        start = forest.stored[0].sparkSession.range(1).select(F.col("id").alias("tree"), F.array().cast(_PATH).alias("path"))
        start = written(start, "paths")
        above = written(self.top.paths(start).select(F.col("at").alias("tree"), "path"), "paths")
        subtree = forest.subtrees(0)

        def fold(nodes: pa.Table, path: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("at")
            tree, rest = subtree(nodes), Above(path["path"][0].as_py())
            proof, root = [], []
            for i, (leaf, other) in enumerate(zip(nodes["digest"].to_pylist(), nodes[replacement].to_pylist())):
                state = hashlib.sha256(b"".join(b + a for b, a in tree.beside(i)))
                state.update(rest.siblings)
                proof.append(state.hexdigest())
                root.append(rest.folded(tree.folded(i, leaf if other is None else other)))
            found = {"proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(root, pa.string())}
            return pa.table({"tree": nodes["tree"], "doc_id": nodes["doc_id"], "leaf": nodes["digest"], **found})

        id = forest.stored[0].schema["doc_id"].dataType.simpleString()
        schema = f"tree long, doc_id {id}, leaf string, proof_sha256 string, folded_root string"
        found = forest.with_paths(above, fold, ["tree", "at", "digest", "depth", "doc_id", replacement], schema)
        root = F.lit(self.root)
        return found.join(self.subroots, "tree").select(
            "doc_id",
            "lang",
            "leaf",
            "subroot",
            root.alias("root"),
            "proof_sha256",
            "folded_root",
            (F.col("folded_root") == root).alias("verified"),
        )


def manifest(leaves: DataFrame, arity: int = 2) -> Manifest:
    """The trees over ``leaves`` (``doc_id``, ``lang``, ``leaf`` and any others): one per language, leaves in the order of
    their ids, every ``arity`` consecutive nodes under one, and one over their tops in the order of the languages.

    Null ids and null languages come first; leaves of one id come in the order of their digests, so equal
    rows make the same tree however they come. Columns ``tree``, ``at``, ``digest``, ``depth`` and ``block`` of the input are
    dropped. An empty table has no root. A language's top, and the root, are single hashes; everything else stays
    in tables, and a hot language is spread over subtrees like any other.
    """
    leaves = leaves.drop("tree", "at", "digest", "depth", "block")
    leaves = written(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    sizes = leaves.groupBy("lang").agg(F.count("*").alias("n"))
    trees = numbered(sizes, [], ["lang"], "tree").select("lang", "tree", _depth(F.col("n"), arity).alias("depth"))
    trees = written(trees, "trees")
    places = numbered(leaves, ["lang"], ["doc_id", "leaf", "_row"], "at").withColumnRenamed("lang", "_lang")
    nodes = places.join(trees, F.col("_lang").eqNullSafe(F.col("lang"))).drop("lang", "_lang", "_row")
    languages = Forest(written(nodes.withColumnRenamed("leaf", "digest"), "nodes"), arity)
    subroots = languages.tops().join(trees.select("tree", "lang"), "tree").select("tree", "lang", F.col("digest").alias("subroot"))
    subroots = written(subroots, "subroots")
    depth = _depth(F.lit(trees.count()), arity).alias("depth")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("subroot").alias("digest"), depth)
    top = Forest(written(tops, "nodes"), arity)
    root = top.tops().first()
    return Manifest(languages, top, subroots, root.digest if root else None)


#: The columns of a document that its leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame, altered: Column, **changes: Column) -> DataFrame:
    """``doc_id``, ``lang`` and ``leaf`` of every document, and where ``altered`` holds, the leaf ``changed`` that it would have
    with other values in some columns.

    A leaf covers the whole text, however long; nulls differ from empty strings. Other columns are not looked at.
    """
    columns = {name: F.col(name) for name in COVERED}
    return docs.select(
        "doc_id",
        "lang",
        leaf_digest(*columns.values()).alias("leaf"),
        F.when(altered, leaf_digest(*(columns | changes).values())).alias("changed"),
    )
