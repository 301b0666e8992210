"""Token counts as rollups kept by signed changes.

Totals by source, language and tokenizer version change by what a batch inserts, deletes or revises;
they are never counted again from the texts. Each batch is added up, stored in a folder of its own and then entered in
the rollup's log; a batch that is entered already is not entered again, so a batch delivered twice counts once.
Folders are folded into one when there are many, and the log forgets them, but not which batches they were.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.llm.bpe import _parts
from hashwave.llm.chunks import PRE_TOKEN, PieceCounter
from hashwave.sources.commits import CommitLog, Piece, batch_id

KEYS = ["source", "lang", "tokenizer"]
VALUES = ["n_docs", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Rows sent to Python at once where ``rows_per_batch`` sets it, as texts may be long.
BATCH = 1024


@lru_cache(maxsize=4)
def rank_counter(paths: tuple[str, ...]) -> PieceCounter:
    """Counts by rank files of the tiktoken library, one per Python worker; such files have no special tokens."""
    import tiktoken

    def count(path: str) -> Callable[[str], int]:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        return lambda word: len(encoding.encode_ordinary(word))

    return PieceCounter([count(path) for path in paths])


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], text: str = "text") -> DataFrame:
    """Replaces the text by one column ``n_<version>`` per tokenizer version: tokens of the whole text.

    ``tokenizers`` maps versions to rank files. Null and empty texts have no tokens; texts of any length are counted whole;
    an empty table gives no rows; a column of one of the new names is replaced. No shuffle.
    """
    versions = list(tokenizers)
    others = [f for f in docs.schema if f.name != text and f.name not in {f"n_{v}" for v in versions}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = rank_counter(tuple(tokenizers[v] for v in versions)).per_tokenizer
        for batch in (part for batch in batches for part in _parts(batch, text, 1)):
            rows = [count(t or "") for t in batch.column(text).to_pylist()]
            counts = [pa.array([row[i] for row in rows], pa.int64()) for i in range(len(versions))]
            names = [f.name for f in others]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *counts], [*names, *(f"n_{v}" for v in versions)]
            )

    schema = docs.select(*(F.col(f"`{f.name}`") for f in others), *(F.lit(0).cast("long").alias(f"n_{v}") for v in versions)).schema
    return docs.mapInArrow(run, schema)


def signed(docs: DataFrame, tokenizer: str, count: str, sign: int) -> DataFrame:
    """Each document as one change: ``sign`` documents and ``sign`` times its tokens."""
    return docs.select(
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("long").alias("n_docs"),
        (sign * F.coalesce(F.col(count), F.lit(0))).cast("long").alias("n_tokens"),
    )


def inserts(docs: DataFrame, tokenizer: str, count: str) -> DataFrame:
    return signed(docs, tokenizer, count, 1)


def deletes(docs: DataFrame, tokenizer: str, count: str) -> DataFrame:
    return signed(docs, tokenizer, count, -1)


def revisions(docs: DataFrame, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """A new count for documents already in: the old (version, column) goes and the new one comes."""
    return deletes(docs, *before).unionByName(inserts(docs, *after))


class TokenRollup:
    """Totals by source, language and tokenizer version below a folder of the shared store.

    Null sources and languages are keys like others. Deleting what was never inserted gives
    negative totals rather than an error, as batches may arrive in any order. Several writers may commit at once.
    A batch is added up by ``parts`` tasks at most and stored in as many files, however many shuffle partitions the session
    has: its rows are as many as its keys. Many millions of sources want more parts.
    """

    def __init__(self, spark: SparkSession, path: str, fold_every: int = 32, parts: int = 6):
        self._spark, self._path, self._fold_every, self._parts = spark, path.rstrip("/"), fold_every, parts
        self._log = CommitLog(spark, f"{self._path}/log")

    def commit(self, changes: DataFrame, batch: str) -> bool:
        """Add a batch; False if it was committed before. A hot source is one row per input task.

        Names that end in a hyphen and a number are the batches of a stream, and kept as ranges of numbers.
        """
        batch = batch_id(batch)
        if self._log.state().holds(batch):
            return False
        state = self._log.append_batch(self._stored(self._added_up(changes)), batch, ["totals"])
        if state is not None and state.entries >= self._fold_every:
            self.compact()
        return state is not None

    def compact(self) -> bool:
        """Fold the batches committed so far into one folder; False if another fold was faster."""
        before = self._log.state()
        attempts = self._attempts(before)
        if not attempts:
            return True
        folded = self._stored(self._added_up(self._rows(attempts)))
        return self._log.append_fold(before, {"totals": [Piece(folded, before.last)]})

    def totals(self) -> DataFrame:
        """Rows with something in them."""
        rows = self._added_up(self._rows(self._attempts(self._log.state())))
        return rows.where("n_docs != 0 or n_tokens != 0")

    @staticmethod
    def _attempts(state) -> list[str]:
        return [piece.attempt for piece in state.pieces.get("totals", [])]

    def _added_up(self, changes: DataFrame) -> DataFrame:
        return changes.groupBy(*KEYS).agg(*(F.sum(v).alias(v) for v in VALUES)).coalesce(self._parts)

    def _stored(self, rows: DataFrame) -> str:
        """A new folder with the rows. No reader looks into it before it is in the log."""
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self._path}/data/{attempt}")
        return attempt

    def _rows(self, attempts: list[str]) -> DataFrame:
        if not attempts:
            return self._spark.createDataFrame([], SCHEMA)
        return self._spark.read.schema(SCHEMA).parquet(*(f"{self._path}/data/{a}" for a in attempts))
