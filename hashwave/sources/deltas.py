"""Tables kept as committed pieces, from which reading makes one row per key.

Every commit writes its rows to a folder of its own and then enters it in the log (``commits.py``). Readers
follow the log alone, so they see a batch whole or not at all, a failed attempt is never seen, and
a batch committed twice counts once. Nothing is overwritten: writers of any number, folds and readers run side by
side. Folds merge young pieces into older ones by tiers, so that a row is written again a few times in all and
a reader opens a number of pieces that grows with the logarithm of the number of batches.

A table may be cut into days. Each is then folded by itself, and reading some days opens those alone.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashwave.sources.commits import CommitLog, Piece, State, batch_id
from hashwave.sources.files import Folder

_WHOLE = ""
_ATTEMPT = r"/data/([0-9a-f]{32})/"


@dataclass
class Pending:
    """A batch whose rows are stored but not yet entered."""

    table: CommittedTable
    attempt: str
    batch: tuple[str, int] | None

    def publish(self) -> bool:
        """Enter the batch; False if it is in the table already. Its rows count from here on."""
        state = self.table.log.append_batch(self.attempt, self.batch, self.table._slots_of(self.attempt))
        if state is None:
            return False
        self.table._fold_due(state)
        return True


@dataclass
class PendingFold:
    """Folded rows that are stored but not yet entered."""

    table: CommittedTable
    state: State
    pieces: dict[str, list[Piece]]

    def publish(self) -> bool:
        """Let the folded rows stand for those that they were made from; False if another fold was faster."""
        return self.table.log.append_fold(self.state, self.pieces)


class CommittedTable:
    """Rows of ``keys`` and ``values`` below one folder of a shared store; subclasses say what rows of one key become.

    ``schema`` is that of a batch. ``day`` gives the day of a row, from its keys alone, and cuts the table. After
    ``fold_every`` commits the log is folded, and with it pieces of days (or of the table) that have as many.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        keys: list[str],
        values: list[str],
        day: Column | None = None,
        fold_every: int = 16,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.values, self.day, self.fold_every = list(keys), list(values), day, fold_every
        self.log = CommitLog(spark, f"{self.path}/log")
        self._data = Folder(spark, f"{self.path}/data")

    def _resolved(self, rows: DataFrame) -> DataFrame:
        """One row per key; ``_seq`` is the number of the entry that a row came with."""
        raise NotImplementedError

    def commit(self, rows: DataFrame, batch: str | int | None = None) -> bool:
        """Add a batch with one row per key; False if a batch of that name is there already.

        A name that ends in a hyphen and a number is a batch of that number of a stream. Without a name
        the rows are always added, which only suits tables that do not mind repetition.
        """
        pending = self.prepare(rows, batch)
        return pending is not None and pending.publish()

    def prepare(self, rows: DataFrame, batch: str | int | None = None) -> Pending | None:
        """Store the rows of a batch without entering it; None if a batch of that name is there already."""
        state, batch = self.log.state(), None if batch is None else batch_id(batch)
        return None if state.holds(batch) else Pending(self, self._write(rows, "rebalance"), batch)

    def read(self, days: list[str] | None = None) -> DataFrame:
        """One row per key over all committed batches, or over those of some days (as ``2024-01-31``)."""
        return self._resolved(self._rows(self._chosen(self.log.state(), days))).select(*self.keys, *self.values)

    def compact(self, days: list[str] | None = None) -> bool:
        """Fold all pieces of the table, or of some days, into one sorted one; False if another fold was faster."""
        fold = self.prepare_fold(days)
        return fold is None or fold.publish()

    def prepare_fold(self, days: list[str] | None = None) -> PendingFold | None:
        """Store the folded rows without letting them stand; None if there is nothing to fold."""
        state = self.log.state()
        chosen = {slot: pieces for slot, pieces in self._chosen(state, days).items() if len(pieces) > 1}
        return self._folded(state, chosen) if chosen else None

    def expire(self, older_than_s: float) -> None:
        """Delete what no longer counts and is older: readers that take longer may miss files."""
        before = int((time.time() - older_than_s) * 1000)
        used = self.log.expire(before)
        for attempt, changed in self._data.names().items():
            if attempt not in used and changed < before:
                self._data.delete(attempt)

    @staticmethod
    def _chosen(state: State, days: list[str] | None) -> dict[str, list[Piece]]:
        return {slot: pieces for slot, pieces in state.pieces.items() if days is None or slot in days}

    def _fold_due(self, state: State) -> None:
        """Fold the log, and of the days with many pieces the young ones."""
        if state.entries < self.fold_every:
            return
        due = {}
        for slot, pieces in state.pieces.items():
            tier, tiers = 0, [p.tier for p in pieces]
            if tiers.count(0) < self.fold_every:
                continue
            while tiers.count(tier + 1) + 1 >= self.fold_every:
                tier += 1
            due[slot] = [p for p in pieces if p.tier <= tier]
        self._folded(state, due).publish()

    def _folded(self, state: State, chosen: dict[str, list[Piece]]) -> PendingFold:
        pieces = dict(state.pieces)
        if chosen:
            attempt = self._write(self._resolved(self._rows(chosen)), "range")
            for slot, old in chosen.items():
                piece = Piece(attempt, state.last, max(p.tier for p in old) + 1)
                pieces[slot] = [*pieces[slot][: -len(old)], piece]
        return PendingFold(self, state, pieces)

    def _write(self, rows: DataFrame, deal: str) -> str:
        """Store rows in a new folder: as they come (large days split, small ones gathered), or sorted in ranges of the keys."""
        attempt, names = uuid.uuid4().hex, [*self.keys, *self.values]
        rows = rows.select(*names) if self.day is None else rows.select(*names, self.day.alias("date"))
        cut = [] if self.day is None else ["date"]
        if deal == "range":
            # Ranges of all keys: a hot first key is cut over several files.
            rows = rows.repartitionByRange(*cut, *self.keys).sortWithinPartitions(*cut, *self.keys)
        elif cut:
            rows = rows.hint("rebalance", *cut)
        writer = rows.write.partitionBy(*cut) if cut else rows.write
        if deal == "range":
            # A key that is not there is mostly told from the filter, without reading a row.
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.keys[0]}", "true")
        writer.parquet(f"{self.path}/data/{attempt}")
        return attempt

    def _slots_of(self, attempt: str) -> list[str]:
        if self.day is None:
            return [_WHOLE]
        found = Folder(self.spark, f"{self.path}/data/{attempt}").names()
        return sorted(name.removeprefix("date=") for name in found if name.startswith("date="))

    def _rows(self, chosen: dict[str, list[Piece]]) -> DataFrame:
        pieces = {p.attempt: p.seq for ps in chosen.values() for p in ps}
        paths = [f"{self.path}/data/{p.attempt}{f'/date={slot}' if slot else ''}" for slot, ps in chosen.items() for p in ps]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, _seq bigint")
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        numbers = F.create_map(*(F.lit(v) for pair in pieces.items() for v in pair))
        return rows.withColumn("_seq", F.element_at(numbers, F.regexp_extract("_metadata.file_path", _ATTEMPT, 1)).cast("bigint"))


class DeltaTable(CommittedTable):
    """Signed changes of additive values: those of a key are added up."""

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.sum(v).alias(v) for v in self.values))


class GreatestTable(CommittedTable):
    """Values that only grow: of each key the greatest stay."""

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.max(v).alias(v) for v in self.values))


class NewestTable(CommittedTable):
    """Values that replace one another: of each key, those of the greatest ``moment`` stay.

    ``moment`` is one of the values, a number, so that the aggregate is hashed. Rows with the
    same key and moment must be equal; batches may then come in any order.
    """

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.max_by(v, "moment").alias(v) for v in self.values))


class FirstTable(CommittedTable):
    """Put if absent: of each key, the values of the first commit stay, whoever else commits the key later.

    Putting reads nothing that is stored; writers need not know of one another, as the log gives
    their commits one order.
    """

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.min_by(v, "_seq").alias(v) for v in self.values))


class SketchTable(CommittedTable):
    """Sketches of sets of values: those of a key are united."""

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.hll_union_agg(v).alias(v) for v in self.values))


class AppendTable(CommittedTable):
    """Rows that all stay, in the order of ``keys`` once they are folded."""

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return rows
