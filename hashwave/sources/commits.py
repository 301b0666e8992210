"""The log of a table that is kept as committed pieces.

Every commit is one numbered entry, written whole and never over another, so writers agree on one order: whoever
finds a number taken reads what is there and tries the next. An entry is a batch (a folder of rows) or
a fold, which stands for all entries up to some number. A reader starts at the newest fold, so what
it reads does not grow with the age of the table.
"""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from hashwave.sources.files import Folder

#: Names the newest fold that its writer knew; an older one only makes reading longer.
_HINT = "newest"


@dataclass
class Piece:
    """A folder of rows: the number of the entry that it belongs to, and how often its rows have been folded."""

    attempt: str
    seq: int
    tier: int = 0


@dataclass
class State:
    """What the log says up to entry ``last``: the newest fold, how many batches it had not seen, the pieces that count by slot
    (the oldest first), and by stream the ranges of batches that are in."""

    last: int = -1
    folded: int = -1
    entries: int = 0
    pieces: dict[str, list[Piece]] = field(default_factory=dict)
    done: dict[str, list[list[int]]] = field(default_factory=dict)

    def holds(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and any(a <= batch[1] <= b for a, b in self.done.get(batch[0], []))

    def _add(self, stream: str, number: int) -> None:
        """Ranges that touch become one: a stream that numbers its batches is one range however long it runs."""
        ranges: list[list[int]] = []
        for a, b in sorted([*self.done.get(stream, []), [number, number]]):
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1][1] = max(b, ranges[-1][1])
            else:
                ranges.append([a, b])
        self.done[stream] = ranges

    def apply(self, seq: int, entry: dict) -> None:
        self.last = seq
        if "upto" in entry:
            later = {slot: [p for p in pieces if p.seq > entry["upto"]] for slot, pieces in self.pieces.items()}
            self.pieces = {slot: [Piece(*p) for p in pieces] for slot, pieces in entry["pieces"].items()}
            for slot, pieces in later.items():
                if pieces:
                    self.pieces.setdefault(slot, []).extend(pieces)
            for stream, ranges in entry["done"].items():
                if stream not in self.done:
                    self.done[stream] = ranges
            self.entries, self.folded = max(0, seq - entry["upto"] - 1), seq
            return
        self.entries += 1
        if entry["batch"]:
            self._add(*entry["batch"])
        for slot in entry["slots"]:
            self.pieces.setdefault(slot, []).append(Piece(entry["attempt"], seq))


def batch_id(name: str | int) -> tuple[str, int]:
    """The stream of a batch and its number there: what follows the last hyphen, if that is a number."""
    stream, _, number = str(name).rpartition("-")
    return (stream, int(number)) if number.isascii() and number.isdigit() else (str(name), 0)


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)
        self._known: State | None = None
        self.read_entries = 0

    @staticmethod
    def _name(seq: int) -> str:
        return f"{seq:020d}.json"

    def _entry(self, seq: int) -> dict | None:
        text = self.folder.read(self._name(seq))
        self.read_entries += text is not None
        return None if text is None else json.loads(text)

    def state(self) -> State:
        """What the log says now. Entries never change, so one log reads on from where it was."""
        state = deepcopy(self._known) if self._known else self._start()
        while (entry := self._entry(state.last + 1)) is not None:
            state.apply(state.last + 1, entry)
        self._known = state
        return deepcopy(state)

    def _start(self) -> State:
        hint = self.folder.read(_HINT)
        at = int(hint) if hint else self._newest_fold()
        fold = self._entry(at) if at is not None else None
        if fold is None:
            return State()
        # The fold's own state, then the batches that it had not seen; it comes again at its own number.
        state = State(done=deepcopy(fold["done"]))
        state.apply(fold["upto"], fold)
        return state

    def _newest_fold(self) -> int | None:
        """Without a hint: none if the log can be read from its first entry, and else the last fold."""
        numbers = sorted((int(n[:-5]) for n in self.folder.names() if n.endswith(".json")), reverse=True)
        if not numbers or numbers[-1] == 0:
            return None
        return next(n for n in numbers if "upto" in (self._entry(n) or {}))

    def append_batch(self, attempt: str, batch: tuple[str, int] | None, slots: list[str]) -> State | None:
        """Enter a batch after all there is; None if it is there already."""
        entry = json.dumps({"attempt": attempt, "batch": batch, "slots": slots})
        while True:
            state = self.state()
            if state.holds(batch):
                return None
            if self.folder.put_new(self._name(state.last + 1), entry):
                return self.state()

    def append_fold(self, before: State, pieces: dict[str, list[Piece]]) -> bool:
        """Enter a fold of the state ``before``; False if another one was entered meanwhile, which then stands."""
        listed = {slot: [[p.attempt, p.seq, p.tier] for p in ps] for slot, ps in pieces.items()}
        entry = json.dumps({"upto": before.last, "done": before.done, "pieces": listed})
        while True:
            state = self.state()
            if state.folded != before.folded:
                return False
            if self.folder.put_new(self._name(state.last + 1), entry):
                self.folder.replace(_HINT, str(state.last + 1))
                return True

    def expire(self, before_ms: int) -> set[str]:
        """Delete entries that the newest fold stands for and that are older; gives the folders of rows in use.

        The fold that the hint names, and all entries that it had not seen, stay.
        """
        state = self.state()
        used = {p.attempt for pieces in state.pieces.values() for p in pieces}
        hint = self.folder.read(_HINT)
        fold = self._entry(int(hint)) if hint else None
        if fold:
            for name, changed in self.folder.names().items():
                if name.endswith(".json") and int(name[:-5]) <= fold["upto"] and changed < before_ms:
                    self.folder.delete(name)
        return used
