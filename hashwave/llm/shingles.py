"""Shingles of whole texts as 64-bit hashes, computed on the bytes of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WINDOW = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that close ones get unrelated bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of texts: ``width`` lower-cased words, or all words if there are fewer."""

    def __init__(self, width: int = 5):
        self._width = width
        self._up, self._down = _powers(_BASE, _WINDOW), _powers(_INVERSE, _WINDOW)
        self._places = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def _word_hashes(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word. A word ends at white space and at ``breaks`` (the texts' starts)."""
        inside = ~_SPACE[data]
        first = inside.copy()
        new = np.zeros(len(data), bool)
        new[breaks[breaks < len(data)]] = True
        first[1:] &= ~inside[:-1] | new[1:]
        starts = np.flatnonzero(first)
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            # A window of whole words; a longer word makes a longer window.
            upto = max(at + 1, int(np.searchsorted(starts, starts[at] + _WINDOW, "left")) - 1)
            if upto + 1 == len(starts) and len(data) - starts[at] <= _WINDOW:
                upto += 1
            low = starts[at]
            high = starts[upto] if upto < len(starts) else len(data)
            if high - low > len(self._up):
                self._up, self._down = _powers(_BASE, high - low), _powers(_INVERSE, high - low)
            values = _LOWER[data[low:high]].astype(np.uint64) + np.uint64(1)
            values *= self._up[: high - low]
            values[~inside[low:high]] = 0
            within = starts[at:upto] - low
            hashes[at:upto] = np.add.reduceat(values, within) * self._down[within]
            at = upto
        return starts, mixed(hashes)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text; none for null, empty and blank ones."""
        texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = (offsets - offsets[0]).astype(np.int64)
        if not len(data):
            yield from (np.empty(0, np.uint64) for _ in range(len(texts)))
            return
        starts, words = self._word_hashes(data, bounds[:-1])
        width = self._width
        whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            whole += words[k : k + len(whole)] * self._places[k]
        whole = mixed(whole)
        edges = np.searchsorted(starts, bounds)
        for low, high in zip(edges, edges[1:]):
            n = high - low
            if n >= width:
                yield np.unique(whole[low : high - width + 1])
            elif n:
                total = np.uint64(n) + (words[low:high] * self._places[:n]).sum(dtype=np.uint64)
                yield mixed(np.array([total], np.uint64))
            else:
                yield np.empty(0, np.uint64)
