"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token with which its encoding ends. An
automaton over the vocabulary lists the tokens that are suffixes of the prefix; the right one is
that which is compatible with the last token of the prefix before it. Compatible means that the
merges would leave the border between the two tokens alone. The last tokens of all prefixes are
kept, and following them backwards from the end gives the ids: no merge list is replayed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hashwave.llm.chunks import PieceEncoder

#: Texts, or ids, are worked on in parts of about so many bytes.
_PART_BYTES = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of every token of a byte-level vocabulary file, and its special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        alphabet = byte_alphabet()
        self.raw = lambda token: bytes(alphabet[c] for c in token)
        self.vocab, added = self.spec["model"]["vocab"], self.spec["added_tokens"]
        self.bytes_of = [b""] * (1 + max([*self.vocab.values(), *(a["id"] for a in added)]))
        for token, id in self.vocab.items():
            self.bytes_of[id] = self.raw(token)
        self.special = {a["content"]: a["id"] for a in added}
        for content, id in self.special.items():
            self.bytes_of[id] = content.encode()

    def decode(self, ids) -> str:
        """The text of some ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class BpeEncoder:
    """Encoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        spec, raw, vocab = vocabulary.spec, vocabulary.raw, vocabulary.vocab

        # Tokens are numbered by age: single bytes first, then in the order of the merges.
        age = {bytes([b]): b for b in range(256)}
        self._left, self._right, self._merged = list(range(256)), list(range(256)), {}
        for merge in spec["model"]["merges"]:
            left, right = (age[raw(half)] for half in (merge.split(" ") if isinstance(merge, str) else merge))
            self._merged[left << 20 | right] = len(self._left)
            age[raw(merge.replace(" ", "") if isinstance(merge, str) else "".join(merge))] = len(self._left)
            self._left.append(left)
            self._right.append(right)
        id_by_bytes = {raw(token): id for token, id in vocab.items()}
        self._id_by_age = {number: id_by_bytes[token].to_bytes(4, "little") for token, number in age.items()}

        self._suffixes = ahocorasick.Automaton()
        for token, number in age.items():
            self._suffixes.add_word(token.decode("latin-1"), (number, len(token)))
        self._suffixes.make_automaton()
        self._pairs: dict[int, bool] = {}
        self.encode_text = PieceEncoder(self._by_prefixes, vocabulary.special)

    def _by_prefixes(self, text: str) -> bytes:
        """The ids of one pre-token, from the last token of each of its prefixes."""
        word = text.encode()
        tokens, lengths = [0] * len(word), [0] * len(word)
        known, compatible = self._pairs, self._compatible
        filled = -1
        for end, (token, length) in self._suffixes.iter(word.decode("latin-1")):
            if end == filled:
                continue
            before = end - length
            if before >= 0:
                pair = tokens[before] << 20 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= 400_000:
                        known.clear()
                    fits = known[pair] = compatible(tokens[before], token)
                if not fits:
                    continue
            tokens[end], lengths[end], filled = token, length, end
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append(self._id_by_age[tokens[at]])
            at -= lengths[at]
        ids.reverse()
        return b"".join(ids)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges of two adjacent tokens' bytes end with just these two tokens.

        The merges are undone from the newest on. Whenever the two pieces at the border could have
        been merged before the piece that is undone next was made, the border would not have stood.
        Of equal merges the one further to the left comes first.
        """
        made = len(self._left)
        while True:
            across = self._merged.get(left << 20 | right)
            if across is not None and across < made:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                made, left = left, self._right[left]
            else:
                made, right = right + 1, self._left[right]


@lru_cache(maxsize=4)
def encoder(path: str) -> BpeEncoder:
    """One per Python worker and file."""
    return BpeEncoder(path)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    return Vocabulary(path)


def _parts(batch: pa.RecordBatch, column: str, bytes_each: int, most: int = _PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of one column, so that little is worked on at once."""
    if not batch.num_rows:
        yield batch
    values = batch.column(column)
    length = pa.compute.list_value_length(values) if pa.types.is_list(values.type) else pa.compute.binary_length(values)
    ends = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * bytes_each)
    low = 0
    while low < batch.num_rows:
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = batch.schema.names
    columns = [c for n, c in zip(names, batch.columns) if n != name]
    return pa.RecordBatch.from_arrays([*columns, values], [*(n for n in names if n != name), name])


def _schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as ``array<int>``; a column of that name is replaced.

    A null text counts as empty and has no ids; special tokens' strings are read as these tokens,
    none is added. Rows are independent, so there is no shuffle, and repeated rows give equal ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(path).encode_text
        for batch in (part for batch in batches for part in _parts(batch, text, 1)):
            encoded = [encode_text(t or "") for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int64)
            ids = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
            yield _with_column(batch, out, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids))

    return df.mapInArrow(run, _schema_with(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids, special tokens kept; null ids count as none.

    An id outside the vocabulary is an error, as nothing right can be returned for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = vocabulary(path).decode
        for batch in (part for batch in batches for part in _parts(batch, ids, 4)):
            rows = batch.column(ids)
            values, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
            texts = [text_of(values[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield _with_column(batch, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema_with(df, out, T.StringType()))


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "ids", back: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of its ids, by one Python worker a task instead of two. The text is dropped.

    Columns named ``out`` and ``back`` are replaced; nulls and special tokens are treated as in the two steps.
    """
    kept = df.drop(out, back)
    fields = [f for f in kept.schema if f.name != text]
    ids_type, back_type = T.ArrayType(T.IntegerType()), T.StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, text_of = encoder(path).encode_text, vocabulary(path).decode
        for batch in (part for batch in batches for part in _parts(batch, text, 1)):
            ids = [np.frombuffer(encode_text(t or ""), "<i4") for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            texts = pa.array([text_of(i.tolist()) for i in ids], pa.string())
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, lists, texts], [*(f.name for f in fields), out, back])

    schema = T.StructType([*fields, T.StructField(out, ids_type), T.StructField(back, back_type)])
    return kept.mapInArrow(run, schema)
