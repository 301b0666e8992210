"""Token ids in directly addressable codes: any id can be read without decoding a block.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id; a bit per
entry says whether the id goes on in the next level, which holds only the chunks of those that
do. The place of an id's next chunk is the number of continuation bits before it, which a rank
directory (one count for 512 bits) gives with at most eight words to count.

A token file is a Parquet table of segments, so that Spark's committed writes and any shared store
serve it. A segment holds whole documents; segments are in ascending document order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashwave.llm.bpe import _parts, byte_alphabet
from hashwave.llm.chunks import PieceEncoder
from hashwave.llm.common import written
from hashwave.operators.joins import splittable_join
from hashwave.session import shared_dir

CHUNK_BITS = 8
LEVELS = 4
RANK_BITS = 512

#: Texts of about so many bytes are encoded together: the more, the more often a piece is met again.
_TOGETHER = 1 << 23

SEGMENT = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("first", T.LongType()),  # ids of the part before this segment
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("chunks", T.ArrayType(T.BinaryType())),
        T.StructField("more", T.ArrayType(T.BinaryType())),
        T.StructField("ranks", T.ArrayType(T.BinaryType())),
    ]
)


#: How many bits of a byte are set.
_ONES = np.array([byte.bit_count() for byte in range(256)], np.int64)


class DirectCodes:
    """One segment's codes."""

    def __init__(self, chunks: list[bytes], more: list[bytes], ranks: list[bytes]):
        self._chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self._more = [np.frombuffer(m, np.uint8) for m in more]
        self._ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @staticmethod
    def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """Chunks, continuation bits and rank directory of each level that is in use."""
        chunks, more, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while len(rest):
            goes_on = rest >= 1 << CHUNK_BITS
            bits = np.packbits(goes_on, bitorder="little")
            blocks = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.uint32)
            chunks.append((rest & 255).astype(np.uint8).tobytes())
            more.append(bits.tobytes())
            ranks.append((np.cumsum(blocks) - blocks).astype("<u4").tobytes())
            rest = rest[goes_on] >> CHUNK_BITS
        return chunks, more, ranks

    def __getitem__(self, at: int) -> int:
        """The id at a place, by one look and one rank a level."""
        value = 0
        for level in range(len(self._chunks)):
            value |= int(self._chunks[level][at]) << CHUNK_BITS * level
            if not self._more[level][at >> 3] >> (at & 7) & 1:
                break
            block = at // RANK_BITS
            bits = np.unpackbits(self._more[level][block * RANK_BITS // 8 : (at >> 3) + 1], bitorder="little")
            at = int(self._ranks[level][block]) + int(bits[: at - block * RANK_BITS].sum())
        return value

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at many places, each by one look and one rank a level: a block's bits before it are counted, no id is decoded
        but those asked for."""
        values = np.zeros(len(places), np.uint32)
        for low in range(0, len(places), 1 << 14):
            values[low : low + (1 << 14)] = self._some(places[low : low + (1 << 14)].astype(np.int64))
        return values

    def _some(self, at: np.ndarray) -> np.ndarray:
        values, rows = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, chunk in enumerate(self._chunks):
            more = self._more[level]
            values[rows] |= chunk[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            on = (more[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            rows, at = rows[on], at[on]
            if not len(at):
                break
            block, within = at // RANK_BITS, at % RANK_BITS
            steps = np.arange(RANK_BITS // 8)
            words = more[np.minimum(block[:, None] * (RANK_BITS // 8) + steps, len(more) - 1)]
            before = np.clip(within[:, None] - 8 * steps, 0, 8)
            at = self._ranks[level][block].astype(np.int64) + _ONES[words & ((1 << before) - 1)].sum(axis=1)
        return values

    def all(self) -> np.ndarray:
        """Every id in order."""
        values = np.zeros(len(self._chunks[0]) if self._chunks else 0, np.uint32)
        places = np.arange(len(values))
        for level, chunk in enumerate(self._chunks):
            values[places] |= chunk.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            places = places[np.unpackbits(self._more[level], bitorder="little", count=len(chunk)).astype(bool)]
        return values


#: Letters, perhaps after a space, and then marks: two pre-tokens. An apostrophe may begin another.
_LETTERS_AND_MARKS = re.compile(r" ?([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")

#: From here on, tables of letters may differ.
_OTHER_SCRIPTS = "\u0500"


class LetterEncoder(PieceEncoder):
    """Takes pieces of letters alone, or of letters and marks, for the pre-tokens they are, without the pattern.

    Such a piece is kept once, among the pieces, and its letters with another mark behind them are looked up there.
    """

    def _encode_piece(self, piece: str) -> bytes:
        if self._letters(piece.removeprefix(" ")):
            return self._encode_word(piece)
        if (two := _LETTERS_AND_MARKS.fullmatch(piece)) and self._letters(two[1]):
            known = self._spaced if piece[0] == " " else self._first
            return known[two[1]] + self._words[two[2]]
        return super()._encode_piece(piece)

    @staticmethod
    def _letters(text: str) -> bool:
        return text.isalpha() and (text.isascii() or max(text) < _OTHER_SCRIPTS)


@lru_cache(maxsize=4)
def library_encoder(path: str) -> PieceEncoder:
    """Encodes with the tokenizers library, each distinct piece of text once while it is kept.

    Pieces are pre-tokens already, so the library's model encodes them without its other steps. A file that asks for
    others than the byte-level ones is refused.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = spec.get("pre_tokenizer") or {}
    if (
        spec.get("normalizer")
        or (steps.get("type"), steps.get("add_prefix_space"), steps.get("use_regex", True)) != ("ByteLevel", False, True)
        or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
    ):
        raise ValueError(f"{path} does not cut text in the byte-level way, without a space in front")
    tokenizer = Tokenizer.from_file(path)
    special = {t.content: id for id, t in tokenizer.get_added_tokens_decoder().items()}

    alphabet = {byte: char for char, byte in byte_alphabet().items()}
    space, tokenize = alphabet[ord(" ")], tokenizer.model.tokenize
    ids = [id.to_bytes(4, "little") for id in range(max(tokenizer.get_vocab().values(), default=-1) + 1)]

    def encode_word(word: str) -> bytes:
        # Of printable ASCII, the byte alphabet changes the space alone.
        plain = word.isascii() and word.isprintable()
        text = word.replace(" ", space) if plain else word.encode().decode("latin-1").translate(alphabet)
        return b"".join([ids[t.id] for t in tokenize(text)])

    return LetterEncoder(encode_word, special, most=400_000)


def write_token_file(
    docs: DataFrame, path: str, out: str, end_id: int = 0, segment_ids: int = 1 << 18, parts: int | None = None
) -> None:
    """Write the ids of every whole document, each followed by ``end_id``, in ascending ``doc_id``.

    Documents are dealt by ranges of (doc_id, hash of the text), so the order of files is the order
    of documents, a null ``doc_id`` comes first, and rows that share an id lie together without
    having to lie in one task. A segment is closed once it holds ``segment_ids`` ids; a longer
    document makes a longer segment. A null text counts as empty: it has the end id only.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_many = library_encoder(path).encode_many
        part, made, first = TaskContext.get().partitionId(), 0, 0
        held, ids, total = [], [], 0

        def segment() -> pa.RecordBatch:
            chunks, more, ranks = DirectCodes.pack(np.frombuffer(b"".join(held), "<u4"))
            lengths = [len(h) // 4 for h in held]
            row = [part, made, first, total, ids, lengths, chunks, more, ranks]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.binary())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], SEGMENT.names)

        for batch in (run for batch in batches for run in _parts(batch, "text", 1, _TOGETHER)):
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encode_many(batch.column(1).to_pylist())):
                held.append(encoded + end)
                ids.append(doc_id)
                total += len(held[-1]) // 4
                if total >= segment_ids:
                    yield segment()
                    made, first, held, ids, total = made + 1, first + total, [], [], 0
        if held:
            yield segment()

    texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, SEGMENT).write.parquet(out)


def read_segments(spark, path: str) -> DataFrame:
    """The segments of a token file with ``start``, the ids of the file before each.

    The parts' totals are one number for each part that :func:`write_token_file` was told to make, so they fit the
    driver and are sent to all tasks, whatever the size of the file.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = {row.part: row.part_ids for row in totals.collect()}  # one row for each file part
    starts, start = [], 0
    for part in sorted(before):
        starts.append((part, start))
        start += before[part]
    starts = spark.createDataFrame(starts, "part int, part_start long")
    return segments.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("first")).drop("part_start")


def read_documents(segments: DataFrame) -> DataFrame:
    """Each document's place and its ids as little-endian unsigned 32-bit binary, and by one look at each of their places alone
    the ``first_id`` and ``last_id``."""
    schema = "doc_id long, start long, n_tokens long, ids binary, first_id long, last_id long"
    names = ["doc_id", "start", "n_tokens", "ids", "first_id", "last_id"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = DirectCodes(row["chunks"], row["more"], row["ranks"])
                data = codes.all().astype("<u4").tobytes()
                ends = np.cumsum([0, *row["lengths"]])
                looked_up = [codes.at(at).tolist() for at in (ends[:-1], ends[1:] - 1)]
                ids = [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
                columns = [row["doc_ids"], (row["start"] + ends[:-1]).tolist(), row["lengths"], ids, *looked_up]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return segments.select("start", "doc_ids", "lengths", "chunks", "more", "ranks").mapInArrow(unpack, schema)


def tokens_at(segments: DataFrame, places: DataFrame, span: int = 1 << 20) -> DataFrame:
    """The id at each wanted place (column ``place``) of the file, by random access: ``place`` and ``id``, a row for each row.

    Places meet the segments' bounds, without their codes, by the ``span`` of places that they touch. Each segment is then
    sent once to where its places are, different ones only, so that a task holds one segment and no more places than
    it has ids, however often they are asked for. Null places and places past the end give no row.
    """
    covered = F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n_ids") - 1) / span))
    bounds = segments.where("n_ids > 0").select("part", "segment", "start", "n_ids", F.explode(covered).alias("_span"))
    wanted = places.select("place").distinct().withColumn("_span", F.floor(F.col("place") / span))
    inside = (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_ids"))
    found = wanted.join(bounds, "_span").where(inside)
    found = written(found.select("part", "segment", "place", (F.col("place") - F.col("start")).alias("at")), "places")

    def look(places: pa.Table, segment: pa.Table) -> pa.Table:
        codes = DirectCodes(*(segment[name][0].as_py() for name in ("chunks", "more", "ranks"))) if len(segment) else None
        ids = codes.at(places["at"].to_numpy()) if len(places) else np.zeros(0, np.uint32)
        return pa.table({"place": places["place"], "id": pa.array(ids.astype(np.int64))})

    codes = segments.select("part", "segment", "chunks", "more", "ranks")
    needed = codes.join(found.select("part", "segment").distinct(), ["part", "segment"], "left_semi")
    read = found.groupBy("part", "segment").cogroup(needed.groupBy("part", "segment")).applyInArrow(look, "place long, id long")
    return splittable_join(places.select("place"), read, ["place"])


def token_file(docs: DataFrame, path: str, end_id: int = 0, **options) -> str:
    """Write a token file to a new folder of the shared store and return the folder."""
    out = shared_dir(docs.sparkSession, "tokens")
    write_token_file(docs, path, out, end_id, **options)
    return out
