"""Cutting text where a byte-level tokenizer always cuts it, so that pieces can be encoded apart.

The splitting pattern of the byte-level tokenizers lets a word take one space before it. Hence a
token boundary lies before every space that has a character other than white space behind it,
whatever comes before: a run of white space gives its last character to the word. Pieces cut
there are encoded alike within the text and alone, so each distinct piece need be encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex

# White space as Python sees it holds all the white space of the pattern, so a cut made here is
# one that the tokenizer makes too.
_CUT = re.compile(r" (?=\S)")
_BREAK = re.compile(r"(?<=\S)\n(?=\S)")

#: Fixed by the tokenizers' format: how a text falls into pre-tokens before the merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longer pieces (text without spaces) are encoded each time instead of being kept.
LONGEST_KEPT = 64


class NoPiece(Exception):
    """What stands between two spaces is no piece, as white space or nothing follows the first."""


def lines(text: str) -> list[str]:
    """The parts of a text between those line breaks that are tokens of their own."""
    if "\n" not in text:
        return [text]
    parts = text.split("\n")
    return parts if all(part and part.strip() == part for part in parts) else _BREAK.split(text)


class PieceCache(dict):
    """Encoded pieces by text, in two generations, so that memory is bounded and common ones stay."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str = "", most: int = 250_000):
        super().__init__()
        self._encode, self._prefix, self._most, self._old = encode, prefix, most, {}

    def __missing__(self, piece: str) -> bytes:
        value = self._old.get(piece)
        if value is None:
            if self._prefix and (not piece or piece[0].isspace()):
                raise NoPiece
            value = self._encode(self._prefix + piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[piece] = value
        return value


class PieceEncoder:
    """Encodes whole texts piece by piece into little-endian unsigned 32-bit ids.

    ``encode`` gives the ids of one pre-token. ``special`` maps the strings that stand for one id wherever they occur to that id. They are
    cut out first, as the tokenizer does, so white space beside them is not shared with words.
    """

    def __init__(self, encode: Callable[[str], bytes], special: dict[str, int], most: int = 250_000):
        self._encode_word, self._words = encode, PieceCache(encode)
        self._pre_tokens = regex.compile(PRE_TOKEN).findall
        self._first = PieceCache(self._encode_piece, "", 50_000)
        self._spaced = PieceCache(self._encode_piece, " ", most)
        self._special = {name: id.to_bytes(4, "little") for name, id in special.items()}
        self._marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __call__(self, text: str) -> bytes:
        # One search a string is much faster than the pattern, which tries all of them at each character.
        if not any(name in text for name in self._special):
            return self._plain(text)
        out, end = [], 0
        for mark in self._marks.finditer(text):
            out += [self._plain(text[end : mark.start()]), self._special[mark.group()]]
            end = mark.end()
        return b"".join([*out, self._plain(text[end:])])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some texts. A piece is looked up once for all of them, and its ids are copied to its places by array."""
        marked = {i: self(text) for i, text in enumerate(texts) if any(name in text for name in self._special)}
        parts = [[] if not text or i in marked else lines(text) for i, text in enumerate(texts)]
        every = [line for part in parts for line in part]
        split = pa.compute.split_pattern(pa.array(every, pa.string()), " ")
        starts = split.offsets.to_numpy()
        is_first = np.zeros(len(split.values), bool)
        is_first[starts[:-1]] = True
        heads = split.values.filter(pa.array(is_first)).to_pylist()
        spaced = split.values.filter(pa.array(~is_first)).dictionary_encode()
        names, codes = spaced.dictionary.to_pylist(), spaced.indices.to_numpy()

        # Lines in which white space follows a space are cut otherwise, and are put in whole for their first pieces.
        no_pieces = np.array([not name or name[0].isspace() for name in names], bool)
        whole = np.zeros(len(every), bool)
        if no_pieces.any():
            line_of = np.repeat(np.arange(len(every)), np.diff(starts) - 1)
            whole[line_of[no_pieces[codes]]] = True
            codes = np.where(whole[line_of], len(names), codes)
            used = np.bincount(codes, minlength=len(names) + 1)[:-1] > 0
            names = [name if is_used else None for name, is_used in zip(names, used.tolist())]
        ids = [b"" if name is None else self._spaced[name] for name in names]
        ids.append(b"")
        line_break, at = self._first["\n"], 0
        for part in parts:
            for i in range(at, at + len(part)):
                if whole[i]:
                    head = self._joined(_CUT.split(every[i]))
                else:
                    head = self._first[heads[i]] if heads[i] else b""
                ids.append(line_break + head if i > at else head)
            at += len(part)

        place = np.empty(len(is_first), np.int64)
        place[~is_first] = codes
        place[is_first] = len(names) + 1 + np.arange(len(every))
        size = np.array([len(i) // 4 for i in ids], np.int64)
        begin, sizes = np.cumsum(size) - size, size[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        from_ = np.repeat(begin[place] - ends[:-1], sizes) + np.arange(ends[-1])
        out = np.frombuffer(b"".join(ids), "<u4")[from_].tobytes()
        bounds = 4 * ends[starts[np.cumsum([0, *map(len, parts)])]]
        return [marked[i] if i in marked else out[a:b] for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist()))]

    def _encode_piece(self, piece: str) -> bytes:
        letters = piece.removeprefix(" ")
        if letters.isascii() and letters.isalpha():
            return self._words[piece]
        return b"".join(map(self._words.__getitem__, self._pre_tokens(piece)))

    def _plain(self, text: str) -> bytes:
        return self._first["\n"].join(map(self._line, lines(text))) if text else b""

    def _line(self, text: str) -> bytes:
        try:
            return self._joined(text.split(" "))
        except NoPiece:
            return self._joined(_CUT.split(text))

    def _joined(self, pieces: list[str]) -> bytes:
        """The ids of a text cut into pieces; all but the first have lost the one space that they begin with."""
        first, *spaced = pieces
        head = self._first[first] if first else b""
        return head + b"".join(map(self._spaced.__getitem__, spaced))


class PieceCounter(PieceEncoder):
    """Counts the tokens of whole texts by several tokenizers without special tokens, each piece once for all of them.

    ``counts`` are functions that give the number of tokens of a short text. What is kept of a piece is one number,
    ``COUNT_BITS`` bits for each tokenizer, the first lowest; equal numbers are kept once, so that kept pieces take little
    more than their texts. Numbers of pieces are added up to that of a text. Short pieces are counted whole, as cutting them
    into pre-tokens takes longer than it saves; long ones, which may be whole texts, by pre-token.
    """

    #: A text of fewer than 2^31 bytes has fewer tokens than that.
    COUNT_BITS = 32

    def __init__(self, counts: list[Callable[[str], int]], most: int = 150_000):
        super().__init__(self._count, {}, most)
        self._counts, self._numbers = counts, {}
        self._words = PieceCache(self._count, "", 50_000)

    def per_tokenizer(self, text: str) -> list[int]:
        number, low = self(text), (1 << self.COUNT_BITS) - 1
        return [number >> i * self.COUNT_BITS & low for i in range(len(self._counts))]

    def _count(self, text: str) -> int:
        number = sum(count(text) << i * self.COUNT_BITS for i, count in enumerate(self._counts))
        return self._numbers.setdefault(number, number) if len(text) <= LONGEST_KEPT else number

    def _encode_piece(self, piece: str) -> int:
        if len(piece) <= LONGEST_KEPT:
            return self._count(piece)
        return sum(map(self._words.__getitem__, self._pre_tokens(piece)))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        parts = lines(text)
        return (len(parts) - 1) * self._first["\n"] + sum(map(self._line, parts))

    def _joined(self, pieces: list[str]) -> int:
        first, *spaced = pieces
        head = self._first[first] if first else 0
        return head + sum(map(self._spaced.__getitem__, spaced))
