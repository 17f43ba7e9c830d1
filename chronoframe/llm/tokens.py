"""Exact byte-level BPE over whole texts with the tokenizers library, behind bounded caches."""

from __future__ import annotations

import json
import os
from array import array

from chronoframe.llm.common import only

#: The library's byte-level split and the word tokenizer's split.
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters on which the library's Unicode tables and Python's agree beyond doubt; any other sends
#: the whole text to the library itself.
PLAIN = r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž‐-‧‰-›€]"


def vocabulary(name: str) -> str:
    """The tokenizer's JSON, read on the driver; some MB, bounded by the vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _byte_table() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others are moved up from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """space-delimited chunk -> little-endian int32 ids; at most `most` entries."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class ByteBpe:
    """encode(text) gives the ids of the library's encode(text, add_special_tokens=False), as bytes.

    A pre-token never reaches across a space that follows a non-space, so the pieces between single
    spaces are encoded on their own and remembered.  Texts with runs of spaces, leading spaces or
    special strings go to the library whole.
    """

    def __init__(self, vocabulary_json: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary_json)
        self.model, self.split, self.table = self.whole.model, regex.compile(BYTE_SPLIT).findall, _byte_table()
        spec = json.loads(vocabulary_json)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.words, self.bits = _Words(self._chunk, most), _Words(self._piece, 100_000)
        self.marks = {mark: self._pieces(mark) for mark in ".,;:!?"}

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # these stand for themselves, but for the space
            own = piece.replace(" ", "Ġ")
        else:
            own = piece.encode().decode("latin-1").translate(self.table)
        return array("i", [t.id for t in self.model.tokenize(own)]).tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.bits.__getitem__, self.split(text)))

    def _chunk(self, rest: str) -> bytes:
        """A space and `rest`; a word with one mark behind it is the word's ids and the mark's."""
        if rest.isalpha():
            piece = "Ġ" + (rest if rest.isascii() else rest.encode().decode("latin-1").translate(self.table))
            return array("i", [t.id for t in self.model.tokenize(piece)]).tobytes()
        if rest[-1:] in self.marks and rest[:-1].isalpha():
            return self.words[rest[:-1]] + self.marks[rest[-1]]
        return self._pieces(" " + rest)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or "  " in text or any(s in text for s in self.special):
            return array("i", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        head, *rest = text.split(" ")
        found = [self._pieces(head), *map(self.words.get, rest)]
        try:  # what isn't known yet, one after the other
            at = 0
            while True:
                at = found.index(None, at)
                found[at] = self.words[rest[at - 1]]
        except ValueError:
            return b"".join(found)


class WordCounts:
    """count(text): how many tokens the word tokenizer gives, by pre-token lengths.

    First the broadcast table of frequent pre-tokens, then this worker's bounded cache, then the
    library's model on the one pre-token.  Texts with special strings or with characters outside
    PLAIN go to the library whole.
    """

    def __init__(self, vocabulary_json: str, frequent: dict[str, int], most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary_json)
        self.model, self.split, self.table = self.whole.model, regex.compile(WORD_SPLIT).findall, _byte_table()
        self.odd = regex.compile(PLAIN).search
        self.special = [x["content"] for x in json.loads(vocabulary_json).get("added_tokens") or []]
        self.frequent = frequent
        self.words = _Words(self._length, most)

    def _length(self, word: str) -> int:
        return len(self.model.tokenize(word.encode().decode("latin-1").translate(self.table)))

    def pre_tokens(self, text: str) -> list[str] | None:
        """Pre-tokens in order, or None where only the library's own normalizer is sure."""
        if self.odd(text) or any(s in text for s in self.special):
            return None
        return self.split(text.lower())

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = self.pre_tokens(text)
        if words is None:
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        known, more, total = self.frequent.get, self.words, 0
        for word in words:
            n = known(word)
            total += more[word] if n is None else n
        return total


def byte_bpe(vocabulary_json: str, most: int = 1_000_000) -> ByteBpe:
    """One encoder a worker process, vocabulary and cache size."""
    return only(("byte_bpe", hash(vocabulary_json), most), lambda: ByteBpe(vocabulary_json, most))
