"""Byte-level BPE through the tokenizers library, with each distinct pre-token encoded once.

Byte-level BPE never merges across pre-tokens, so the ids of a text are its pre-tokens' ids in a row. Pre-tokens repeat
heavily: a bounded table of those met saves most of the work. A pre-token never reaches over a single space between two
other characters either, so such texts are first split there, and the parts are looked up in a table as well (a part that
is empty or has white space at an end is not in it, and tells that the text is not such a one). The
pre-token pattern is applied here by the regex module only where every character is of a block that all Unicode
versions agree on; any other text, and one that holds the string of a special token, goes whole through the library.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np

#: The pre-token pattern that the vocabulary file's byte-level pre-tokenizer applies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII text, Latin letters with their extensions, and common punctuation.
SETTLED = r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*"
#: Those of them that Latin-1 has.
SETTLED_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
#: Entries of the table of parts, and of that of pre-tokens; one that is full is emptied. About 160 and 80 MB.
PARTS, TABLE = 800_000, 400_000


def byte_letters() -> str:
    """The letters by which byte-level BPE writes the 256 bytes: visible Latin-1 as it is, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in visible else next(others)) for b in range(256))


class Pieces(dict):
    """Pre-token to the bytes of its ids (little-endian unsigned 32-bit)."""

    def __init__(self, model):
        self.tokenize = model.tokenize
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= TABLE:
            self.clear()
        value = self[piece] = self.encode(piece)
        return value

    def encode(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()


class Encoder(dict):
    """ids(text): the bytes of a text's ids. As a table: what follows a single space, up to the next, to the bytes of its ids."""

    def __init__(self, path: str, special_as_text: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        self.other = regex.compile(SETTLED).fullmatch
        self.pieces = Pieces(self.library.model)

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise KeyError(part)
        if len(self) >= PARTS:
            self.clear()
        if part.isalpha():
            value = self.pieces.encode(f" {part}")
        elif part[-1] in ",.;:!?" and part[:-1].isalpha():
            value = self[part[:-1]] + self.pieces[part[-1]]
        else:
            value = self.by_piece(f" {part}")
        self[part] = value
        return value

    def settled(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, SETTLED_BYTES)
        except UnicodeEncodeError:
            return bool(self.other(text))

    def by_piece(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.settled(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            if first and not first[-1].isspace():
                return self.by_piece(first) + b"".join(map(self.__getitem__, rest))
        except KeyError:  # white space beside a space
            pass
        return self.by_piece(text)


@functools.cache
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    return Encoder(path, special_as_text)
