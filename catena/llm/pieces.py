"""Token ids by the tokenizers library, a cached piece at a time.

The vocabularies used here split at single spaces and newlines, whatever the
rest of the text: the byte-level one puts the space in front of the next word
and makes the newline a word, the word one drops both. So the ids of a text are
those of its pieces, and most pieces have been seen before. A text in which
white space touches white space is cut only at spaces that don't.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from catena.llm.common import worker_cache

#: Pieces that a worker keeps in each of two generations.
CACHE = 125_000
#: Characters of the longest piece that is kept; of longer ones' ids nothing is.
LONG = 64
_INNER = re.compile(r"(?<=\S) (?=\S)")
_NEAR_WHITE = re.compile(r"\n(?:(?<=\s\n)|(?=\s)|\Z)|\A\n")
_NEWLINE = ("\n",)
#: What the vocabulary without lead, which lower-cases letter by letter, may not read as str.lower() does, and special tokens.
_KEEPS_CASE = re.compile(r"[^\x00-\u024f]|<").search
#: Letters up to U+024F. No dotted capital I: lower-cased it ends in a mark, which joins the marks behind it.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: A letter or digit with ASCII marks behind it, where both vocabularies begin a new word. No apostrophe, which may
#: begin a contraction, and no <, with which special tokens begin.
_ENDED = re.compile(rf"([^<]*[0-9{_LETTERS}])([!-&(-/:;=-@\[-`{{-~]+)\Z", re.DOTALL)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


def split_pieces(text: str, lead: str) -> list:
    """A text's pieces; one that takes no lead is in a tuple of its own, which makes it another key of the cache."""
    if not lead:
        if not _KEEPS_CASE(text):
            text = text.lower()
        return text.replace("\n", " ").split(" ")
    if "  " in text or "\n" in text and _NEAR_WHITE.search(text):
        pieces = _INNER.split(text)
        pieces[0] = (pieces[0],)
        return pieces
    out: list = []
    for line in text.split("\n"):
        pieces = line.split(" ")
        pieces[0] = (pieces[0],)
        if out:
            out.append(_NEWLINE)
        out += pieces
    return out


class _Known(dict):
    """Ids by piece; what is missing comes from the generation before or is made."""

    def __init__(self, make: Callable[[_Known, str | tuple[str]], bytes], before: dict):
        self.make, self.before = make, before

    def __missing__(self, piece: str | tuple[str]) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self.make(self, piece)
        if len(piece if type(piece) is str else piece[0]) <= LONG:
            self[piece] = found
        return found


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    encode maps a string to such bytes. lead is put before each piece but a
    text's first: a space, or nothing where spaces make no ids. Known pieces
    are in two generations of at most about cache pieces: what is used again
    moves to the young one; the old one goes when that is full.
    """

    def __init__(self, encode: Callable[[str], bytes], lead: str, cache: int = CACHE):
        self.encode, self.lead, self.cache = encode, lead, cache
        self.known = _Known(self._make, {})

    def _make(self, known: _Known, piece: str | tuple[str]) -> bytes:
        alone = type(piece) is tuple
        text = piece[0] if alone else piece
        if not text.isalpha() and (cut := _ENDED.match(text)):
            base = cut.group(1)
            return known[(base,) if alone else base] + known[(cut.group(2),)]
        return self.encode(text if alone else self.lead + text)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.known) >= self.cache:
            self.known.before = {}
            self.known = _Known(self._make, self.known)
        return b"".join(map(self.known.__getitem__, split_pieces(text, self.lead)))


@worker_cache
@lru_cache(maxsize=4)
def library_encoder(path: str, lead: str) -> PieceEncoder:
    """Of a tokenizers file; one for each worker process.

    Pieces of letters are one word to either vocabulary and go to the
    library's model without its splitting; other pieces go through all of it.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    model = tok.model.tokenize
    letter = {byte: c for c, byte in byte_letters().items()}
    word = re.compile(f"[{_LETTERS}]+").fullmatch
    pack = [struct.Struct(f"<{n}I").pack for n in range(LONG)]

    def by_library(piece: str) -> bytes:
        return np.array(tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def by_model(piece: str) -> bytes:
        if not lead:
            piece = piece.lower()
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(letter)
        elif piece[0] == " ":
            piece = letter[32] + piece[1:]
        found = [t.id for t in model(piece)]
        return pack[len(found)](*found)

    def encode(piece: str) -> bytes:
        return by_model(piece) if len(piece) < LONG and word(piece, piece[:1] == " " == lead) else by_library(piece)

    # A vocabulary whose model wants other letters than the byte-level ones shows it on these.
    direct = all(by_model(p) == by_library(p) for p in (lead + "Probe", lead + "\u00dcber", "queue", "\u00e9t\u00e9"))
    return PieceEncoder(encode if direct else by_library, lead)
