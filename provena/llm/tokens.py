"""Exact, cached tokenisation: texts are cut where a tokenizer cannot join, and pieces are encoded once.

Both tokenizer files used here split words before their merges run, and no word holds white
space behind a visible character, or letters before one of ``SIGNS``. So a text may be cut
there and encoded piecewise, with the same ids as in one go. Characters on whose kind the
libraries may disagree send the whole text through the tokenizer.
"""

from __future__ import annotations

import os
import re
from struct import pack

import numpy as np

from provena.llm.common import held

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Signs that both files split off letters before them.
SIGNS = ".,;:!?$&%*#"
PIECE = re.compile(rf" ?[{LETTERS}]+(?=[{SIGNS}\s]|$)|[{SIGNS}]+(?=\s|$)|\n(?=[{LETTERS}])|\s*\S+|\s+")
#: The same without white space, for tokenizers that drop it.
BARE = re.compile(rf"[{LETTERS}]+(?=[{SIGNS}\s]|$)|[{SIGNS}]+(?=\s|$)|\S+")
WORD = re.compile(rf" ?[{LETTERS}]+|[{SIGNS}]+")
UNSURE = "\x1c\x1d\x1e\x1f\x85\u180e"
#: Outside these, lower case may differ between libraries or stand for more characters.
PLAIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: About the bytes kept per generation, of two, and the longest piece kept; both bound a worker's memory.
KEPT, LONGEST = 40_000_000, 40


def unsure(text: str) -> bool:
    """Whether a text holds one of ``UNSURE``; finding single characters is many times faster than matching a class of them."""
    return any(map(text.__contains__, UNSURE))


def plain(text: str) -> bool:
    """Whether a text has no character of ``PLAIN``; one that is Latin-1 can't have any."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not PLAIN.search(text)
    return True


def encoder(path: str, offsets: bool = False) -> "Encoder":
    """One encoder for each Python worker, so that its cache serves all tasks of the worker."""
    return held(("encoder", path, offsets), lambda: Encoder(path, offsets))


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Pieces(dict):
    """Piece to encoded bytes, in two generations of bounded size; what is missing is encoded on the way."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old, self.size = encode, {}, 0

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = got
            self.size += 170 + len(piece) + len(got)  # two objects and their place in the table
        return got

    def turn(self) -> None:
        if self.size > KEPT:
            self.old, self.size = dict(self), 0
            self.clear()


class Encoder:
    def __init__(self, path: str, offsets: bool = False, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.offsets = Tokenizer.from_file(path), offsets
        self.tokenizer.encode_special_tokens = plain  # special tokens' strings are text like any other
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.bare = "Lowercase" in repr(self.tokenizer.normalizer)
        self.known = Pieces(self._spans if offsets else self._piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece; one word goes straight to the merges."""
        if not WORD.fullmatch(piece) or self.bare and piece != piece.lower():
            return self._whole(piece)
        shown = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return pack(f"<{len(ids)}I", *ids)

    def _spans(self, text: str) -> bytes:
        x = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array([(i, a, b) for i, (a, b) in zip(x.ids, x.offsets, strict=True)], "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        self.known.turn()
        find, known = (BARE if self.bare else PIECE).findall, self.known.__getitem__
        out = []
        for text in texts:
            if unsure(text):
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(known, find(text.lower() if self.bare and plain(text) else text))))
        return out

    def spans(self, text: str) -> np.ndarray:
        """Rows (id, first code point, end) of one whole text; needs ``offsets``."""
        if unsure(text):
            return np.frombuffer(self._spans(text), "<u4").reshape(-1, 3).astype(np.int64)
        self.known.turn()
        pieces = PIECE.findall(text)
        got = [*map(self.known.__getitem__, pieces)]
        rows = np.frombuffer(b"".join(got), "<u4").reshape(-1, 3).astype(np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.repeat(np.cumsum(sizes) - sizes, np.fromiter(map(len, got), np.int64, len(got)) // 12)
        rows[:, 1] += begins
        rows[:, 2] += begins
        return rows
