"""Encoding whole texts with a tokenizers file, one encoder per Python worker.

For byte-level tokenizers without a normalizer, a text is cut into pieces (words
with the space before them, runs of digits, signs or white space) and each piece
is encoded by itself. Pieces repeat a lot, so each distinct one goes to the
library's model once per worker and its ids are kept (twice ``CACHED`` pieces at
most; results do not depend on it). Texts that hold the string of an added token,
and all texts under any other kind of tokenizer, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import regex

CACHED = 250_000
#: The pieces that byte-level tokenizers encode one by one, in Unicode classes,
#: and the same for texts of ``plain_characters`` in those of ``re`` (fixed values).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Unicode white space, as the tokenizers' patterns take it (fixed value).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENCODERS: dict[str, TextEncoder] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def plain_characters(end: int = 0x2070) -> str:
    """The characters below ``end`` that the classes of ``re`` tell apart just
    like Unicode's letters, numbers and white space, as the inside of a class."""
    space = re.compile(f"[{SPACE}]").match
    good = []
    for c in map(chr, range(end)):
        kind = unicodedata.category(c)[0]
        want = (kind == "L", kind == "N", space(c) is not None)
        if want == (re.match(r"[^\W\d_]", c) is not None, re.match(r"\d", c) is not None, re.match(r"\s", c) is not None):
            good.append(c)
    return "".join(map(re.escape, good))


class Kept(dict):
    """Values made on demand and kept, in two generations: when the newer one
    is full it becomes the older one, whose entries come back when asked for.
    Frequent keys so stay, and memory is bounded by ``2 * size`` entries."""

    def __init__(self, make, size: int = CACHED):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A very long text in parts, cut before single spaces between words, where
    a piece begins in any case."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                        and pre.get("use_regex", True) and not pre.get("add_prefix_space", True))
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.ids = Kept(self._encode_piece)
        self.odd = re.compile(f"[^{plain_characters()}]").search
        self.plain_pieces = re.compile(PLAIN_PIECES).findall
        self.pieces = regex.compile(PIECES).findall
        self.units = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

    def _encode_piece(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_piece or self.added is not None and self.added.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._encode_slice, slices(text)))

    def _encode_slice(self, text: str) -> bytes:
        if self.odd(text):  # white space by its own class first, then the Unicode classes
            return b"".join([self.ids[piece] for unit in self.units(text) for piece in self.pieces(unit)])
        return b"".join(map(self.ids.__getitem__, self.plain_pieces(text)))


def encoder(path: str) -> TextEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
