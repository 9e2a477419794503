"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that stand next to each other inside no token of the
vocabulary can never be merged into one token, directly or later, so a cut
between them is certain. A word is split at all such places, the fragments are
encoded on their own (lowest merge rank first, leftmost among equals) and their
ids are put together again. Words and fragments repeat, so each worker keeps
the ids of those it has seen, within a bound.

Covers tokenizers files with a BPE model: a normalizer made of NFC, white-space
replacement and lower-casing, a split pattern whose matches are kept, byte-level
symbols and a word-end suffix; added tokens in a text are taken out first.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SPACE, Kept, byte_symbols, slices

_CODECS: dict[str, ForcedBpe] = {}


class ForcedBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel"
                or level["use_regex"] or not split["invert"] or spec.get("decoder") is not None):
            raise ValueError("a tokenizers file of a kind that this operator does not cover")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.find_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.chunks = regex.compile(f"[^{SPACE}]+").findall
        self.inside = self._inside()
        self.fragment_ids = Kept(self._merge, 300_000)
        self.chunk_ids = Kept(self._encode_chunk, 300_000)
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def _inside(self) -> set[tuple[str, str]]:
        """The symbol pairs that stand next to each other inside some token."""
        found = set()
        for token in self.vocab:
            s = self._token_symbols(token)
            found.update(zip(s, s[1:], strict=False))
        return found

    def _token_symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            s = list(token[:-len(self.suffix)])
            s[-1] += self.suffix
            return s
        return list(token)

    def fragments(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """The symbols of a word, cut wherever a boundary is forced."""
        out, start, inside = [], 0, self.inside
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in inside:
                out.append(tuple(symbols[start:i]))
                start = i
        out.append(tuple(symbols[start:]))
        return out

    def _merge(self, fragment: tuple[str, ...]) -> bytes:
        """Ids of one fragment: the pair of lowest rank, leftmost among equals,
        is merged until none is left; a heap of places keeps long ones cheap."""
        s: list[str | None] = list(fragment)
        after = list(range(1, len(s) + 1))
        before = list(range(-1, len(s) - 1))
        ranks = self.ranks
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, (left, right) = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j >= len(s) or s[j] != right:
                continue
            s[i], s[j] = left + right, None
            after[i] = k = after[j]
            if k < len(s):
                before[k] = i
                if (p := (s[i], s[k])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, p))
            h = before[i]
            if h >= 0 and (p := (s[h], s[i])) in ranks:
                heapq.heappush(heap, (ranks[p], h, p))
        return array("i", [self.vocab[x] for x in s if x is not None]).tobytes()

    @staticmethod
    def _lower(text: str) -> str:
        # one character at a time: no final-sigma rule
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def _encode_chunk(self, chunk: str) -> bytes:
        text = self._lower(unicodedata.normalize("NFC", chunk))
        out = b""
        for piece in self.pieces(text):
            symbols = [self.symbols[b] for b in piece.encode()]
            symbols[-1] += self.suffix
            if len(symbols) <= 32:
                out += b"".join(map(self.fragment_ids.__getitem__, self.fragments(symbols)))
            else:
                out += b"".join([self.fragment_ids[f] for f in self.fragments(symbols)])
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit little-endian bytes. The pattern matches
        nothing across white space, so runs of other characters are encoded
        one by one."""
        if self.find_added is not None and self.find_added.search(text):
            return b"".join(array("i", [self.added[part]]).tobytes() if part in self.added
                            else self._encode_plain(part) for part in self.find_added.split(text))
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        # str.split() takes four more characters as white space
        split = self.chunks if any(c in text for c in "\x1c\x1d\x1e\x1f") else str.split
        return b"".join([b"".join(map(self.chunk_ids.__getitem__, split(part))) for part in slices(text)])

    def decode(self, ids) -> str:
        """The tokens' strings joined by one space, as a file without decoder has it."""
        return " ".join(map(self.names.__getitem__, ids))


def codec(path: str) -> ForcedBpe:
    if path not in _CODECS:
        _CODECS[path] = ForcedBpe(path)
    return _CODECS[path]


def _run(path: str, batch_bytes: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            lo = 0
            while lo < len(texts):
                hi, size, out = lo, 0, []
                while hi < len(texts) and size < batch_bytes:
                    out.append(bpe.encode(texts[hi]))
                    size += len(out[-1])
                    hi += 1
                flat = np.frombuffer(b"".join(out), dtype=np.int32)
                ends = np.append(0, np.cumsum([len(x) // 4 for x in out])).astype(np.int32)
                listed = flat.tolist()
                decoded = [bpe.decode(listed[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"])
                lo = hi
    return run


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text, one row per row of ``docs``.

    Defined cases: null and empty texts have no ids and decode to ''; repeated
    rows, equal and null ids are kept row by row; a very long word costs
    n log n; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_run(tokenizer), "doc_id long, ids array<int>, decoded string")
