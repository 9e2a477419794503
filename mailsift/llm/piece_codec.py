"""SentencePiece encoding and decoding that keeps source offsets.

A text is normalized by the model's compiled character map: at each place the
longest key of the map that is a prefix of the rest is replaced, and every
normalized character remembers where in the source it came from. The normalized
text is cut into symbols, neighbours are merged by the highest score (leftmost
among equals), characters without a piece become byte pieces, and each piece is
projected through the remembered places to its span of source bytes.

Pieces hold the space mark only in front and some characters stand in no longer
piece at all, both read off the vocabulary: there no merge can cross, so the
stretches between are encoded on their own and each worker keeps the ids of
those it has seen, within a bound.

Covers BPE models with byte fallback, the space mark as prefix, and no pieces
defined by the user.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Kept, slices

#: The mark that stands for a space in pieces (fixed value).
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CODECS: dict[str, PieceCodec] = {}


def character_map(blob: bytes) -> dict[str, str]:
    """Keys and values of a compiled character map: the length of a double-array
    trie, its 32-bit units, and the values it points at, each ended by a zero.
    All nodes of a depth are opened at once."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4:4 + size], "<u4").astype(np.int64)
    values = blob[4 + size:]

    def first_child(unit):
        return (unit >> 10) << ((unit & 512) >> 6)

    found: dict[str, str] = {}
    nodes, keys = np.array([first_child(units[0])]), [b""]
    labels = np.arange(1, 256)
    while len(nodes):
        child = nodes[:, None] ^ labels
        inside = child < len(units)
        unit = units[np.where(inside, child, 0)]
        row, col = np.nonzero(inside & ((unit & 0x800000FF) == labels))
        unit, at = unit[row, col], child[row, col]
        keys = [keys[r] + bytes([c + 1]) for r, c in zip(row, col, strict=True)]
        nodes = at ^ first_child(unit)
        for i in np.flatnonzero((unit >> 8) & 1):
            start = int(units[nodes[i]] & 0x7FFFFFFF)
            found[keys[i].decode()] = values[start:values.index(b"\0", start)].decode()
    return found


class PieceCodec:
    def __init__(self, model: bytes):
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        spec = ModelProto()
        spec.ParseFromString(model)
        train, norm = spec.trainer_spec, spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if (train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or USER in kinds
                or not norm.escape_whitespaces or spec.denormalizer_spec.precompiled_charsmap):
            raise ValueError("a SentencePiece model of a kind that this operator does not cover")
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.map = character_map(norm.precompiled_charsmap)
        self.key_lengths: dict[str, list[int]] = {}
        for key in self.map:
            self.key_lengths.setdefault(key[0], []).append(len(key))
        for lengths in self.key_lengths.values():
            lengths[:] = sorted(set(lengths), reverse=True)
        starts = "".join(map(re.escape, self.key_lengths))
        self.mapped = re.compile(f"[{starts}]") if starts else None
        self.scores: dict[str, float] = {}  # negated: the smallest goes first
        self.no_score = float("inf")
        self.ids: dict[str, int] = {}
        self.unused: set[str] = set()
        self.parts: dict[str, tuple[str, str]] = {}  # of unused pieces
        self.byte_ids = [0] * 256
        n = len(spec.pieces)
        self.raw, self.control = [b""] * n, np.zeros(n, dtype=bool)
        self.byte_value = np.full(n, -1, dtype=np.int32)
        self.width = np.zeros(n, dtype=np.int32)  # normalized bytes of a piece
        self.source_width = np.zeros(n, dtype=np.int32)  # source bytes, a mark being one space
        self.marked = np.zeros(n, dtype=bool)
        for i, p in enumerate(spec.pieces):
            if p.type in (NORMAL, UNUSED):
                self.scores[p.piece], self.ids[p.piece] = -p.score, i
                if p.type == UNUSED:
                    self.unused.add(p.piece)
                self.raw[i] = p.piece.replace(MARK, " ").encode()
                self.width[i], self.source_width[i] = len(p.piece.encode()), len(self.raw[i])
                self.marked[i] = p.piece.startswith(MARK)
            elif p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value], self.byte_value[i], self.raw[i] = i, value, bytes([value])
                self.width[i] = self.source_width[i] = 1
            elif p.type == CONTROL:
                self.control[i] = True
            else:
                self.unknown, self.raw[i] = i, train.unk_surface.encode()
        self.units = self._forced_units()
        self.unit_ids = Kept(self._merge, 300_000)

    def _forced_units(self):
        """Stretches that no piece reaches across, as a pattern's ``findall``."""
        longer = [p for p in self.scores if len(p) > 1]
        joined = {c for p in longer for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        if any(MARK in p.lstrip(MARK) for p in longer):
            return re.compile(f"[{alone}]|[^{alone}]+" if alone else r"(?s).+").findall
        return re.compile(f"{f'[{alone}]|' if alone else ''}{MARK}*[^{MARK}{alone}]+|{MARK}+").findall

    def _merge(self, unit: str) -> bytes:
        """Ids of one stretch: the neighbours whose joined piece scores highest,
        leftmost among equals, are merged until none is left."""
        merged = self._merge_short(list(unit)) if len(unit) <= 64 else self._merge_long(list(unit))
        ids: list[int] = []
        scores, stack = self.scores, merged[::-1]
        while stack:
            piece = stack.pop()
            if piece in self.unused and len(piece) > 1:  # falls apart again
                stack.extend(reversed(self.parts[piece]))
            elif piece in scores:
                ids.append(self.ids[piece])
            else:
                ids.extend(self.byte_ids[b] for b in piece.encode())
        return array("i", ids).tobytes()

    def _merge_short(self, s: list[str]) -> list[str]:
        """The best neighbours by a look at all of them."""
        get, none = self.scores.get, self.no_score
        costs = [get(a + b, none) for a, b in zip(s, s[1:], strict=False)]
        while costs and (best := min(costs)) < none:
            i = costs.index(best)
            left, right = s[i:i + 2]
            s[i:i + 2] = [piece := left + right]
            if piece in self.unused:
                self.parts[piece] = (left, right)
            del costs[i]
            if i < len(costs):
                costs[i] = get(piece + s[i + 1], none)
            if i:
                costs[i - 1] = get(s[i - 1] + piece, none)
        return s

    def _merge_long(self, s: list[str | None]) -> list[str]:
        """The same with a heap of places, n log n."""
        scores, none = self.scores, self.no_score
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = [(scores[a + b], i, a, b) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in scores]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if s[i] != left or j >= len(s) or s[j] != right:
                continue
            s[i], s[j] = (piece := left + right), None
            if piece in self.unused:
                self.parts[piece] = (left, right)
            after[i] = k = after[j]
            if k < len(s):
                before[k] = i
                if (cost := scores.get(piece + s[k], none)) < none:
                    heapq.heappush(heap, (cost, i, piece, s[k]))
            if (h := before[i]) >= 0 and (cost := scores.get(s[h] + piece, none)) < none:
                heapq.heappush(heap, (cost, h, s[h], piece))
        return [x for x in s if x is not None]

    def _chunks(self, text: str) -> Iterator[tuple[str, str]]:
        """Source stretches and what the character map makes of them."""
        at = 0
        while self.mapped is not None and (m := self.mapped.search(text, at)):
            i = m.start()
            if i > at:
                yield text[at:i], text[at:i]
            for n in self.key_lengths[text[i]]:
                if text[i:i + n] in self.map:
                    yield text[i:i + n], self.map[text[i:i + n]]
                    at = i + n
                    break
            else:
                yield text[i], text[i]
                at = i + 1
        if at < len(text):
            yield text[at:], text[at:]

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalized text with marks for spaces, and the source byte of each
        of its bytes, with the end appended (right at character bounds)."""
        out: list[str] = []
        places: list[np.ndarray] = []
        at, space_before, begun = 0, self.squeeze, False
        for source, norm in self._chunks(text):
            width = len(source.encode())
            same = source == norm
            step = 0  # source bytes before the part of norm in hand
            for part in re.findall(" +|[^ ]+", norm) or [""]:
                wide = len(part.encode())
                place = at + (step if same else 0)
                step += wide
                if not begun and not (self.squeeze and part[:1] == " " and (same or norm == " ")):
                    begun = True
                    if self.dummy:
                        out.append(MARK)
                        places.append(np.full(3, place))
                if part[:1] == " ":
                    kept = part if not self.squeeze else "" if space_before else " "
                    out.append(MARK * len(kept))
                    places.append(np.repeat(place + (np.arange(len(kept)) if same else np.zeros(len(kept), int)), 3))
                    space_before = self.squeeze
                elif part:
                    out.append(part)
                    places.append(place + np.arange(wide) if same else np.full(wide, place))
                    space_before = False
            at += width
        normal, places = "".join(out), np.concatenate([*places, [at]]).astype(np.int64)
        if self.squeeze:
            while normal.endswith(MARK):
                normal, places = normal[:-1], places[:-3]
        return normal, places

    @property
    def plain(self) -> bool:
        """Spaces become marks and nothing else changes."""
        return not self.map and self.dummy and not self.squeeze

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit little-endian bytes."""
        if not text:
            return b""
        if not self.plain:
            return b"".join(map(self.unit_ids.__getitem__, self.units(self.normalize(text)[0])))
        out, mark = [], MARK
        for part in slices(text):
            out.extend(map(self.unit_ids.__getitem__, self.units(mark + part.replace(" ", MARK))))
            mark = ""
        return b"".join(out)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end source byte of each piece of ``encode(text)``. Of the
        byte pieces of a character the last one has its span, the others none."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        if self.plain and MARK not in text:
            ends = np.cumsum(self.source_width[ids], dtype=np.int64)
            starts = np.maximum(ends - self.source_width[ids] - 1, 0)
            ends -= 1  # the mark in front
        else:
            places = self.normalize(text)[1]
            ends = np.cumsum(self.width[ids], dtype=np.int64)
            starts, ends = places[ends - self.width[ids]], places[ends]
        value = self.byte_value[ids]
        inner = (value & 0xC0) == 0x80
        inner &= value >= 0
        if inner.any():
            first = np.maximum.accumulate(np.where(inner, 0, np.arange(len(ids))))
            starts = starts[first]
            ends = np.where(np.append(inner[1:], False), starts, ends)
        return starts.astype(np.int32), ends.astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the one in front goes, control
        pieces have no text, bytes that form no character are U+FFFD each."""
        if ids and self.plain and self.marked[ids[0]] and self.unknown not in ids:
            try:
                return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]
            except UnicodeDecodeError:
                pass
        out, run, front, seen = [], bytearray(), True, False
        for i in [*ids, None]:
            if i is not None and self.byte_value[i] >= 0:
                run.append(self.byte_value[i])
                continue
            out.append(_characters(bytes(run)))
            run.clear()
            if i is None:
                break
            front = front and not (seen or any(out))
            piece = self.raw[i].decode()
            if strip := front and (self.dummy or self.squeeze) and self.marked[i]:
                piece = piece[1:]
            seen = strip and not self.squeeze
            out.append(piece)
        return "".join(out)


def _characters(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in range(4, 0, -1):
            try:
                c = run[at:at + n].decode()
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out.append(c)
                at += n
                break
        else:
            out.append("�")
            at += 1
    return "".join(out)


def codec(path: str) -> PieceCodec:
    """This worker's codec for a model file."""
    if path not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path] = PieceCodec(f.read())
    return _CODECS[path]


def _run(path: str, batch_bytes: int = 6 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id")
            lo = 0
            while lo < b.num_rows:
                hi, size = lo, 0
                ends, ids, starts, stops, decoded = [0], [], [], [], []
                while hi < b.num_rows and size < batch_bytes:
                    text = texts[hi].as_py()
                    one = np.frombuffer(pieces.encode(text), np.int32)
                    first, end = pieces.spans(text, one)
                    ids.append(one)
                    starts.append(first)
                    stops.append(end)
                    decoded.append(pieces.decode(one.tolist()))
                    size += 4 * len(one)
                    ends.append(size // 4)
                    hi += 1
                at = pa.array(np.array(ends, np.int32))
                listed = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (ids, starts, stops)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), *listed, pa.array(decoded, pa.string())],
                                                 ["doc_id", "ids", "starts", "ends", "decoded"])
                lo = hi
    return run


def encode_with_offsets(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) of every whole text, one row per row
    of ``docs``; piece i covers the source bytes from ``starts[i]`` to ``ends[i]``.

    Defined cases: null and empty texts have no pieces and decode to ''; repeated
    rows, equal and null ids are kept row by row; a very long word costs
    n log n; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_run(model), "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")
