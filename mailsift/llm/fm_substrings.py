"""Substring dedup by a compressed FM-index per shard.

Finds every window of ``length`` words that also stands elsewhere and removes
the words such windows cover. Shards hold all segments (see ``routing``) of
their keys, equal segments twice. A shard puts its
segments behind one another, sorts their suffixes by the first ``length``
words (doubling the compared length), and keeps the Burrows-Wheeler transform
in a wavelet tree (level by level, one bit a symbol and level, with rank
directories). The segments, one of equal ones, are then streamed through it from
their last word to their first, all at once: one backward step extends each match by a word.
The matching statistic of a place is capped at ``length``: after a full match
the interval is widened to the one of its first ``length`` - 1 words, so the
next step answers for the next window. Intervals above the threshold of one
occurrence are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows
from .routing import Words, covered, document_id, flagged_windows, keyed_documents, repeated_windows, shard_runner

GRAM = 8
SHARD_BYTES = 1 << 20


def _ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    s = values[order]
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1]))
    return rank


class BitVector:
    """Bits in 64-bit words with a count before each word."""
    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))[:-1]
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletTree:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        s = symbols
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (s >> shift & 1).astype(np.uint8)
            self.levels.append((shift, BitVector(bit)))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.origin = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.ones(i)
            i = np.where(c >> shift & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol c before position i."""
        return self._down(c, i) - self.origin[c]


class FmIndex:
    """Index of a word sequence that answers for patterns of up to ``length`` words."""
    def __init__(self, text: np.ndarray, length: int):
        n = len(text)

        def ahead(x, by):
            return np.concatenate([x[by:], np.zeros(min(by, n), dtype=np.int64)])

        name, reach = text.astype(np.int64), 1
        while reach * 2 <= length - 1:
            name = _ranks(name << 32 | ahead(name, reach)) + 1
            reach *= 2
        order_key = name << 32 | ahead(name, length - reach)
        order = np.argsort(order_key)
        shorter = (name << 32 | ahead(name, length - 1 - reach))[order]
        edge = np.append(True, shorter[1:] != shorter[:-1])
        at = np.arange(n)
        #: for each place of the order, the interval with the same first length-1 words
        self.low = np.maximum.accumulate(np.where(edge, at, 0))
        last = np.append(edge[1:], True)
        self.high = np.minimum.accumulate(np.where(last, at + 1, n)[::-1])[::-1]
        sigma = int(text.max(initial=0)) + 1
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))[:-1]
        self.tree = WaveletTree(text[order - 1], sigma)  # the word before each suffix
        self.n = n

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of c followed by what [low, high) stands for."""
        return self.first[c] + self.tree.rank(c, low), self.first[c] + self.tree.rank(c, high)


def repeated(segments: list[np.ndarray], windows: np.ndarray, length: int, asked: np.ndarray) -> np.ndarray:
    """For each window of the asked segments: does the index of all segments hold it twice?"""
    sizes = np.array([len(s) for s in segments])
    base = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), dtype=np.int64)  # 0 behind each segment
    text[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = np.concatenate(segments)
    index = FmIndex(text, length)
    sizes, base, windows = sizes[asked], base[asked], windows[asked]
    out = np.zeros(int(windows.sum()), dtype=bool)
    slot = np.cumsum(windows) - windows
    by = np.argsort(-sizes, kind="stable")
    live_sizes, base, slot = sizes[by], base[by], slot[by]
    low = np.zeros(len(by), dtype=np.int64)
    high = np.full(len(by), index.n, dtype=np.int64)
    for t in range(int(live_sizes[0])):
        live = int(np.searchsorted(-live_sizes, -t, side="left"))  # segments longer than t
        at = live_sizes[:live] - 1 - t
        low, high = index.step(text[base[:live] + at], low[:live], high[:live])
        if t >= length - 1:
            out[slot[:live] + at] = high - low > 1
            low, high = index.low[low], index.high[low]
    return out


def _decide(length: int):
    def decide(segments: list[bytes], windows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        known: dict[bytes, int] = {}
        coded = [np.array([known.setdefault(w, len(known) + 1) for w in s.split(b" ")], dtype=np.int64) for s in segments]
        return repeated(coded, windows, length, asked)
    return decide


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without runs of words; all other white space stays: a run goes
    with what stands between it and the next word, the last run with what stands
    before it."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for lo, hi in runs:
        if hi < len(words):
            out.append(text[at:words[lo][0]])
            at = words[hi][0]
        else:
            out.append(text[at:words[lo - 1][1] if lo and at <= words[lo - 1][0] else words[lo][0]])
            at = words[hi - 1][1]
    return b"".join([*out, text[at:]])


def _remove(length: int, own: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            n, removed, spans, kept, left = [], [], [], [], []
            for text, starts in zip(b.column("text").to_pylist(), flagged_windows(b.column("flags")), strict=True):
                words = text.split()
                n.append(len(words))
                runs = []
                if starts is not None:
                    gone = covered(len(words), length, starts)
                    edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                    runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                left.append(_without(text, runs) if runs else None)
                for lo, hi in reversed(runs):
                    del words[lo:hi]
                removed.append(n[-1] - len(words))
                spans.append([{"first": lo, "end": hi} for lo, hi in runs])
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in own), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary()), pa.array(left, pa.binary())],
                [*own, "n_words", "n_removed", "spans", "kept", "left"])
    return run


def remove_repeated_passages(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text",
                             carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept, left) of every document: the words
    that lie in a window of ``length`` words standing at two places or more are
    removed; ``spans`` are the removed runs of words, ``kept`` the words left,
    joined by one space (UTF-8 bytes), ``left`` the text without the removed runs and
    with its own white space (null: nothing was removed). Windows are judged on the input and never
    cross documents; words are split at ASCII white space and compared unchanged.

    Defined cases: null, empty and blank texts have no words; texts shorter than
    a window keep everything; every row is a document, so repeated rows repeat
    each other, also those with equal or null ids; an empty table gives no rows;
    other columns are ignored."""
    if length < GRAM + 2:
        raise ValueError(f"length must be {GRAM + 2} words or more")
    own = keyed_documents(docs, id_col, text_col, carry)
    marked = repeated_windows(own, Words, GRAM, length, shard_runner(SHARD_BYTES, _decide(length)))
    also = [f"_{i}" for i in range(len(carry))]
    rows = own.join(marked, ["k", "tk"], "left").select(document_id(), *also, "text", "flags")
    kinds = ", ".join(["doc_id long", *(f"{c} {own.schema[c].dataType.simpleString()}" for c in also)])
    done = rows.mapInArrow(_remove(length, ["doc_id", *also]), f"{kinds}, n_words long, n_removed long, "
                           "spans array<struct<first: bigint, end: bigint>>, kept binary, left binary")
    return done.select("doc_id", *(F.col(a).alias(c) for a, c in zip(also, carry, strict=True)),
                       "n_words", "n_removed", "spans", "kept", "left")
