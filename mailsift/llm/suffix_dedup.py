"""Suffix-array dedup by the difference-cover algorithm, distributed.

Finds every place whose next ``length`` bytes also stand elsewhere and removes
the bytes such strings cover. Shards hold all segments (see ``routing``) of
their keys, equal segments twice. A shard sorts its
windows as suffixes compared over ``length`` bytes:

1. sample the positions i with i mod 3 in {1, 2} (a difference cover of 3);
2. sort the sampled triples of names, starting from 8-byte words, and name them
   by rank; recurse on the names, each round spanning three times the bytes,
   until a name spans the whole comparison;
3. order the samples by name and last bytes, the remaining suffixes by first
   byte and the name of the sample behind it, and merge both: a remaining
   suffix meets a sample over one or two bytes and a name on each side;
4. compare adjacent prefixes of the merged order.

Names are kept below 2^21, so that a triple is one 64-bit integer to sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import few_rows
from .routing import Bytes, covered, document_id, flagged_windows, keyed_documents, repeated_windows, shard_runner

GRAM = 64
SHARD_BYTES = 1 << 19  # whole keys are added until a shard's part holds this much


def _ranks(values: np.ndarray) -> np.ndarray:
    """Names of the values: their rank among the different ones."""
    order = np.argsort(values)
    s = values[order]
    rank = np.empty(len(values), dtype=np.uint64)
    rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1])).astype(np.uint64)
    return rank


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    if max(int(x.max(initial=0)) for x in (a, b, c)) >= 1 << 21:  # a part with one very large key
        pair = _ranks(a << np.uint64(32) | b)
        return pair << np.uint64(32) | c
    return a << np.uint64(42) | b << np.uint64(21) | c


def sample_names(text: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of the next ``span`` bytes (a multiple of 3, 24 or more) at
    the sampled positions. Returns (positions, names); reads zeros past the end."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(2 * span + 16, dtype=np.uint8)]).astype(np.uint64)
    word = padded[:n + span + 8].copy()
    for i in range(1, 8):
        word = word << np.uint64(8) | padded[i:i + n + span + 8]
    name8 = _ranks(word)
    at = np.arange(n + span)
    sample = at[at % 3 != 0]
    reach = 24
    full = np.zeros(n + 3 * span + 16, dtype=np.uint64)
    wide = np.concatenate([name8, np.zeros(24, dtype=np.uint64)])
    names = _ranks(_triple(wide[sample], wide[sample + 8], wide[sample + 16]))
    while reach < span:
        full[:] = 0
        full[sample] = names
        second = min(reach, span - reach)
        third = min(2 * reach, span - reach)
        names = _ranks(_triple(full[sample], full[sample + second], full[sample + third]))
        reach = min(span, third + reach)
    return sample, names


def repeated_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each window start: does its ``length``-byte string start at another
    of the ``starts`` too?"""
    if not len(starts):
        return np.zeros(0, dtype=bool)
    span = (length - 2) // 3 * 3
    sample, names = sample_names(text, span)
    name = np.zeros(len(text) + span + 4, dtype=np.uint64)
    name[sample] = names
    bits = np.uint64(max(1, int(names.max()).bit_length()))
    t = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)

    def key(at: np.ndarray, before: int) -> np.ndarray:
        """``before`` bytes, the name behind them, then the bytes up to ``length``."""
        k = np.zeros(len(at), dtype=np.uint64)
        for i in range(before):
            k = k << np.uint64(8) | t[at + i]
        k = k << bits | name[at + before]
        for i in range(before + span, length):
            k = k << np.uint64(8) | t[at + i]
        return k

    # with name ranks of 32 bits at most and four bytes around them a key is one integer
    kind = starts % 3
    parts = {r: np.flatnonzero(kind == r) for r in range(3)}
    sampled = np.concatenate([parts[1], parts[2]])
    by = np.argsort(key(starts[sampled], 0))
    sampled = sampled[by]
    rest = parts[0][np.argsort(key(starts[parts[0]], 1))]
    # merge: each remaining suffix goes behind the samples of both residues that are smaller
    place = np.zeros(len(rest), dtype=np.int64)
    for residue, before in ((1, 1), (2, 2)):
        own = sampled[kind[sampled] == residue]
        place += np.searchsorted(key(starts[own], before), key(starts[rest], before), side="left")
    merged = np.empty(len(starts), dtype=np.int64)
    where = place + np.arange(len(rest))
    hole = np.ones(len(starts), dtype=bool)
    hole[where] = False
    merged[where] = rest
    merged[hole] = sampled
    # compare adjacent prefixes by the key that both residues of a pair have
    a, b = merged[:-1], merged[1:]
    ka, kb = kind[a], kind[b]
    same = np.zeros(len(a), dtype=bool)
    for before, clash in ((0, 0), (1, 2), (2, 1)):  # a name after 0, 1, 2 bytes needs residues other than ``clash``
        m = np.flatnonzero((ka != clash) & (kb != clash) & ~same)
        if len(m):
            same[m] = key(starts[a[m]], before) == key(starts[b[m]], before)
    flag = np.zeros(len(starts), dtype=bool)
    flag[a[same]] = True
    flag[b[same]] = True
    return flag


def _decide(length: int):
    def decide(segments: list[bytes], windows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        text = np.frombuffer(b"".join(segments), dtype=np.uint8)
        sizes = windows + length - 1
        base = np.cumsum(sizes) - sizes
        starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(base, windows)
        wanted = np.zeros(len(segments), dtype=bool)
        wanted[asked] = True
        return repeated_prefixes(text, starts, length)[np.repeat(wanted, windows)]
    return decide


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            n, removed, spans, kept = [], [], [], []
            for text, starts in zip(b.column("text").to_pylist(), flagged_windows(b.column("flags")), strict=True):
                gone = np.zeros(len(text), dtype=bool) if starts is None else covered(len(text), length, starts)
                edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                n.append(len(text))
                removed.append(int(gone.sum()))
                spans.append([{"first": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if len(lo) else text)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"])
    return run


def remove_repeated_strings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every document: the bytes
    that lie in a ``length``-byte string standing at two places or more are
    removed; ``spans`` are the removed runs, ``kept`` the bytes left. Strings
    are judged on the input and never cross documents.

    Defined cases: null and empty texts, and texts shorter than ``length``, keep
    everything; every row is a document, so repeated rows repeat each other, also
    those with equal or null ids; an empty table gives no rows; other columns
    are ignored."""
    if length < GRAM + 2:
        raise ValueError(f"length must be {GRAM + 2} bytes or more")
    own = keyed_documents(docs, id_col, text_col)
    marked = repeated_windows(own, Bytes, GRAM, length, shard_runner(SHARD_BYTES, _decide(length)))
    return own.join(marked, ["k", "tk"], "left").select(document_id(), "text", "flags").mapInArrow(
        _remove(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<first: bigint, end: bigint>>, kept binary")
