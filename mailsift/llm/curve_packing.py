"""Packing along a space-filling curve.

Each text becomes a hashed vector (4-byte shingles counted into ``BUCKETS``
hashed buckets, scaled to length 1), projected to three dimensions by a fixed
random matrix. Its place on a Hilbert curve through that space is its key.
Documents are range-partitioned and sorted by that key, so near texts are near
in the order, and each partition packs its documents one after another,
cutting them wherever a sequence is full. What is left at the end of a
partition is cut into sequences whose lengths are powers of two, so nothing is
padded anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_bytes
from .tokens import encoder

BUCKETS = 2048
DIMS, BITS = 3, 10
SPAN = 3.0  # projections beyond +-SPAN sit on the border of the cube


def hashed_vector(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the text's 4-byte shingles in hashed buckets, scaled to length 1."""
    padded = text + b"\0\0\0"
    total = np.zeros(buckets, dtype=np.int64)
    shift = np.uint32(33 - buckets.bit_length())
    for offset in range(4):  # the shingles that begin at every fourth byte, as integers
        count = (len(padded) - offset) // 4
        for part in range(0, count, 1 << 18):
            grams = np.frombuffer(padded, "<u4", min(1 << 18, count - part), offset + 4 * part)
            total += np.bincount(grams * np.uint32(2654435761) >> shift, minlength=buckets)
    norm = np.linalg.norm(total)
    return total / norm if norm else total


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of points (n, dims) of a grid with 2^bits
    cells a side, by the usual transpose form: undo the excess work from the
    highest bit down, Gray-encode, then interleave the bits."""
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(len(x)):
            hit = (x[d] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
        q >>= 1
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = key << 1 | ((x[d] ^ flip) >> b & 1)
    return key


def curve_keys(texts: list[bytes], seed: int = 3) -> np.ndarray:
    project = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
    if not texts:
        return np.zeros(0, dtype=np.int64)
    points = np.stack([hashed_vector(t) for t in texts]) @ project
    cells = ((points + SPAN) * ((1 << BITS) / (2 * SPAN))).clip(0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


def _pack(tokenizer: str, end_id: int, length: int):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "curve_key", "token_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 36
        end = np.array([end_id], dtype="<u4").tobytes()
        held: list[tuple] = []  # pieces of the open sequence: (doc, start, bytes, doc tokens, key)
        fill, room, left = 0, length, None  # left: ids that remain, known once the input has ended
        rows: list[tuple] = []

        def close():
            nonlocal sequence, held, fill, room, left
            offset = 0
            for doc, start, data, tokens, key in held:
                rows.append((doc, start, len(data) // 4, tokens, sequence, offset, key, data))
                offset += len(data) // 4
            if left is not None:
                left -= fill
                room = 1 << (left.bit_length() - 1) if left else length
            sequence, held, fill = sequence + 1, [], 0

        def put(doc, start, data, tokens, key):
            nonlocal fill
            at = 0
            while at < len(data):
                take = min(len(data) - at, (room - fill) * 4)
                held.append((doc, start + at // 4, data[at:at + take], tokens, key))
                fill += take // 4
                at += take
                if fill == room:
                    close()

        def ready():
            out = pa.RecordBatch.from_pydict({n: pa.array(v, pa.binary() if n == "token_bytes" else pa.int64())
                                              for n, v in zip(names, zip(*rows, strict=True), strict=True)})
            rows.clear()
            return out

        for b in batches:
            for doc, text, key in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "key")), strict=True):
                data = enc.encode(text) + end
                put(doc, 0, data, len(data) // 4, key)
                if len(rows) >= 4096:
                    yield ready()
        if fill:  # lengths that are powers of two need no padding
            rest, left, held, fill = held, fill, [], 0
            room = 1 << (left.bit_length() - 1)
            for piece in rest:
                put(*piece)
        if rows:
            yield ready()
    return run


def pack_along_curve(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, doc_tokens,
    sequence_id, offset, curve_key, token_bytes). Every id of every document,
    with the end id behind it, lies in exactly one piece; pieces fill a
    sequence without gaps. Sequences hold ``length`` ids, the last few of a
    partition a smaller power of two. sequence_id is unique, and grows along
    the curve.

    Defined cases: null and empty texts hold the end id only; a document longer
    than a sequence spans several; repeated rows, equal and null ids are packed
    row by row; an empty table gives no rows; other columns are ignored."""
    @F.pandas_udf("long")
    def key(texts):
        import pandas as pd
        return pd.Series(curve_keys(list(texts)), dtype="int64")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", key(text_bytes("text")))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "key", "doc_id").sortWithinPartitions("key", "doc_id", "text")
    return rows.mapInArrow(_pack(tokenizer, end_id, length),
                           "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
                           "curve_key long, token_bytes binary")
