"""Routing repeated windows to shards, for the substring operators.

A window is ``length`` consecutive units (bytes or words) of a document. Its
key is the smallest hash among the ``gram``-unit pieces inside it, so equal
windows have equal keys wherever they stand. A maximal run of windows of a
document with one key (cut every ``length`` windows) is a segment: the units
its windows cover. All windows that could be equal thus lie in segments of the
same key, and a shard that gets all segments of its keys can decide about its
windows alone.

Only narrow rows move for all segments: (key, segment hash, document, first
unit, windows). Keys with a single segment place, unless it
may repeat itself, hold no repeat and go. Of equal segments of a key two bring
their text: what holds for them holds for all others, and a shard that has both
finds by its own order or index that their windows stand twice. A key with more
than ``HOT`` different segments is split further, into one segment a window
keyed by the window itself, which spreads any group; its shard decides as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, few_rows, partitions, text_bytes, written

BLOCK = 1 << 20  # windows of one text that are hashed at a time
ROWS = 20_000  # rows of a batch that a task hands on
HOT = 4096  # different segments of one key that go to a shard together

SEGMENT = "key long, sid long, k long, tk long, first int, windows int, twice boolean"
COLUMNS = ["key", "sid", "k", "tk", "first", "windows", "twice"]


class Bytes:
    """Texts as byte units."""
    def __init__(self):
        self.table = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def units(self, text: bytes):
        return text

    def hashes(self, units) -> np.ndarray:
        return self.table[np.frombuffer(units, dtype=np.uint8)]

    def cutter(self, units) -> Callable[[int, int], bytes]:
        return lambda lo, hi: units[lo:hi]


class Words:
    """Texts as white-space separated words, unchanged."""
    def __init__(self, kept: int = 200_000):
        import xxhash

        class Hashes(dict):
            def __missing__(self, word):
                if len(self) >= kept:
                    self.clear()
                h = xxhash.xxh3_64_intdigest(word)
                if len(word) < 64:
                    self[word] = h
                return h
        self.known = Hashes()

    def units(self, text: bytes):
        return text.split()

    def hashes(self, units) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, units), dtype=np.uint64, count=len(units))

    def cutter(self, units) -> Callable[[int, int], bytes]:
        joined = b" ".join(units)
        ends = np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1)
        starts = np.append(0, ends).tolist()
        return lambda lo, hi: joined[starts[lo]:starts[hi] - 1]


def window_keys(x: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each window of ``length`` units, from the units' hashes, and
    whether the window begins with the piece that gives its key."""
    with np.errstate(over="ignore"):
        g, span, factor = x, 1, np.uint64(0x9E3779B97F4A7C15)
        while span * 2 <= gram:  # hash of 2n units from two neighbouring ones of n
            g = g[:-span] * factor + g[span:]
            factor = factor * factor
            span *= 2
        g = g ^ (g >> np.uint64(29))
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    count, m, span = length - gram + 1, g, 1
    while span * 2 <= count:  # smallest of 2n neighbours from two smallest of n
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < count:
        m = np.minimum(m[:span - count], m[count - span:])
    return m, g[:len(m)] == m


def segments_of(hashes: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, twice) of the segments of one text of
    ``length`` units or more. ``twice``: a piece that gives the key is left
    behind within the segment, so another one with the same hash follows, and
    windows of this one segment may equal each other."""
    keys, leads = window_keys(hashes, gram, length)
    stays = keys[1:] == keys[:-1]
    first = np.append(0, np.flatnonzero(~stays) + 1)
    size = np.diff(np.append(first, len(keys)))
    twice = np.add.reduceat(np.append(leads[:-1] & stays, False), first) > 0
    if size.max() > length:  # long runs of one key
        parts = -(-size // length)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(first + size, parts)
        first = np.repeat(first, parts) + within * length
        twice = np.repeat(twice, parts)
        size = np.minimum(length, end - first)
    return keys[first].view(np.int64), first, size, twice


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _segment_rows(unit, gram: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own = unit()
        for b in few_rows(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for k, tk, text in zip(*(b.column(c).to_pylist() for c in ("k", "tk", "text")), strict=True):
                units = own.units(text)
                cut = own.cutter(units)
                for at in range(0, len(units) - length + 1, BLOCK):  # a very long text goes block by block
                    part = units[at:at + BLOCK + length - 1]
                    key, first, size, twice = segments_of(own.hashes(part), gram, length)
                    first = first + at
                    sid = np.fromiter((xxhash.xxh3_64_intdigest(cut(a, e)) for a, e in zip(
                        first.tolist(), (first + size + length - 1).tolist(), strict=True)), dtype=np.uint64, count=len(first))
                    for to, v in zip(out, (key, sid.view(np.int64), np.full(len(key), k), np.full(len(key), tk),
                                           first.astype(np.int32), size.astype(np.int32), twice), strict=True):
                        to.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], COLUMNS)
    return run


def _window_rows(unit, length: int):
    """Segments of hot keys, one row for each of their windows, keyed by the window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own = unit()
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]
        for b in few_rows(batches):
            out: list[tuple] = []
            for k, tk, text, segments in zip(*(b.column(c).to_pylist() for c in ("k", "tk", "text", "segments")), strict=True):
                cut = own.cutter(own.units(text))
                for s in segments:
                    for at in range(s["first"], s["first"] + s["windows"]):
                        window = cut(at, at + length)
                        out.append((_as_long(xxhash.xxh3_64_intdigest(window, 1)), _as_long(xxhash.xxh3_64_intdigest(window)),
                                    k, tk, at, 1, False))
                    if len(out) >= ROWS:
                        yield _batch(out, COLUMNS, kinds)
                        out = []
            if out:
                yield _batch(out, COLUMNS, kinds)
    return run


def _representatives(unit, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unit()
        names = ["key", "sid", "windows", "units"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in few_rows(batches):
            out: list[tuple] = []
            for text, segments in zip(b.column("text").to_pylist(), b.column("segments").to_pylist(), strict=True):
                cut = own.cutter(own.units(text))
                for s in segments:
                    out.append((s["key"], s["sid"], s["windows"], cut(s["first"], s["first"] + s["windows"] + length - 1)))
                    if len(out) >= ROWS:
                        yield _batch(out, names, kinds)
                        out = []
            if out:
                yield _batch(out, names, kinds)
    return run


def keyed_documents(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(k, tk, text) and the columns to carry along, as _0, _1, ...: k and tk stand for a row without nulls; the last bit of
    tk tells a null id. Rows that agree in both have the same id and text, and
    so the same result."""
    also = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"), *also)
    null_bit = F.col("doc_id").isNull().cast("long")
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("k"),
                       F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(null_bit).alias("tk"), "text",
                       *(f"_{i}" for i in range(len(carry))))


def document_id() -> Column:
    """The doc_id of a row of ``keyed_documents``."""
    return F.when(F.col("tk").bitwiseAND(F.lit(1)) == 0, F.col("k")).alias("doc_id")


def _with_text(texts: DataFrame, segments: DataFrame, columns: list[str]) -> DataFrame:
    """Documents' texts beside the segments (of one document: at most as many
    as it has windows) asked of them."""
    asked = segments.groupBy("k", "tk").agg(F.collect_set(F.struct(*columns)).alias("segments"))
    return asked.join(texts, ["k", "tk"]).select("k", "tk", "text", "segments")


def repeated_windows(docs: DataFrame, unit, gram: int, length: int, shard: Callable) -> DataFrame:
    """(k, tk, flags): for every document (of ``keyed_documents``) that has
    repeated windows, an array of (first, flags) with one bit a window that is
    set if the window stands at two places or more.

    ``shard`` works on batches sorted by key and sid of (key, sid, windows, units),
    the segments of whole keys, equal ones at least twice, and returns (key, sid, flags)."""
    spark = docs.sparkSession
    docs = docs.select("k", "tk", "text")
    rows = written(docs.mapInArrow(_segment_rows(unit, gram, length), SEGMENT), "segments")
    several = rows.groupBy("key").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).filter("n > 1").select("key")
    found = written(rows.join(several, "key").select(*COLUMNS), "repeats")
    drop_written(rows)
    kinds = _kinds(found)
    hot = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key")
    hot = written(hot, "hot")
    if hot.first() is not None:
        split = _with_text(docs, found.join(hot, "key", "left_semi"), ["first", "windows"])
        split = split.mapInArrow(_window_rows(unit, length), SEGMENT)
        found = written(found.join(hot, "key", "left_anti").select(*split.columns).union(split), "repeats")
        kinds = _kinds(found)
    brought = kinds.select("key", "sid", F.explode(F.array_distinct(F.array("one", "other"))).alias("rep"))
    brought = _with_text(docs, brought.select("key", "sid", "rep.*"), ["key", "sid", "first", "windows"]).mapInArrow(
        _representatives(unit, length), "key long, sid long, windows int, units binary")
    flags = (brought.repartition(partitions(spark), "key").sortWithinPartitions("key", "sid")
             .mapInArrow(shard, "key long, sid long, flags binary"))
    marked = found.join(flags, ["key", "sid"]).groupBy("k", "tk").agg(
        F.collect_set(F.struct("first", "windows", "flags")).alias("flags"))
    return marked


def _kinds(found: DataFrame) -> DataFrame:
    """The different segments of each key, with two of their places: one and the
    same if there is only one, or if rows that agree in id and text hold them all
    (each of these rows brings its text)."""
    place = F.struct("k", "tk", "first", "windows")
    return found.groupBy("key", "sid").agg(F.min(place).alias("one"), F.max(place).alias("other"))


def shard_runner(batch_bytes: int, decide: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]):
    """A ``shard``: gathers whole keys up to about ``batch_bytes`` of text at a
    time, equal segments twice, and lets ``decide`` flag windows. decide(segments,
    windows, asked) returns one boolean per window of the asked segments (the
    first of equal ones), segment by segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        asked: list[int] = []
        size, last = 0, None

        def done():
            windows = np.array([h[2] for h in held])
            flag = decide([h[3] for h in held], windows, np.array(asked))
            count = windows[asked]
            ends = np.cumsum(count).tolist()
            bits = [np.packbits(flag[e - w:e]).tobytes() for e, w in zip(ends, count.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[i][0] for i in asked], pa.int64()), pa.array([held[i][1] for i in asked], pa.int64()),
                 pa.array(bits, pa.binary())], ["key", "sid", "flags"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "sid", "windows", "units")), strict=True):
                if row[0] != last and size >= batch_bytes:
                    yield done()
                    held, asked, size = [], [], 0
                if not held or row[:2] != held[-1][:2]:
                    asked.append(len(held))
                elif len(held) - asked[-1] > 1:
                    continue  # a third of equal segments, brought by repeated rows
                held.append(row)
                size += len(row[3])
                last = row[0]
        if held:
            yield done()
    return run


def flagged_windows(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The first units of each text's flagged windows, from a column of (first,
    windows, flags) as ``repeated_windows`` makes it; None for a text without any."""
    first, windows, flags = column.values.flatten()
    first, windows = first.to_numpy(), windows.to_numpy()
    _, ends, packed = flags.buffers()
    at = np.frombuffer(ends, dtype=np.int32)[flags.offset:flags.offset + len(flags) + 1] if len(flags) else None
    packed = np.frombuffer(packed, dtype=np.uint8) if len(flags) else None
    bounds = column.offsets.to_pylist()
    for ok, lo, hi in zip(column.is_valid().to_pylist(), bounds[:-1], bounds[1:], strict=True):
        if not ok or lo == hi:
            yield None
            continue
        bits = np.unpackbits(packed[at[lo]:at[hi]])  # each segment's bits fill whole bytes, the rest of them zero
        room = np.diff(at[lo:hi + 1]) * 8
        start = np.repeat(first[lo:hi] - (np.cumsum(room) - room), room)
        hit = np.flatnonzero(bits)
        yield start[hit] + hit


def covered(n_units: int, length: int, starts: np.ndarray) -> np.ndarray:
    """Which units of a text lie in a window that begins at one of the ``starts``."""
    begun = np.zeros(n_units + 1, dtype=np.int32)
    begun[starts + 1] = 1
    np.cumsum(begun, out=begun)
    gone = begun[1:] > 0
    gone[length:] = begun[length + 1:] > begun[1:-length]
    return gone
