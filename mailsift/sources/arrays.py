"""S1 for files that are one JSON array of messages, of any size.

A file is read in splits, each cut into fragments behind every ``}``, so one
large array uses as many tasks as it has splits. Where an element begins depends
on what came before the split: whether it starts inside a string, and how deep.
A first pass works out, for both answers to the first question, how each split
ends and how far its depth moves; putting the splits of a file together in order
(a few numbers a split, of which the driver plans as many anyway) gives every
split's start. The second pass cuts the elements at the commas of the outer
array. An element that runs over a split bound comes out in parts, which are
joined by split."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OUTSIDE = re.compile(r'["{}\[\],]')
_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)
WHOLE, HEAD, TAIL = 0, 1, 2


def _marks(text: str, in_string: bool) -> Iterator[tuple[int, str]]:
    """Places of brackets and commas outside strings, then one of '"' if the
    text ends inside a string."""
    at = 0
    while True:
        if in_string:
            m = _STRING_END.match(text, at)
            if m is None:
                yield len(text), '"'
                return
            at, in_string = m.end(), False
        m = _OUTSIDE.search(text, at)
        if m is None:
            return
        at = m.end()
        if m[0] == '"':
            in_string = True
        else:
            yield m.start(), m[0]


def _effect(text: str, in_string: bool) -> tuple[bool, int]:
    """(inside a string at the end, change of depth)"""
    depth = 0
    for _, c in _marks(text, in_string):
        if c == '"':
            return True, depth
        depth += (c in "{[") - (c in "}]")
    return False, depth


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split and batch: the effects from both start states, in order."""
    n = 0
    for b in batches:
        rows, split, state = [], None, None
        for text, *where in zip(*(b.column(c).to_pylist() for c in ("value", "source_file", "source_at")), strict=True):
            if where != split:
                split, state = where, [(False, 0), (True, 0)]
                rows.append([*where, n, state])
                n += 1
            for i, (inside, depth) in enumerate(state):
                inside, more = _effect(text + "}", inside)
                state[i] = (inside, depth + more)
        cols = list(zip(*[(f, a, k, s[0][0], s[0][1], s[1][0], s[1][1]) for f, a, k, s in rows], strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
            pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()), strict=True)],
            ["source_file", "source_at", "part", "in0", "d0", "in1", "d1"])


def _starts(rows) -> dict[tuple[str, int], tuple[bool, int]]:
    """Each split's start (inside a string, depth), split after split."""
    out, file, inside, depth = {}, None, False, 0
    for r in sorted(rows, key=lambda r: (r["source_file"], r["source_at"], r["part"])):
        if r["source_file"] != file:
            file, inside, depth = r["source_file"], False, 0
        out.setdefault((file, r["source_at"]), (inside, depth))
        depth += r["d1"] if inside else r["d0"]
        inside = r["in1"] if inside else r["in0"]
    return out


def _elements(starts):
    """Rows (file, split, row, kind, value): elements whole in their split, what
    comes before a split's first bound, and what comes after its last one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = starts.value
        split, out = None, []
        inside, depth, held, row, bounded = False, 0, [], 0, False

        def emit(kind: int) -> None:
            nonlocal held, row
            out.append((*split, row, kind, "".join(held)))
            row += kind != HEAD
            held = []

        def element() -> None:
            if bounded:
                emit(WHOLE)
            else:
                emit(HEAD)
                out.append((*split, row, HEAD, None))  # closes what the splits before began

        def finish() -> None:
            if split is not None and depth > 0 and held:
                emit(TAIL if bounded else HEAD)

        def batch() -> pa.RecordBatch:
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)],
                ["source_file", "source_at", "source_row", "kind", "value"])

        for b in batches:
            for value, *where in zip(*(b.column(c).to_pylist() for c in ("value", "source_file", "source_at")), strict=True):
                if where != split:
                    finish()
                    split, (inside, depth) = where, known[tuple(where)]
                    held, row, bounded = [], 0, False
                text, at = value + "}", 0
                start_inside, inside = inside, False
                for i, c in _marks(text, start_inside):
                    if c == '"':
                        inside = True
                    elif c in "{[":
                        depth += 1
                        if depth == 1:
                            at, bounded = i + 1, True
                    elif c in "}]":
                        depth -= 1
                        if depth == 0:  # the array's end: what is held is its last element
                            held.append(text[at:i])
                            if bounded and not "".join(held).strip():
                                held = []
                            else:
                                element()
                            at = len(text)
                            depth = -(1 << 40)
                    elif depth == 1:
                        held.append(text[at:i])
                        element()
                        at, bounded = i + 1, True
                if depth > 0:
                    held.append(text[at:])
            if out:
                yield batch()
        finish()
        if out:
            yield batch()
    return run


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_file, source_at, source_row): the elements of JSON array
    files in order, for ``with_positions``. Nothing is checked but brackets and
    strings: an element that is no message is for the input contract. The last
    element of an array that is never closed loses its end and so is malformed;
    what follows a closed array is ignored."""
    text = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_at"))
    effects = text.mapInArrow(_effects, "source_file string, source_at long, part long, in0 boolean, d0 long, in1 boolean, d1 long")
    starts = spark.sparkContext.broadcast(_starts(effects.collect()))  # a few numbers a split
    rows = text.mapInArrow(_elements(starts), "source_file string, source_at long, source_row long, kind int, value string")
    whole = rows.filter(F.col("kind") == WHOLE)
    # an element over split bounds: a tail and the heads up to the next bound
    order = Window.partitionBy("source_file").orderBy("source_at", "kind", F.col("value").isNull())
    own = F.when(F.col("kind") == TAIL, F.struct("source_at", "source_row"))
    parts = (rows.filter(F.col("kind") != WHOLE).withColumn("own", F.last(own, ignorenulls=True).over(order))
             .groupBy("source_file", "own").agg(
                 F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("source_at", F.col("kind") == HEAD, "value")))).alias("parts"),
                 F.max(F.col("value").isNull()).alias("closed"))
             .withColumn("text", F.array_join("parts.value", "")))
    joined = parts.select(F.when(F.col("closed"), F.col("text")).otherwise(F.expr("left(text, length(text) - 1)")).alias("value"),
                          "source_file", F.col("own.source_at").alias("source_at"), F.col("own.source_row").alias("source_row"))
    return whole.select("value", "source_file", "source_at", "source_row").unionByName(joined)
