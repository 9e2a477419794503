"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id, equal and null ids by a hash of the text,
and sorted, so file k holds lower ids than file k+1 and a hot id fills several. Each task encodes its partition and writes three files to the
shared folder: ``.bin`` (ids back to back, 16 bits if the vocabulary fits,
else 32, little-endian), ``.idx`` (documents + 1 offsets into it, unsigned 64
bits) and ``.doc`` (document ids, signed 64 bits; null ids come first and are
counted). A task returns one manifest row; the prefix sums of the files' token
counts are the bases that make offsets global. Readers memory-map the files.

Files carry the name of the task attempt that wrote them, and the manifest names
the attempt whose row came back: a task that runs twice, after a lost executor or
beside itself, never touches files that a reader may have open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, partitions
from .tokens import encoder

MANIFEST = "part int, attempt long, docs long, null_ids long, tokens long, width int"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark itself resolves it: a path without scheme lies in the
    cluster's default file system, not on each machine's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write_part(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = _fs(folder)
        enc = encoder(tokenizer)
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype="<u4").tobytes()
        counts, ids, nulls = [], [], 0
        name = f"{root}/part-{part:06d}-{attempt}"
        with fs.open_output_stream(f"{name}.bin") as out:
            for b in batches:
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    tokens = np.frombuffer(enc.encode(text) + end, dtype="<u4")
                    out.write(tokens.astype(f"<u{width}").tobytes())
                    counts.append(len(tokens))
                    ids.append(doc or 0)
                    nulls += doc is None
        offsets = np.zeros(len(counts) + 1, dtype="<u8")
        np.cumsum(counts, out=offsets[1:])
        for kind, data in (("idx", offsets), ("doc", np.array(ids, dtype="<i8"))):
            with fs.open_output_stream(f"{name}.{kind}") as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "attempt": pa.array([attempt], pa.int64()), "docs": pa.array([len(counts)], pa.int64()),
            "null_ids": pa.array([nulls], pa.int64()), "tokens": pa.array([int(offsets[-1])], pa.int64()),
            "width": pa.array([width], pa.int32())})
    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the token files of all documents and their manifest; returns the
    folder. ``tokenizer`` is a tokenizers file that every executor has; a store that
    pyarrow cannot open is refused before any work.

    Defined cases: null and empty texts hold the end id only; repeated rows
    and equal ids are kept, in order of a hash of the text; null ids come first; an empty
    table writes a manifest without files; other columns are ignored."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_folder(spark, "tokens"))
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.xxhash64("text"))
    rows = (rows.repartitionByRange(partitions(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place", "text")
            .select("doc_id", "text"))
    # one row per file: as many as there are partitions
    parts = sorted(rows.mapInArrow(_write_part(folder, tokenizer, end_id), MANIFEST).collect(), key=lambda r: r["part"])
    base = 0
    files = []
    for r in parts:
        files.append(r.asDict() | {"base": base})
        base += r["tokens"]
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"end_id": end_id, "tokens": base, "files": files}).encode())
    return folder


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a file system."""
    if fs.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if fs.get_file_info(path).size else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _read_part(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for b in batches:
            for r in b.to_pylist():
                name = f"{root}/part-{r['part']:06d}-{r['attempt']}"
                tokens = _mapped(fs, f"{name}.bin", f"<u{r['width']}")
                offsets = _mapped(fs, f"{name}.idx", "<u8").astype(np.int64)
                ids = _mapped(fs, f"{name}.doc", "<i8")
                lo = 0
                while lo < r["docs"]:  # about 4 million tokens at a time
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 22), "right")) - 1)
                    hi = min(hi, r["docs"])
                    own = tokens[offsets[lo]:offsets[hi]].astype("<u4")
                    cuts = (offsets[lo:hi + 1] - offsets[lo]) * 4
                    nulls = np.arange(lo, hi) < r["null_ids"]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[lo:hi], mask=nulls),
                        "start": pa.array(offsets[lo:hi] + r["base"]),
                        "n_tokens": pa.array(np.diff(offsets[lo:hi + 1])),
                        "token_bytes": pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(), hi - lo, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(own.tobytes())]
                        ).cast(pa.binary())})
                    lo = hi
    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, token_bytes) of every document in the files:
    ``start`` counts the ids of all documents before it, ``token_bytes`` are its
    ids as little-endian unsigned 32-bit integers."""
    folder = qualified(spark, folder)
    fs, root = _fs(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    out = "doc_id long, start long, n_tokens long, token_bytes binary"
    if not files:
        return spark.createDataFrame([], out)
    names = ["part", "attempt", "docs", "null_ids", "width", "base"]
    rows = spark.createDataFrame([tuple(f[n] for n in names) for f in files],
                                 "part int, attempt long, docs long, null_ids long, width int, base long")
    return rows.repartitionByRange(len(files), "part").mapInArrow(_read_part(folder), out)
