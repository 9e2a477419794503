"""Helpers shared by the operators: the shared folder, written tables that
cut lineage, and Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the
    session. Only a local session without that setting gets a scratch one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once to the shared folder: later readers
    survive lost executors, and its work is never done again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_rows(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows``: what a task makes of texts at a time
    stays small beside the batch they came in."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str],
                 rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows in which no group of ``keys`` is cut, from
    batches that arrive sorted by ``keys``. Holds one such table at a time."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            col = table.column(k).to_numpy()
            same &= col == col[-1]
        cut = table.num_rows - int(same.sum())
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(table: pa.Table, keys: list[str]):
    """Start offsets of the groups of a sorted table, with the end appended."""
    import numpy as np

    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        col = table.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.append(np.flatnonzero(new), n)


def union_min(n: int, a, b):
    """Smallest index reachable from each of ``n`` nodes over links a-b
    (label propagation with pointer jumping, all in arrays)."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        before = label.copy()
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
