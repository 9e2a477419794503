"""Embedding near-duplicates: random-hyperplane sign hashing in several
tables, exact cosine verification, distributed connected components.

Equal vectors of a label are collapsed to one representative with a count.
Every representative gets one sign signature per table; only members of
buckets with at least two representatives fetch their vectors again. A bucket
above ``BLOCK`` rows is cut into blocks, one group per pair of blocks. A group
computes exact cosines in double precision. A pair is counted only in the
first table in which its signatures agree (and only there, as every row
carries all its signatures), so link counts need no list of pairs: a group
emits one row per member with its count and one spanning link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_bounds, partitions, union_min, whole_groups, written
from .components import connected_components

BLOCK = 2048


def planes(dim: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, tables * bits))


def usable(vector_col: str):
    """True where a vector is non-null, non-zero and all its parts are finite."""
    c = F.col(vector_col)
    big = F.lit(float("inf"))
    return (c.isNotNull() & F.forall(c, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big), F.lit(False)))
        & F.exists(c, lambda x: F.coalesce(x != 0, F.lit(False))))


def _matrix(column) -> np.ndarray:
    """A list column (all lists of one length) as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _signatures(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("vec").value_lengths().to_numpy()
            sigs = np.zeros((batch.num_rows, tables), dtype=np.int32)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = _matrix(batch.column("vec").take(pa.array(at)))
                up = (x @ planes(int(dim), tables, bits, seed) > 0).reshape(len(at), tables, bits)
                sigs[at] = up @ weight
            out = pa.ListArray.from_arrays(np.arange(0, sigs.size + 1, tables, dtype=np.int32), sigs.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "sigs"])
    return run


def _verify(threshold: float):
    keys = ["grp", "t", "sig", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 5_000):
            bounds = group_bounds(table, keys)
            cols = {k: table.column(k).to_numpy() for k in ("t", "i", "j", "blk", "n_copies", "rid", "h1", "h2")}
            vecs = _matrix(table.column("vec"))
            sigs = _matrix(table.column("sigs")).astype(np.int64)
            vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
            added = np.zeros(table.num_rows, dtype=np.int64)
            ends_a, ends_b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                t, same = cols["t"][lo], cols["i"][lo] == cols["j"][lo]
                for part in range(lo, hi, 1024):
                    a, b = np.nonzero(vecs[part:min(hi, part + 1024)] @ vecs[lo:hi].T >= threshold)
                    a, b = a + part, b + lo
                    keep = a < b
                    if not same:
                        keep &= cols["blk"][a] != cols["blk"][b]
                    a, b = a[keep], b[keep]
                    first = (sigs[a] == sigs[b]).argmax(axis=1) == t
                    a, b = a[first], b[first]
                    np.add.at(added, a, cols["n_copies"][b])
                    np.add.at(added, b, cols["n_copies"][a])
                    ends_a.append(a)
                    ends_b.append(b)
            if not ends_a:
                continue
            label = union_min(table.num_rows, np.concatenate(ends_a), np.concatenate(ends_b))
            hit = np.flatnonzero(added)
            yield pa.RecordBatch.from_pydict({
                "h1": cols["h1"][hit], "h2": cols["h2"][hit], "added": added[hit],
                "a": cols["rid"][hit], "b": cols["rid"][label[hit]]})
    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, tables: int = 24, bits: int = 12,
                           seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label") -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept). Vectors link
    when their labels are equal and not null and their cosine is at least
    ``threshold``; candidates agree on all ``bits`` signs in one of ``tables``.

    Defined cases: a null label, or a vector that is null, empty, zero or
    holds null or non-finite parts, links with nothing; vectors of different
    lengths never link; repeated rows count as copies of each other; a null
    vec_id links with nothing, has component_id null and kept false; an empty
    table gives no rows; other columns are ignored."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    vec = F.transform("vec", lambda x: x + F.lit(0.0).cast("float"))  # -0.0 becomes 0.0
    keyed = rows.withColumn("h1", F.xxhash64(F.lit(1), "label", vec)).withColumn("h2", F.xxhash64("label", vec, F.lit(2)))
    live = keyed.filter("ok")
    rep_ids = live.groupBy("h1", "h2").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("n_copies"))
    one = live.join(rep_ids, ["h1", "h2"]).filter("vec_id = rid").dropDuplicates(["h1", "h2"])
    grp = F.xxhash64("label", F.size("vec"))
    reps = written(one.select("h1", "h2", "rid", "n_copies", grp.alias("grp"), "vec").mapInArrow(
        _signatures(tables, bits, seed), "h1 long, h2 long, rid long, n_copies long, grp long, "
        f"vec {rows.schema['vec'].dataType.simpleString()}, sigs array<int>"), "signatures")
    slots = reps.select("h1", "h2", "grp", F.posexplode("sigs").alias("t", "sig"))
    shared = slots.groupBy("grp", "t", "sig").count().filter("count > 1").select(
        "grp", "t", "sig", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    cells = slots.join(shared, ["grp", "t", "sig"]).withColumn("blk", F.pmod(F.col("h1"), F.col("n")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "h1", "h2", "t", "sig", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk")
    cells = cells.join(reps, ["h1", "h2"]).select(
        "grp", "t", "sig", "i", "j", "blk", "h1", "h2", "rid", "n_copies", "vec", "sigs")
    cells = (cells.repartition(partitions(spark), "grp", "t", "sig", "i", "j")
             .sortWithinPartitions("grp", "t", "sig", "i", "j", "h1", "h2"))
    found = written(cells.mapInArrow(_verify(threshold), "h1 long, h2 long, added long, a long, b long"), "links")
    others = found.groupBy("h1", "h2").agg(F.sum("added").alias("others"))
    comps = connected_components(found.select("a", "b"))
    named = (rep_ids.join(others, ["h1", "h2"], "left")
             .join(comps, F.col("rid") == F.col("node"), "left")
             .select("h1", "h2", (F.col("n_copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("root", "rid").alias("component")))
    linked = live.join(named, ["h1", "h2"]).select("vec_id", "n_links", "component")
    alone = keyed.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return linked.union(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
