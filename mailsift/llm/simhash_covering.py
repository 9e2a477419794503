"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For a radius r, each bit position i is given a
fixed vector m(i) of r+1 bits, and each of the 2^(r+1)-1 non-zero vectors v
makes a mask of the positions with <m(i), v> = 1 (mod 2). Two fingerprints
that differ in at most r positions have a v orthogonal to the vectors of all
those positions, so they agree under that mask: every pair within the radius
collides in some table, without exception.

Copies of a fingerprint are collapsed first. Each table is a shuffle of
(table, masked fingerprint) over distinct fingerprints; a bucket above
``BLOCK`` rows is cut into blocks whose pairs of blocks are separate groups.
A group checks its pairs by exact bit distance in arrays and emits a spanning
forest (fewer links than rows), never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_bounds, partitions, text_bytes, union_min, whole_groups, written
from .components import connected_components

BLOCK = 2048  # rows of a bucket that are compared in one group


def covering_masks(radius: int, bits: int = 64, seed: int = 11) -> list[int]:
    """The 2^(radius+1)-1 masks over ``bits`` positions, as unsigned integers."""
    dims = radius + 1
    vectors = np.random.default_rng(seed).permutation(bits) % ((1 << dims) - 1) + 1
    return [sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2)
            for v in range(1, 1 << dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprint(text: bytes, shingle: int) -> int:
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z only, splits at space and \t-\r only
    if not words:
        return 0
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    else:
        grams = [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=n)
    for part in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * int(ones[i]) > n)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text",
                 more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``more``: the 64-bit SimHash of each whole text as a signed long.
    Lower-cased words, ``shingle``-word shingles with repeats, XXH64 with seed
    42; a bit is set if it is set in more than half of the hashes. Fewer words
    than ``shingle`` make one shingle; no words (or null) make fingerprint 0."""
    @F.pandas_udf("long")
    def simhash(texts):
        return texts.map(lambda t: _signed(_fingerprint(t, shingle))).astype("int64")

    return docs.select(F.col(id_col).alias("doc_id"), simhash(text_bytes(text_col)).alias("fp"), *more)


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["t", "key", "i", "j"]
        for table in whole_groups(batches, keys):
            bounds = group_bounds(table, keys)
            fp = table.column("fp").to_numpy()
            blk = table.column("blk").to_numpy()
            cell_i = table.column("i").to_numpy()
            cell_j = table.column("j").to_numpy()
            sizes = np.diff(bounds)
            ends_a, ends_b = [], []
            small = np.flatnonzero((sizes > 1) & (sizes <= 64))
            for m in np.unique(sizes[small]):  # groups of one size at a time, all in one array
                x, y = np.triu_indices(m, 1)
                at = bounds[small[sizes[small] == m]]
                step = max(1, 2_000_000 // len(x))
                for part in range(0, len(at), step):
                    a = (at[part:part + step, None] + x).ravel()
                    b = (at[part:part + step, None] + y).ravel()
                    near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= radius
                    cross = (blk[a] != blk[b]) | (cell_i[a] == cell_j[a])
                    ends_a.append(a[near & cross])
                    ends_b.append(b[near & cross])
            for g in np.flatnonzero(sizes > 64):
                lo, hi = bounds[g], bounds[g + 1]
                own = fp[lo:hi].view(np.uint64)
                for part in range(0, hi - lo, 512):
                    d = np.bitwise_count(own[part:part + 512, None] ^ own[None, :])
                    a, b = np.nonzero(d <= radius)
                    a = a + part
                    keep = a < b
                    ends_a.append(a[keep] + lo)
                    ends_b.append(b[keep] + lo)
            if not ends_a:
                continue
            label = union_min(table.num_rows, np.concatenate(ends_a), np.concatenate(ends_b))
            moved = np.flatnonzero(label != np.arange(table.num_rows))
            # within a group the fingerprints are distinct, so a moved row names another one
            yield pa.RecordBatch.from_pydict({"a": fp[moved], "b": fp[label[moved]]})
    return run


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fp`` that are
    within ``radius`` bits, from all covering tables."""
    spark = distinct.sparkSession
    tables = F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(covering_masks(radius))]))
    rows = distinct.select("fp", tables.alias("x")).select("x.t", "x.key", "fp")
    hot = rows.groupBy("t", "key").count().filter(F.col("count") > BLOCK).select(
        F.col("t").alias("ht"), F.col("key").alias("hk"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
    cells = rows.join(hot, (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hk")), "left").select(
        "t", "key", "fp", F.coalesce("blocks", F.lit(1)).cast("int").alias("n"))
    cells = cells.withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    other: Column = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    cells = cells.withColumn("o", other).select(
        "t", "key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "fp")
    cells = cells.repartition(partitions(spark), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return cells.mapInArrow(_links(radius), "a long, b long")


def text_hash(column: str = "text") -> Column:
    return F.xxhash64(column)


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """``distinct`` (one row per fingerprint ``fp``) with ``root``, the same for
    all fingerprints of a group."""
    comps = connected_components(fingerprint_links(distinct.select("fp"), radius))
    return distinct.join(comps, F.col("fp") == F.col("node"), "left").select(
        *distinct.columns, F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fp, component_id), where component_id is
    the smallest doc_id reachable over fingerprints within ``radius`` bits.

    Defined cases: null, empty and blank texts have fingerprint 0 and link
    like any other; repeated rows and ties share a fingerprint and so a
    component; a null doc_id keeps its row and never becomes a component id
    while another member has one; other columns are ignored; an empty table
    gives no rows."""
    fp = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    member = _rooted(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), radius)
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(lowest, "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


def group_firsts(docs: DataFrame, shingle: int = 4, radius: int = 4,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of ``simhash_groups``: (doc_id, text_hash) of its first
    document by (id is null, id, hash of the text). Groups are told apart by
    their fingerprints, so null and repeated ids neither join nor split them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    fp = written(fingerprints(rows, shingle, more=("text_hash",)), "simhash")
    member = _rooted(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), radius)
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(lowest, "root").select("fp", "root", "component_id")
    return (fp.join(named, "fp").filter("doc_id <=> component_id")
            .groupBy("root", "doc_id").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash"))
