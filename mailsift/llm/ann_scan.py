"""Approximate nearest neighbours by an adaptive dimension scan.

Largest inner product becomes smallest distance by one more dimension
(sqrt(M^2 - |x|^2), M the largest norm). Vectors are rotated by a fixed random
orthogonal matrix, so that the first d dimensions estimate a distance without
bias, and kept in column blocks. Rows are assigned to lists around centres
fitted on a bounded sample; a query probes its nearest lists. Within a probed
list the scan adds one column block at a time and drops a candidate as soon as
a hypothesis test on its partial distance says that the full distance is above
the query's current k-th best: partial > best * (d/D) * (1 + eps/sqrt(d))^2.
Survivors are ranked by the exact inner product of the original vectors.

Every row is indexed, equal rows of one id once. Lists are cut into chunks of
at most about ``CHUNK`` rows, queries of a list into blocks, so that no task
holds a whole list. Rows of one id with different vectors are one candidate: the
bound and the cut to k of a chunk count ids, and the best row of an id counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, whole_groups, written
from .embedding_dups import _matrix, usable

CHUNK = 4096      # rows of a list, or queries of a list, in one group
SAMPLE = 20_000   # rows the centres are fitted on, at most about
MAX_LISTS = 4096


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centres(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres ** 2).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _turned(x: np.ndarray, norm2: float, turn: np.ndarray) -> np.ndarray:
    more = np.sqrt(np.maximum(0.0, norm2 - (x ** 2).sum(axis=1)))
    return np.column_stack([x, more]) @ turn


def _assign(norm2: float, turn: np.ndarray, centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _turned(_matrix(b.column("vec")), norm2, turn)
                near = ((centres ** 2).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], [*b.schema.names, "list"])
    return run


def _probe(turn: np.ndarray, centres: np.ndarray, sizes: np.ndarray, probes: int, least: int):
    """Lists of each query: its nearest ``probes`` and as many more as it takes to see ``least`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = np.column_stack([_matrix(b.column("vec")), np.zeros(b.num_rows)]) @ turn
            order = ((centres ** 2).sum(1)[None, :] - 2 * q @ centres.T).argsort(axis=1, kind="stable")
            seen = sizes[order].cumsum(axis=1)
            take = np.maximum(probes, (seen < least).sum(axis=1) + 1).clip(max=len(centres))
            ends = np.append(0, take.cumsum()).astype(np.int32)
            flat = np.concatenate([o[:n] for o, n in zip(order, take, strict=True)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*b.schema.names, "lists"])
    return run


def _scan(norm2: float, turn: np.ndarray, k: int, eps: float, block: int):
    keys = ["list", "chunk", "part"]

    def nearest(q_id, q, c_id, c):
        dims = turn.shape[0]
        rq = np.column_stack([q, np.zeros(len(q))]) @ turn
        rc = _turned(c, norm2, turn)
        # the first row of each id stands before all others, so that the first bound is one over ids
        new = np.unique(c_id, return_index=True)[1]
        repeats = len(new) < len(c)
        if repeats:
            other = np.ones(len(c), dtype=bool)
            other[new] = False
            order = np.append(np.sort(new), np.flatnonzero(other))
            c_id, c, rc = c_id[order], c[order], rc[order]
        blocks = [rc[:, at:at + block] for at in range(0, dims, block)]  # column blocks
        heads = min(len(new), max(2 * k, 256))
        for n in range(len(q)):
            # full distances of the first candidates give the first bound
            first = ((rc[:heads] - rq[n]) ** 2).sum(axis=1)
            own = c_id[:heads] == q_id[n]
            first[own] = np.inf
            best = np.partition(first, k - 1)[k - 1] if heads > k else np.inf
            alive = np.arange(heads, len(c))
            partial = np.zeros(len(alive))
            for at, cols in zip(range(0, dims, block), blocks, strict=True):
                if not len(alive):
                    break
                partial += ((cols[alive] - rq[n, at:at + block]) ** 2).sum(axis=1)
                d = min(dims, at + block)
                limit = best * (1 + 1e-9) if d == dims else best * (d / dims) * (1 + eps / np.sqrt(d)) ** 2
                stay = partial <= limit
                alive, partial = alive[stay], partial[stay]
            left = np.append(np.flatnonzero(first <= best * (1 + 1e-9)), alive)
            left = left[c_id[left] != q_id[n]]
            score = c[left] @ q[n]
            if len(left) > k:
                order = np.lexsort((c_id[left], -score))
                if repeats:  # the best row of each id
                    order = order[np.sort(np.unique(c_id[left][order], return_index=True)[1])]
                left, score = left[order[:k]], score[order[:k]]
            yield q_id[n], c_id[left], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 8_192):
            cell = np.zeros(table.num_rows, dtype=bool)
            cell[:1] = True
            for key in keys:
                v = table.column(key).to_numpy()
                cell[1:] |= v[1:] != v[:-1]
            bounds = np.append(np.flatnonzero(cell), table.num_rows)
            is_q = table.column("query").to_numpy(zero_copy_only=False)
            ids = table.column("vec_id").to_numpy()
            vecs = _matrix(table.column("vec"))
            out = ([], [], [])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                q = np.flatnonzero(is_q[lo:hi]) + lo
                c = np.flatnonzero(~is_q[lo:hi]) + lo
                if len(q) and len(c):
                    for q_id, c_ids, score in nearest(ids[q], vecs[q], ids[c], vecs[c]):
                        out[0].append(np.full(len(c_ids), q_id))
                        out[1].append(c_ids)
                        out[2].append(score)
            if out[0]:
                yield pa.RecordBatch.from_pydict(
                    {n: np.concatenate(v) for n, v in zip(("query_id", "vec_id", "score"), out, strict=True)})
    return run


def search(vectors: DataFrame, is_query, k: int = 20, probe_share: float = 0.7, eps: float = 2.1, block: int = 16,
           seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row where the condition ``is_query`` (over ``vec_id``) holds,
    its ``k`` nearest other rows found by largest inner product: (query_id,
    rank, vec_id, score), ties to the smaller vec_id.

    ``probe_share`` of the lists are probed (and more until 4k ids are seen);
    the number of lists is the square root of the row count, ``MAX_LISTS`` at
    most, and centres are fitted on a sample of about ``SAMPLE`` rows; equal
    rows of one id count once.

    Defined cases: a null id, or a vector that is null, empty, zero or holds
    null or non-finite parts, takes no part; vectors whose length is not the
    most common one take no part; repeated rows of one id are one candidate
    with the score of its best row; fewer than ``k`` others give all of them; an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
            .filter(F.col("vec_id").isNotNull() & usable("vec")))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    size = rows.groupBy(F.size("vec").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.max(norm).alias("norm2")).orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    dim, n, norm2 = size["dim"], size["n"], size["norm2"]
    rows = rows.filter(F.size("vec") == dim)
    if size["ids"] < n:  # equal rows of an id are one
        rows = written(rows.dropDuplicates(["vec_id", "vec"]), "vectors")
        n = rows.count()
    parted = ["vec"] if size["ids"] < n else []  # rows of one id are dealt by their vectors, too
    turn = rotation(dim + 1, seed)
    share = min(1.0, SAMPLE / n)
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed), *parted), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.select("vec").toArrow()  # bounded by SAMPLE, in expectation
    if not sample.num_rows:
        sample = rows.limit(1).select("vec").toArrow()
    centres = fit_centres(_turned(_matrix(sample.column("vec")), norm2, turn),
                          max(1, min(MAX_LISTS, int(np.sqrt(n)))), seed=seed)
    lists = len(centres)
    indexed = written(rows.mapInArrow(_assign(norm2, turn, centres), "vec_id long, vec array<double>, list int"), "lists")

    def per_list(table):
        sizes = np.zeros(lists, dtype=np.int64)
        for r in table.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MAX_LISTS rows
            sizes[r["list"]] = r["n"]
        return sizes

    sizes = per_list(indexed)
    # an id with rows in several lists counts in one of them only
    ids = per_list(indexed.groupBy("vec_id").agg(F.min("list").alias("list"))) if parted else sizes
    chunks = F.element_at(F.array(*[F.lit(int(max(1, -(-s // CHUNK)))) for s in sizes]), F.col("list") + 1)
    data = indexed.select("list", F.pmod(F.xxhash64("vec_id", *parted), chunks).cast("int").alias("chunk"), "vec_id", "vec")
    asked = indexed.filter(is_query).select("vec_id", "vec").dropDuplicates(["vec_id"])
    queries = asked.mapInArrow(
        _probe(turn, centres, ids, max(1, int(np.ceil(probe_share * lists))), 4 * k + 1),
        "vec_id long, vec array<double>, lists array<int>")
    queries = queries.select("vec_id", "vec", F.explode("lists").alias("list"))
    n_queries = F.lit(int(max(1, -(-asked.count() // CHUNK))))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_queries).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), n_queries - 1)))
    cells = (data.select("list", "chunk", "part", F.lit(False).alias("query"), "vec_id", "vec")
             .union(queries.select("list", "chunk", "part", F.lit(True), "vec_id", "vec")))
    cells = cells.repartition(partitions(spark), "list", "chunk", "part").sortWithinPartitions("list", "chunk", "part")
    found = cells.mapInArrow(_scan(norm2, turn, k, eps, block), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
