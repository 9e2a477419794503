"""The prefix trie of conversations by splitter paths.

A conversation is a path of turns, a node is a distinct beginning of paths. The
paths are range-sorted over shards, (path, conv_id) in order, so a hot path is
dealt to as many shards as it fills. A node whose members lie in two shards is a
beginning of the paths on both sides of a shard bound, that is, it lies on the
trie of the splitter paths, the skeleton. That trie is sent to all tasks in its
smallest form: the numbers of turns that the paths on both sides of a shard
bound, and the first and last path of a shard, have in common. A shard then walks its sorted paths once, finishes all
nodes of its own, and gives partial aggregates for the skeleton's; these are
reduced by node, and sums over subtrees run once over the skeleton in path order.

What a path needs of a turn is its hash and its length. A turn that only one
conversation has at its place ends what can be shared: what comes after is a
chain of nodes with one member, written straight from the table, and paths hold
only the turns up to there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, partitions, written

#: Bytes of a turn's hash, path turns of a shard, ids of one block of ends.
WIDTH, SHARD_TURNS, BLOCK = 16, 200_000, 1 << 13
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")
#: Rows of a shard: nodes of its own (``parent`` is null unless that is a node of
#: the skeleton), parts of skeleton nodes, and blocks of ends of skeleton nodes.
SHARD = NODE + ", kind string, first int, parent int, place int, length long, ids binary"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_hash(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, hash, length): each conversation's turns numbered from 0 by
    turn (null first), then by role and hash.

    The narrow rows are range-sorted by all of that, so a hot conversation is
    dealt to several tasks; a row's number is its place in its task plus the rows
    that the conversation has in the tasks before."""
    spark = turns.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    narrow = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), turn_hash(role, text).alias("hash"),
        F.length(text).cast("long").alias("length"))
    order = ["conv_id", "turn", "role", "hash"]
    dealt = narrow.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = written(dealt.select("conv_id", "hash", "length", F.spark_partition_id().alias("task"),
                                  F.monotonically_increasing_id().alias("row")), "turns")
    spans = placed.groupBy("conv_id", "task").agg(F.min("row").alias("lo"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return placed.join(spans, ["conv_id", "task"]).select(
        "conv_id", (F.col("row") - F.col("lo") + F.col("base")).alias("pos"), "hash", "length")


def rebuilt_turns(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, hash, length) of each conversation c rebuilt: the first h
    turns of conversation c - c % 100, then c's own after its first h, with
    h = crc32(c) % 6. ``conversations`` has (conv_id, n) of the original ones."""
    plan = (conversations.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"),
                                 (F.col("conv_id") - F.col("conv_id") % 100).alias("base_id"))
            .join(conversations.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n")), "base_id", "left")
            .withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0)))))
    first = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") < 5)).withColumnRenamed("conv_id", "base_id")
    heads = (plan.filter("shared > 0").select("conv_id", "base_id", "shared").join(first, "base_id").filter("pos < shared")
             .select("conv_id", (F.col("pos") + 1).alias("depth"), "hash", "length"))
    own = (turns.join(plan.select("conv_id", "h", "shared"), "conv_id").filter("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("shared") + 1).alias("depth"), "hash", "length"))
    return heads.unionByName(own)


def _common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = x != y
    return (int(differ.argmax()) if differ.any() else n) // WIDTH


def _bound_depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first, last, after = (b.column(c).to_pylist() for c in ("first", "last", "after"))
        yield pa.RecordBatch.from_arrays(
            [b.column("shard"), pa.array(map(_common_turns, first, last), pa.int64()), pa.array(map(_common_turns, last, after), pa.int64())],
            ["shard", "within", "common"])


class Skeleton:
    """The trie of the splitter paths. ``bounds`` has for each shard but the last
    the number of turns that its own first and last path share, and the number
    that its last path and the next shard's first path share: the depth of the
    skeleton there. A node is named by its depth and the first shard that has it."""

    def __init__(self, bounds: dict[int, tuple[int, int]], shards: list[int]):
        self.before = dict(zip(shards[1:], shards[:-1], strict=True))
        self.size = sum(common + 1 for _, common in bounds.values())  # at least the number of its nodes
        self.names: dict[int, list[int]] = {}
        last: list[int] = []
        for s in shards[:-1]:
            within, common = bounds[s]
            last = last[:min(within, common) + 1]
            last = self.names[s] = [*last, *[s] * (common + 1 - len(last))]

    def at_start(self, shard: int) -> list[int]:
        """Names, by depth, of its nodes on the first path of a shard."""
        return self.names.get(self.before.get(shard), [])

    def at_end(self, shard: int) -> list[int]:
        """The same of the last path."""
        return self.names.get(shard, [])


class Shard:
    """All nodes of one shard's sorted paths, parents before children."""

    def __init__(self):
        self.rows = 0
        self.path, self.open, self.first_open = b"", [], []
        self.depth, self.parent, self.length = [], [], []
        self.conv, self.convs, self.children, self.leaves, self.saved = [], [], [], [], []
        self.ends: dict[int, list[int]] = {}

    def _node(self, depth: int, length: int) -> None:
        self.depth.append(depth)
        self.parent.append(self.open[-1] if self.open else -1)
        self.length.append(length)
        self.conv.append(None)
        for sums in (self.convs, self.children, self.leaves, self.saved):
            sums.append(0)
        self.open.append(len(self.depth) - 1)

    def add(self, path: bytes, lengths: list[int], conv_id: int, cut: bool) -> None:
        """The next path; a cut one goes on with turns that no other has."""
        if not self.rows:
            self._node(0, 0)
        shared = len(self.open) - 1 if path == self.path else _common_turns(path, self.path)
        del self.open[shared + 1:]
        for d in range(shared, len(lengths)):
            self._node(d + 1, lengths[d])
        node = self.open[-1]
        self.convs[node] += 1
        if self.conv[node] is None or conv_id < self.conv[node]:
            self.conv[node] = conv_id
        if cut:
            self.children[node] += 1
            self.leaves[node] += 1
        else:
            self.ends.setdefault(node, []).append(conv_id)
        self.path, self.rows = path, self.rows + 1
        if not self.first_open:
            self.first_open = list(self.open)

    def finish(self, shard: int, skeleton: Skeleton) -> Iterator[tuple]:
        """Rows of ``SHARD``: finished nodes, parts of the skeleton's nodes, and
        their ends in blocks."""
        named = dict(zip(self.first_open, skeleton.at_start(shard), strict=False))
        named |= dict(zip(self.open, skeleton.at_end(shard), strict=False))
        for k in range(len(self.depth) - 1, -1, -1):
            own = k not in named
            if own:
                self.leaves[k] = self.leaves[k] or 1
                self.saved[k] += (self.convs[k] - 1) * self.length[k]
            p = self.parent[k]
            if p >= 0:
                if self.conv[p] is None or self.conv[k] < self.conv[p]:
                    self.conv[p] = self.conv[k]
                self.convs[p] += self.convs[k]
                if own:
                    self.children[p] += 1
                    self.leaves[p] += self.leaves[k]
                    self.saved[p] += self.saved[k]
        for k, depth in enumerate(self.depth):
            p = self.parent[k]
            sums = (self.convs[k], self.children[k], self.leaves[k], self.saved[k])
            if k not in named:
                ids = ",".join(map(str, sorted(self.ends.get(k, ())))).encode()
                above = None if p < 0 or p in named else self.conv[p]
                yield (self.conv[k], depth, above, *sums, hashlib.sha256(ids).hexdigest(),
                       "node", None, named.get(p), None, None, None)
                continue
            yield (self.conv[k], depth, None, *sums, None, "part", named[k], None, shard, self.length[k], None)
            ids = sorted(self.ends.get(k, ()))
            for lo in range(0, len(ids), BLOCK):
                block = ",".join(map(str, ids[lo:lo + BLOCK])).encode()
                yield (ids[lo], depth, None, 0, 0, 0, 0, None, "ends", named[k], None, shard, None, block)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _walk(skeleton: Skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nodes = None, Shard()

        def finished() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in nodes.finish(shard, skeleton):
                rows.append(row)
                if len(rows) == 5_000:
                    yield _table(rows, SHARD_NAMES, SHARD_TYPES)
                    rows = []
            if rows:
                yield _table(rows, SHARD_NAMES, SHARD_TYPES)

        for b in batches:
            for s, path, lengths, conv_id, cut in zip(*(b.column(c).to_pylist() for c in PATH_NAMES), strict=True):
                if s != shard:
                    if shard is not None:
                        yield from finished()
                    shard, nodes = s, Shard()
                nodes.add(path, lengths, conv_id, cut)
        if shard is not None:
            yield from finished()
    return run


PATH_NAMES = ["shard", "path", "lengths", "conv_id", "cut"]
SHARD_NAMES = [c.split()[0] for c in SHARD.split(", ")]
SHARD_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]
               for c in SHARD.split(", ")]
NODE_NAMES, NODE_TYPES = SHARD_NAMES[:8], SHARD_TYPES[:8]


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blocks of each skeleton node, which come in order: one
    running hash, no list."""
    name, sha = None, None

    def row() -> pa.RecordBatch:
        return _table([(*name, sha.hexdigest())], ["first", "depth", "sha"], [pa.int32(), pa.int64(), pa.string()])

    for b in batches:
        for first, depth, ids in zip(*(b.column(c).to_pylist() for c in ("first", "depth", "ids")), strict=True):
            if (first, depth) != name:
                if name is not None:
                    yield row()
                name, sha = (first, depth), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids)
    if name is not None:
        yield row()


def _skeleton_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reduced nodes of the skeleton, in path order: sums over subtrees from
    the last to the first, then the parents' smallest members."""
    rows = [list(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    # first, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, length, sha
    open_, parent = [], []
    for k, r in enumerate(rows):
        del open_[r[1]:]
        parent.append(open_[-1] if open_ else -1)
        open_.append(k)
    for k in range(len(rows) - 1, -1, -1):
        r = rows[k]
        r[5] = r[5] or 1
        r[6] += (r[3] - 1) * r[7]
        if (p := parent[k]) >= 0:
            up = rows[p]
            up[4], up[5], up[6] = up[4] + 1, up[5] + r[5], up[6] + r[6]
    out = [(r[0], r[2], r[1], rows[p][2] if p >= 0 else None, *r[3:7], r[8] or EMPTY_SHA) for r, p in zip(rows, parent, strict=True)]
    if out:
        yield _table(out, ["first", *NODE_NAMES], [pa.int32(), *NODE_TYPES])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (``NODE``).

    Defined cases: turns without conv_id take no part; null role or text is
    empty; equal turns of a conversation are ordered by role and hash, repeated
    rows are turns of their own; a conversation that has no turns left ends at
    the root; an empty table has no nodes, not even the root; a conversation of
    very many turns is dealt to several tasks, but the beginning that it shares
    with others (16 bytes a turn) must fit one; other columns are ignored."""
    spark = conversations.sparkSession
    counts = written(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).filter("conv_id is not null")
                     .groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    rebuilt = written(rebuilt_turns(numbered_turns(conversations), counts), "rebuilt")
    alone = (rebuilt.groupBy("depth", "hash").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
             .filter("n = 1").groupBy("conv_id").agg(F.min("depth").alias("own_from")))
    turns = written(rebuilt.join(alone, "conv_id", "left").withColumn("own_from", F.coalesce("own_from", F.lit(2**62))), "trie-turns")

    ends = turns.groupBy("conv_id").agg(F.max("depth").alias("last_depth"))
    sha = F.when(F.col("depth") == F.col("last_depth"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY_SHA))
    tails = (turns.filter("depth > own_from").join(ends, "conv_id")
             .select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                     (F.col("depth") < F.col("last_depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                     F.lit(0).cast("long").alias("saved_tokens"), sha.alias("ends_sha256")))

    steps = F.array_sort(F.collect_list(F.when(F.col("depth") <= F.col("own_from"), F.struct("depth", "hash", "length"))))
    grouped = (turns.groupBy("conv_id").agg(steps.alias("steps"), F.max(F.col("depth") > F.col("own_from")).alias("cut")))
    paths = counts.select("conv_id").join(grouped, "conv_id", "left").select(
        "conv_id", F.coalesce(F.unhex(F.array_join(F.transform("steps.hash", F.hex), "")), F.lit(b"")).alias("path"),
        F.coalesce(F.col("steps.length"), F.array().cast("array<bigint>")).alias("lengths"), F.coalesce("cut", F.lit(False)).alias("cut"))
    held = turns.filter("depth <= own_from").count()
    n_shards = max(partitions(spark), held // SHARD_TURNS)
    shards = written(paths.repartitionByRange(n_shards, "path", "conv_id").withColumn("shard", F.spark_partition_id()), "paths")

    sides = written(shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")), "splitters")
    names = sorted(r["shard"] for r in sides.select("shard").collect())  # one number a shard, and two below
    follow = spark.createDataFrame(list(zip(names[:-1], names[1:], strict=True)), "shard int, next int")
    bounds = (sides.join(follow, "shard").join(sides.select(F.col("shard").alias("next"), F.col("first").alias("after")), "next")
              .select("shard", "first", "last", "after").mapInArrow(_bound_depths, "shard int, within long, common long").collect())
    skeleton = Skeleton({r["shard"]: (r["within"], r["common"]) for r in bounds}, names)

    dealt = shards.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    walked = written(dealt.select(*PATH_NAMES).mapInArrow(_walk(skeleton), SHARD), "trie-shards")

    blocks = walked.filter("kind = 'ends'").select("first", "depth", "place", "conv_id", "ids")
    hashes = (blocks.repartition(partitions(spark), "first", "depth").sortWithinPartitions("first", "depth", "place", "conv_id")
              .mapInArrow(_end_hashes, "first int, depth long, sha string"))
    reduced = (walked.filter("kind = 'part'").groupBy("first", "depth")
               .agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
                    F.max("length").alias("length")).join(hashes, ["first", "depth"], "left"))
    top = written(reduced.repartition(1).sortWithinPartitions("first", "depth")  # the skeleton alone
                  .mapInArrow(_skeleton_sums, "first int, " + NODE), "skeleton")

    nodes = walked.filter("kind = 'node'")
    above = top.select(F.col("first").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    if skeleton.size <= 200_000:
        above = F.broadcast(above)
    below = nodes.filter("parent is not null").join(above, ["parent", "depth"]).withColumn("parent_conv_id", F.col("above"))
    done = written(nodes.filter("parent is null").select(*NODE_NAMES).unionByName(below.select(*NODE_NAMES))
                   .unionByName(top.select(*NODE_NAMES)).unionByName(tails), "trie")
    for table in (counts, rebuilt, turns, shards, sides, walked, top):
        drop_written(table)
    return done
