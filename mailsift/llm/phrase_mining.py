"""Collocations: phrases of neighbouring words that are frequent and bound.

Two passes over the texts. The first finds which phrases can be frequent:

* every phrase of 1 to ``longest`` words (with its language) has a 64-bit hash;
  blocks of texts count their hashes, and the sorted counts are written in parts
  by the hash's first bits, the hash partition;
* each partition merges its parts into one Misra-Gries summary of more counters
  than its mass (all occurrences) divided by the threshold. Merging adds equal
  counters and, when there are too many, takes the largest that does not fit off
  all of them. What was taken off in all is then below the threshold, so a
  phrase that reaches it is still there. Phrases whose counter plus all that was
  taken off stays below the threshold cannot reach it and go.

The second pass counts exactly: occurrences whose hash may be a survivor (a
bitmap of fixed largest size over the hash's first bits; a false hit only costs
a row) are counted by their words, per block and then over all blocks.

Words of a block are numbered by a dictionary, so phrases of the second pass are
told apart by their words; hash collisions of the first pass only let more
phrases survive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, partitions, written

#: Characters that end a piece, and those between words (fixed values).
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
NO_LANGUAGE = "und"
#: Words of a block, texts of a slice, characters a hash partition stands for,
#: least and most hash partitions, and bits of the largest survivor bitmap.
BLOCK_WORDS, SLICE, PART_CHARS, LEAST_PARTS, MOST_PARTS, MOST_BITS = 700_000, 1 << 19, 1 << 23, 1 << 11, 1 << 17, 28

_FOLD = bytes.maketrans(bytes(range(65, 91)) + STOPS + b"\t", bytes(range(97, 123)) + b"." * len(STOPS) + b" ")
_CUT = re.compile(rb"[ .]")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    """Numbers of a block's words; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class Block:
    """Numbered words of some texts: ``ids`` with 0 between pieces, ``langs``
    beside them, and the first ``carried`` entries counted by the block before."""

    def __init__(self, words: list[bytes], ids: np.ndarray, langs: np.ndarray, names: list[str], carried: int):
        self.words, self.ids, self.langs, self.names, self.carried = words, ids, langs, names, carried
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        salts = np.fromiter((xxhash.xxh64_intdigest(n.encode(), 1) for n in names), np.uint64, len(names))
        self.word_hash, self.salt = hashes[ids], salts[langs]

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each length: the places of all phrases and their hashes."""
        n = len(self.ids)
        inside = self.ids != 0
        h = self.word_hash
        for k in range(1, longest + 1):
            if k > 1:
                if n < k:
                    return
                h = _mix(h[:-1]) + self.word_hash[k - 1:]
                inside = inside[:-1] & (self.ids[k - 1:] != 0)
            at = np.flatnonzero(inside)
            at = at[at + k > self.carried]
            yield k, at, _mix(h[at] ^ self.salt[at] + np.uint64(k))


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SLICE and (cut := _CUT.search(text, at + SLICE)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Block]:
    """The texts of a task in blocks. A text may run over several: the last
    words before a bound come again in front of the next block, uncounted."""
    numbers, names = _Numbers({b".": 0}), {}
    ids, langs, size, carried = [], [], 0, 0

    def block() -> Block:
        return Block(list(numbers), np.concatenate(ids), np.concatenate(langs), list(names), carried)

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            lang_id = names.setdefault(lang, len(names))
            folded = text.as_py().translate(_FOLD)
            for part in _slices(folded):
                one = np.fromiter(map(numbers.__getitem__, part.replace(b".", b" . ").split()), np.int32)
                ids.append(one)
                langs.append(np.full(len(one), lang_id, np.int32))
                size += len(one)
                if size >= BLOCK_WORDS:
                    done = block()
                    tail = done.ids[1 - longest:] if longest > 1 else done.ids[:0]
                    words, tail_langs = [done.words[i] for i in tail], done.langs[len(done.ids) - len(tail):]
                    yield done
                    numbers, names = _Numbers({b".": 0}), {}
                    kept = [names.setdefault(done.names[i], len(names)) for i in tail_langs]
                    ids = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))]
                    langs = [np.array(kept, np.int32)]
                    size = carried = len(words)
                    lang_id = names.setdefault(lang, len(names))
                    del done
            ids.append(np.zeros(1, np.int32))
            langs.append(np.full(1, lang_id, np.int32))
            size += 1
    if size:
        yield block()


def _counts(bits: int, longest: int):
    """Counted hashes of each block, in one row a partition: 32-bit remainders
    in ascending order and their counts in bytes (a larger count takes several
    entries)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, longest):
            hashes, n = np.empty(longest * len(block.ids), np.uint64), 0
            for _, _, h in block.phrases(longest):
                hashes[n:n + len(h)] = h >> np.uint64(32 - bits)
                n += len(h)
            if not n:
                continue
            found, counts = _summed(hashes[:n], None)
            del hashes
            if len(big := np.flatnonzero(counts > 255)):
                times = np.ones(len(counts), np.int64)
                times[big] = -(-counts[big] // 255)
                last = counts - 255 * (times - 1)
                found, ends = np.repeat(found, times), np.cumsum(times) - 1
                counts = np.full(len(found), 255, np.int64)
                counts[ends] = last
            part = (found >> np.uint64(32)).astype(np.int64)
            starts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            rest, small = found.astype(np.uint32), counts.astype(np.uint8)
            mass = np.add.reduceat(counts, starts[:-1])
            cells = [(rest[a:b].tobytes(), small[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[starts[:-1]]), pa.array(mass), pa.array([c[0] for c in cells], pa.binary()),
                 pa.array([c[1] for c in cells], pa.binary())], ["part", "mass", "rest", "counts"])
    return run


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts; without counts each
    key counts one, and the keys are sorted in place."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts[:0]


class Summary:
    """A Misra-Gries summary: counters of at most ``capacity`` keys, and what
    was taken off every counter so far."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        """Add another summary, or counted keys."""
        keys, counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.taken += taken
        if len(keys) > self.capacity:
            off = int(np.partition(counts, len(counts) - 1 - self.capacity)[len(counts) - 1 - self.capacity])
            stay = counts > off
            keys, counts = keys[stay], counts[stay] - off
            self.taken += off
        self.keys, self.counts = keys, counts

    def at_least(self, threshold: int) -> np.ndarray:
        """Keys that may have reached the threshold, in order."""
        return self.keys[self.counts + self.taken >= threshold]


def _survivors(threshold: int):
    """One summary a partition, of rows that come sorted by it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary, held, size = None, None, [], 0

        def merge() -> None:
            nonlocal held, size
            if held:
                summary.merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held, size = [], 0

        def row() -> pa.RecordBatch:
            merge()
            keys = summary.at_least(threshold)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(keys)], pa.int64()),
                                               pa.array([keys.tobytes()], pa.binary())], ["part", "n", "keys"])

        for b in batches:
            parts, mass = b.column("part").to_pylist(), b.column("part_mass").to_pylist()
            for i, p in enumerate(parts):
                if p != part:
                    if summary is not None:
                        yield row()
                    part, summary = p, Summary(mass[i] // threshold + 1)
                keys = np.frombuffer(b.column("rest")[i].as_py(), np.uint32)
                held.append((keys, np.frombuffer(b.column("counts")[i].as_py(), np.uint8).astype(np.int64)))
                size += len(keys)
                if size >= 2 * summary.capacity + 100_000:
                    merge()
        if summary is not None:
            yield row()
    return run


def _bitmap_rows(bits: int, of: int):
    """Each partition's stretch of the bitmap over the first ``of`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stretches = []
            for keys in b.column("keys"):
                flags = np.zeros(1 << (of - bits), np.uint8)
                flags[np.frombuffer(keys.as_py(), np.uint32) >> np.uint32(32 - (of - bits))] = 1
                stretches.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(stretches, pa.binary())], ["part", "stretch"])
    return run


def _exact(bitmap, of: int, longest: int):
    """Phrases of each block whose hash is in the bitmap, with their counts, and
    one row without phrase for the words of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(bitmap.value, np.uint8)
        for block in _blocks(batches, longest):
            langs, phrases, counts = [], [], []
            for k, at, h in block.phrases(longest):
                if k == 1:
                    words = np.bincount(block.langs[at], minlength=len(block.names))
                    langs += [block.names[i] for i in np.flatnonzero(words)]
                    phrases += [None] * int((words > 0).sum())
                    counts += words[words > 0].tolist()
                place = h >> np.uint64(64 - of)
                at = at[(flags[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                # number the phrases word by word: equal numbers are equal words
                number = block.langs[at].astype(np.int64)
                for j in range(k):
                    number = np.unique(number * len(block.words) + block.ids[at + j], return_inverse=True)[1]
                _, first, times = np.unique(number, return_index=True, return_counts=True)
                for i, n in zip(at[first].tolist(), times.tolist(), strict=True):
                    langs.append(block.names[block.langs[i]])
                    phrases.append(b" ".join([block.words[w] for w in block.ids[i:i + k]]))
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                                              pa.array(counts, pa.int64())], ["lang", "phrase", "n"])
    return run


def frequent_phrases(docs: DataFrame, threshold: int, longest: int, text_col: str = "text",
                     lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``threshold`` times or
    more in a language (lang, phrase, f), and the words of each (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (min(max(chars // PART_CHARS, LEAST_PARTS), MOST_PARTS) - 1).bit_length()
    parts = written(rows.mapInArrow(_counts(bits, longest), "part long, mass long, rest binary, counts binary"), "phrase-counts")
    mass = parts.groupBy("part").agg(F.sum("mass").alias("part_mass"))
    dealt = (parts.select("part", "rest", "counts").join(F.broadcast(mass), "part")  # a row a partition, at most MOST_PARTS
             .repartition(partitions(spark), "part").sortWithinPartitions("part"))
    alive = written(dealt.mapInArrow(_survivors(threshold), "part long, n long, keys binary"), "phrase-survivors")
    count = alive.agg(F.sum("n")).first()[0] or 0
    of = min(max((64 * count).bit_length(), bits + 3), MOST_BITS)
    flags = np.zeros(1 << of >> 3, np.uint8)
    width = 1 << (of - bits) >> 3
    for r in alive.mapInArrow(_bitmap_rows(bits, of), "part long, stretch binary").collect():  # at most 2 ** MOST_BITS bits in all
        flags[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(r["stretch"], np.uint8)
    bitmap = spark.sparkContext.broadcast(flags.tobytes())
    counted = rows.mapInArrow(_exact(bitmap, of, longest), "lang string, phrase string, n long")
    sums = written(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
                   .filter(F.col("phrase").isNull() | (F.col("f") >= threshold)), "phrases")
    bitmap.unpersist()
    drop_written(parts)
    drop_written(alive)
    return (sums.filter(F.col("phrase").isNotNull()),
            sums.filter(F.col("phrase").isNull()).select("lang", F.col("f").alias("n")))


def _words_slice(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def mine_collocations(docs: DataFrame, threshold: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000,
                      inside_pct: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2
    to ``longest`` words that occur ``threshold`` times or more.

    a, l and r are the occurrences of the phrase and of the two parts of its
    lowest-scoring cut, score is floor(scale * a / (l + r)), n the words of the
    language. A phrase inside a longer one with ``inside_pct`` % of its
    occurrences goes. Order: score, a (descending), phrase (bytes).

    Defined cases: a null text is empty, a null language is ``und``; repeated
    rows count each; null and equal ids do not matter; equal cuts take the
    shortest first part; very long texts are worked on in blocks; an empty table,
    or one without frequent phrases, gives no rows; other columns are ignored."""
    found, totals = frequent_phrases(docs, threshold, longest, text_col, lang_col)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    phrases = found.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1)
    cuts = (phrases.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", _words_slice(1, F.col("k")).alias("left"),
                    _words_slice(F.col("k") + 1, F.size("w") - F.col("k")).alias("right")))
    scored = (cuts.join(found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
              .join(found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
              .withColumn("score", F.expr(f"cast(cast(a as decimal(20,0)) * {scale} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")))
    lowest = (scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m"))
              .select("lang", "phrase", "m.score", "m.a", "m.l", "m.r"))
    none = F.array().cast("array<string>")

    def inner(n: int) -> Column:
        """The phrases of n words inside a longer one."""
        return F.when(F.size("w") > n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)),
                                                   lambda i: _words_slice(i, n))).otherwise(none)

    held = (phrases.select("lang", "f", F.explode(reduce(F.array_union, map(inner, range(2, longest)), none)).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    own = (lowest.join(held, ["lang", "phrase"], "left")
           .filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * inside_pct)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
