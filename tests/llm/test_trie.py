import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mailsift.llm import prefix_trie
from mailsift.llm.prefix_trie import conversation_trie
from mailsift.llm.queries import op11_splitter_trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth long, hash string, path int"


def brute(rows):
    """The contract, node by node."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            md5 = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0, role, md5), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    nodes = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, len(path) == d))
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves, saved, stack = 0, 0, [p]
        while stack:
            q = stack.pop()
            leaves += q not in children
            saved += (len(nodes[q]) - 1) * len(q[-1][1]) if q else 0
            stack += children.get(q, [])
        return leaves, saved

    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        out.append((min(members)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(members), len(children.get(p, [])),
                    *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 9, "z", 1) for r in rows], TURNS)
    return sorted((tuple(r) for r in conversation_trie(df).collect()), key=str)


def random_rows(n, turns, words, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(c), int(t), str(rng.choice(["user", "bot"])), str(rng.choice(words)))
            for c in rng.choice(1000, size=n, replace=False) for t in range(rng.integers(0, turns))]
    rng.shuffle(rows)
    return [(int(c), int(t), r, x) for c, t, r, x in rows]


@pytest.mark.parametrize("shard_turns", [40, 200_000])
def test_equals_brute_force(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rows = random_rows(150, 9, ["a", "bb", "é漢"], 1)
    assert run(spark, rows) == brute(rows)


def test_hot_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 20)
    rows = [(c, t, "user", f"turn {t}") for c in range(200, 420) for t in range(4)]
    rows += [(7, t, "user", f"own {t % 5}") for t in range(120)]
    rows += [(c, t, "user", "same") for c in (500, 600) for t in range(60)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"),
            (1, 0, "a", "x"), (2, 5, "a", "long " * 50_000), (3, 0, "a", ""), (3, 1, "ab", ""), (4, 0, "a", "b"),
            (100, 0, "s", "head"), (101, 9, "u", "tail"), (-5, 1, "u", "minus"), (-105, 1, "u", "minus"), (-100, 0, "s", "head"),
            (10**15, 0, "u", "x")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[1] == 0 and r[7] != prefix_trie.EMPTY_SHA for r in got)  # a turnless conversation ends at the root
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
           for r in op11_splitter_trie(spark, SF).collect()]
    assert sorted(got, key=str) == brute(rows)
