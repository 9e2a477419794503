import random

import numpy as np
import xxhash

from conftest import ODD
from mailsift.llm.components import connected_components
from mailsift.llm.simhash_covering import covering_masks, simhash_groups


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_every_pair_within_the_radius_collides():
    masks = covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(3)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(diff & m == 0 for m in masks)


def test_groups_match_brute_force(spark, documents):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for i in range(20, 90):
        if i % 3:
            rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 300)))))
        else:
            words = (rows[-1][1] or "x").split()
            rows.append((i, " ".join(words + ["tail"] * (i % 2))))
    small = [(i, t) for i, t in rows if t is None or len(t) < 5000]
    got = simhash_groups(documents(small)).collect()
    fps = [brute(t) for _, t in small]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] & (2**64 - 1)) for r in got) == sorted(
        (i is None, i or 0, f) for (i, _), f in zip(small, fps))
    comp = list(range(len(small)))
    changed = True
    while changed:
        changed = False
        for a in range(len(small)):
            for b in range(a):
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    low = {}
    for (i, _), c in zip(small, comp):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    want = sorted(str((i, low.get(c))) for (i, _), c in zip(small, comp))
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == want


def test_long_and_empty(spark, documents):
    assert simhash_groups(documents([])).collect() == []
    assert len(simhash_groups(documents(ODD)).collect()) == len(ODD)


def test_hot_bucket_in_blocks(spark, monkeypatch):
    import mailsift.llm.simhash_covering as m
    monkeypatch.setattr(m, "BLOCK", 8)
    fps = [(1 << i) | (1 << j) for i in range(20) for j in range(i)]
    links = m.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    assert {r["root"] for r in connected_components(links).collect()} == {min(fps)}


def test_components_of_a_chain(spark):
    order = np.random.default_rng(0).permutation(200)
    edges = [(int(order[i]), int(order[i + 1])) for i in range(199) if i != 120]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (order[:121], order[121:]):
        assert {got[int(x)] for x in part} == {int(part.min())}
