import hashlib
import random

import numpy as np
import pytest

from conftest import ODD
from mailsift.llm import routing
from mailsift.llm.fm_substrings import FmIndex, remove_repeated_passages, repeated
from mailsift.llm.queries import op6_suffix_dedup, op10_fm_substrings
from mailsift.llm.suffix_dedup import remove_repeated_strings, repeated_prefixes

SF = "/root/testdata/sf0.001"


def brute(texts, length, split, join):
    """(units, removed, runs, kept) of each text."""
    units = [split(t) for t in texts]
    count = {}
    for u in units:
        for i in range(len(u) - length + 1):
            w = hash(bytes(u[i:i + length]) if isinstance(u, bytes) else tuple(u[i:i + length]))
            count[w] = count.get(w, 0) + 1
    out = []
    for u in units:
        gone = np.zeros(len(u) + 1, dtype=bool)
        for i in range(len(u) - length + 1):
            if count[hash(bytes(u[i:i + length]) if isinstance(u, bytes) else tuple(u[i:i + length]))] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((len(u), int(gone.sum()), runs, join([x for x, g in zip(u, gone, strict=False) if not g])))
    return out


def as_bytes(t):
    return (t or "").encode()


CASES = {"bytes": (remove_repeated_strings, as_bytes, bytes, 200),
         "words": (remove_repeated_passages, lambda t: as_bytes(t).split(), b" ".join, 35)}


def made(rng, n):
    """Texts with copies, near copies, shared passages, loops and short periods."""
    vocab = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 120))) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = i % 7
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 150)))
        if kind == 1 and rows:
            text = rng.choice(rows)[1]
        elif kind == 2 and rows:
            words = rng.choice(rows)[1].split()
            if words:
                words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        elif kind in (3, 4):
            text = f"{text[:rng.randint(0, 300)]} {rng.choice(passages)} {text[300:]}"
        elif kind == 5:
            text = text[:50] + " ab" * rng.randint(0, 300)
        rows.append((1000 + i, text))
    return rows


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("hot", [routing.HOT, 3])
def test_matches_brute_force(spark, documents, kind, hot, monkeypatch):
    monkeypatch.setattr(routing, "HOT", hot)
    remove, split, join, length = CASES[kind]
    rows = made(random.Random(9), 90) + [r for r in ODD if r[1] is None or len(r[1]) < 1000]
    rows += [(5000, "word " * 700), (5001, "b" * 3000)]
    line = " ".join(f"own{i}" for i in range(50))
    rows += [(5002, f"{line} {line} "), (5003, (line.replace("own", "two") + " ") * 3)]  # repeats of one document only
    want = brute([t for _, t in rows], length, split, join)
    got = remove(documents(rows), length).collect()
    counted = sorted(str((r["doc_id"], r[1], r["n_removed"], len(r["spans"]), bytes(r["kept"]))) for r in got)
    assert counted == sorted(str((i, *w)) for (i, _), w in zip(rows, want, strict=True))


@pytest.mark.parametrize("kind", CASES)
def test_texts_longer_than_a_block(spark, documents, kind, monkeypatch):
    monkeypatch.setattr(routing, "BLOCK", 50)
    remove, split, join, length = CASES[kind]
    rows = made(random.Random(3), 30)
    want = brute([t for _, t in rows], length, split, join)
    got = remove(documents(rows), length).collect()
    assert sorted((r["doc_id"], r[1], r["n_removed"], bytes(r["kept"])) for r in got) == sorted(
        (i, n, gone, kept) for (i, _), (n, gone, _, kept) in zip(rows, want, strict=True))


@pytest.mark.parametrize("kind", CASES)
def test_odd_and_empty(spark, documents, kind):
    remove = CASES[kind][0]
    assert len(remove(documents(ODD)).collect()) == len(ODD)
    assert remove(documents([])).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = brute([d["text"] for d in docs], 200, as_bytes, bytes)
    got = {r["doc_id"]: tuple(r)[1:] for r in op6_suffix_dedup(spark, SF).collect()}
    assert got == {d["doc_id"]: (n, m, runs, sha(k)) for d, (n, m, runs, k) in zip(docs, want, strict=True)}
    want = brute([d["text"] for d in docs], 35, lambda t: as_bytes(t).split(), b" ".join)
    got = {r["doc_id"]: tuple(r)[1:] for r in op10_fm_substrings(spark, SF).collect()}
    assert got == {d["doc_id"]: (n, m, sha(k)) for d, (n, m, _, k) in zip(docs, want, strict=True)}


@pytest.mark.parametrize("length", [34, 61, 200])
def test_difference_cover_order_finds_equal_prefixes(length):
    rng = np.random.default_rng(length)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[2000:2400] = text[100:500]
    text[2700:2900] = 97
    starts = np.flatnonzero(rng.random(3000 - length) < 0.8)
    raw = text.tobytes()
    seen = {}
    for s in starts:
        seen.setdefault(raw[s:s + length], []).append(s)
    got = repeated_prefixes(text, starts, length)
    assert got.tolist() == [len(seen[raw[s:s + length]]) > 1 for s in starts]


def test_fm_index_counts_patterns():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = FmIndex(text, 10)
    for _ in range(200):
        at, n = rng.integers(0, 380), rng.integers(1, 11)
        pattern = text[at:at + n]
        low, high = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            low, high = index.step(np.array([c]), low, high)
        want = sum(np.array_equal(text[i:i + n], pattern) for i in range(len(text) - n + 1))
        assert high[0] - low[0] == want


def test_streamed_windows():
    rng = np.random.default_rng(6)
    segments = [rng.integers(1, 3, rng.integers(12, 40)) for _ in range(30)]
    windows = np.array([len(s) - 11 for s in segments])
    flat = [tuple(s[i:i + 12]) for s, w in zip(segments, windows, strict=True) for i in range(w)]
    assert repeated(segments, windows, 12, np.arange(30)).tolist() == [flat.count(f) > 1 for f in flat]
    asked = np.array([3, 4, 17])  # the index holds all, some are streamed
    ends = np.cumsum(windows)
    want = [flat.count(f) > 1 for i in asked for f in flat[ends[i] - windows[i]:ends[i]]]
    assert repeated(segments, windows, 12, asked).tolist() == want


@pytest.mark.parametrize("kind", CASES)
def test_only_the_order_or_the_index_tells_equal_segments(spark, documents, kind, monkeypatch):
    """Copies go because a shard sees them twice, whatever ids they have."""
    import importlib
    remove, split, join, length = CASES[kind]
    text = " ".join(f"own{i}" for i in range(120))
    rows = [(1, text), (2, text), (None, text), (None, text), (7, text.replace("own", "two")),
            (7, text.replace("own", "two")), (8, text.replace("own", "one")), (9, f"{text.replace('own', 'in')}  " * 2)]
    want = brute([t for _, t in rows], length, split, join)
    got = sorted(str((r["doc_id"], r["n_removed"])) for r in remove(documents(rows), length).collect())
    assert got == sorted(str((i, w[1])) for (i, _), w in zip(rows, want, strict=True))
    module = importlib.import_module(remove.__module__)
    monkeypatch.setattr(module, "_decide", lambda n: lambda segments, windows, asked: np.zeros(windows[asked].sum(), dtype=bool))
    assert {r["n_removed"] for r in remove(documents(rows), length).collect()} == {0}
