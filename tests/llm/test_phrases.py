import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest import DOCS, ODD
from mailsift.llm import phrase_mining
from mailsift.llm.phrase_mining import Summary, _blocks, mine_collocations
from mailsift.llm.queries import op13_phrase_mining

SF = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for p in re.split(r"[.,;:!?\x0a-\x0d]", fold(text)) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, threshold, longest=4, top=2000):
    """Counts of all phrases, from which the contract is read off."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in words(text):
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = Counter({p: c for p, c in f.items() if c >= threshold})
    held = {}
    for (lang, *w), c in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner = (lang, *w[i:i + k])
                held[inner] = max(held.get(inner, 0), c)
    out = {}
    for (lang, *w), a in f.items():
        if len(w) > 1 and not 100 * held.get((lang, *w), 0) >= 80 * a:
            cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            score, k = min((2_000_000 * a // (x + y), k) for k, (x, y) in enumerate(cuts))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), *cuts[k]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -score)
                  for lang, found in out.items() for rank, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def random_docs(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "B", "c.", "dd,", "E!\n", "é", "É", "漢", "f\t", "g\x0bh", "i\x1cj", "\xa0", "?", "k:l"]
    return [(" ".join(rng.choice(vocabulary, size=rng.integers(0, 40))), [None, "x", "y", "und"][rng.integers(4)])
            for _ in range(n)]


@pytest.mark.parametrize("threshold,top", [(30, 2000), (12, 7)])
def test_equals_brute_force(spark, threshold, top):
    rows = random_docs()
    docs = spark.createDataFrame([(i % 9, t, lang, "s", 0, "z") for i, (t, lang) in enumerate(rows)], DOCS + ", phrase string")
    got = rows_of(mine_collocations(docs, threshold, 4, top))
    assert got == brute(rows, threshold, top=top) and len(got) > 4


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()
    assert rows_of(op13_phrase_mining(spark, SF)) == brute([tuple(r) for r in docs], 30)


def test_odd_rows(spark, documents):
    assert rows_of(mine_collocations(documents(ODD), 30)) == brute([(t, "en") for _, t in ODD], 30)
    assert mine_collocations(documents([]), 30).collect() == []
    assert mine_collocations(documents([(1, None), (2, "")]), 30).collect() == []


def test_blocks_and_slices_count_every_phrase_once(monkeypatch):
    monkeypatch.setattr(phrase_mining, "BLOCK_WORDS", 50)
    monkeypatch.setattr(phrase_mining, "SLICE", 60)
    rows = [*random_docs(60), ("a b c d e " * 400, "x"), (None, "x")]
    batch = pa.RecordBatch.from_pydict({"text": [(t or "").encode() for t, _ in rows], "lang": [x or "und" for _, x in rows]})
    got, want = Counter(), Counter()
    for block in _blocks(iter([batch]), 4):
        for k, at, _ in block.phrases(4):
            got.update((block.names[block.langs[i]], *(block.words[w].decode() for w in block.ids[i:i + k])) for i in at)
    for text, lang in rows:
        for w in words(text):
            want.update((lang or "und", *w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == want


def test_summaries_keep_all_frequent_keys():
    rng = np.random.default_rng(2)
    for threshold in (5, 30):
        keys = np.concatenate([rng.integers(0, 50_000, size=60_000), rng.integers(0, 600, size=20_000)]).astype(np.uint32)
        rng.shuffle(keys)
        halves = []
        for part in np.array_split(keys, 2):  # two summaries, merged
            s = Summary(len(keys) // threshold + 1)
            for some in np.array_split(part, 40):
                s.merge(some, np.ones(len(some), np.int64))
            halves.append(s)
        s = halves[0]
        s.merge(halves[1].keys, halves[1].counts, halves[1].taken)
        exact = Counter(keys.tolist())
        frequent = {k for k, c in exact.items() if c >= threshold}
        assert frequent <= set(s.at_least(threshold).tolist())
        assert 0 < s.taken < threshold and len(s.keys) <= s.capacity
        assert all(c <= exact[k] <= c + s.taken for k, c in zip(s.keys.tolist(), s.counts.tolist(), strict=True))
