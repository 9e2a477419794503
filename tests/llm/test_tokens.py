import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import ODD
from mailsift.llm.curve_packing import hilbert_key, pack_along_curve
from mailsift.llm.forced_bpe import ForcedBpe, encode_decode
from mailsift.llm.queries import BYTE_BPE, WORD_BPE, op2_token_files, op4_curve_packing, op7_forced_bpe
from mailsift.llm.token_files import read_token_files, write_token_files
from mailsift.llm.tokens import TextEncoder, slices

SF = "/root/testdata/sf0.001"
STRANGE = ["", " ", "  a", "a  ", "\n\n a\t\tb ", "it's 'S we'LL x's", "a\xa0b  c　\x85d", "\x1c a\x1d\x1eb \x1f",
           "12345 x9 ٢٣ ½²", "<|endoftext|>a  <|endoftext|> <|startoftext|>b", "é É İ ΣΣ ẞ ﬁ",
           "\U0001f600‍\U0001f525 漢字かな الع", "___a_b-c---  ...!!!", "a​b᠎c﻿d", "́a ́", "zz" * 500,
           "naïve—café “q”", "\x00\x01a\x7f", " x y z", "aaa" * 20_000, "퟿ \U0010ffff"]


def random_texts(n=400, seed=4):
    rng = np.random.default_rng(seed)
    pools = [[*range(32, 127)], [9, 10, 13, 32, 0xa0, 0x85, 0x2003, 0x3000, 0x1c, 0x1f], [*range(0xc0, 0x250)],
             [*range(0x370, 0x3ff)], [*range(0x4e00, 0x4e40)], [0x301, 0x308, 0x200b, 0x27, 0x5f, 0xbd, 0x663, 0x1f600]]
    out = []
    for _ in range(n):
        pool = sum((pools[i] for i in rng.choice(6, size=3)), [])
        out.append("".join(chr(c) for c in rng.choice(pool, size=rng.integers(1, 60))))
    return out


def test_encoder_equals_the_library():
    enc, lib = TextEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for t in STRANGE + random_texts():
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_forced_boundaries_equal_the_library():
    bpe, lib = ForcedBpe(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for t in STRANGE + random_texts():
        ids = np.frombuffer(bpe.encode(t), "<i4").tolist()
        assert ids == lib.encode(t, add_special_tokens=False).ids, repr(t)
        assert bpe.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_very_long_texts_are_encoded_in_slices():
    text = "it's  a word,\n" * 200_000 + "x" * 50_000
    enc, bpe = TextEncoder(BYTE_BPE), ForcedBpe(WORD_BPE)
    assert len(list(slices(text))) > 1 and "".join(slices(text)) == text
    for mine, path in ((enc, BYTE_BPE), (bpe, WORD_BPE)):
        assert np.frombuffer(mine.encode(text), "<i4").tolist() == Tokenizer.from_file(path).encode(
            text, add_special_tokens=False).ids


def test_fragments_are_forced():
    bpe = ForcedBpe(WORD_BPE)
    word = [bpe.symbols[b] for b in "zqxjkvbéß漢".encode()]
    word[-1] += "</w>"
    parts = bpe.fragments(word)
    assert len(parts) > 1 and [s for p in parts for s in p] == word


def test_documents_round_trip(spark):
    lib = Tokenizer.from_file(BYTE_BPE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in op2_token_files(spark, SF).collect()}
    at = 0
    for d in docs:
        ids = [*lib.encode(d["text"], add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def check_pieces(rows, texts, length):
    """Each id of each document in exactly one piece, sequences gapless and without padding."""
    lib = Tokenizer.from_file(BYTE_BPE)
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["crc"], r["doc_tokens"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == length or at < length and at & (at - 1) == 0
    for doc, all_texts in texts.items():
        want = []
        for t in all_texts:
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want.append((len(ids), ids))
        if len(want) == 1:
            at, (n, ids) = 0, want[0]
            for start, m, crc, tokens in sorted(docs[doc]):
                assert start == at and tokens == n and crc == zlib.crc32(ids[start:start + m].tobytes())
                at += m
            assert at == n
        else:
            assert sum(m for _, m, _, _ in docs[doc]) == sum(n for n, _ in want)


def test_packing(spark, documents):
    from pyspark.sql import functions as F
    src = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [r.asDict() | {"crc": r["ids_crc32"]} for r in op4_curve_packing(spark, SF).collect()]
    check_pieces(rows, {r["doc_id"]: [r["text"]] for r in src}, 2048)
    odd = pack_along_curve(documents(ODD), BYTE_BPE, 1, 64).withColumn("crc", F.crc32("token_bytes")).collect()
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, []).append(t)
    check_pieces(odd, texts, 64)
    assert pack_along_curve(documents([]), BYTE_BPE, 1, 64).collect() == []


def test_hilbert_neighbours():
    side = np.arange(8)
    cells = np.array([(x, y, z) for x in side for y in side for z in side])
    keys = hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_token_files_of_odd_rows(spark, documents):
    folder = write_token_files(documents(ODD), BYTE_BPE, 2)
    got = read_token_files(spark, folder).collect()
    assert sorted(r["doc_id"] is None for r in got) == sorted(i is None for i, _ in ODD)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and len(r["token_bytes"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(
        (i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    assert read_token_files(spark, write_token_files(documents([]), BYTE_BPE, 2)).collect() == []


def test_word_bpe_of_odd_rows(spark, documents):
    lib = Tokenizer.from_file(WORD_BPE)
    got = encode_decode(documents(ODD), WORD_BPE).collect()
    want = sorted(str((i, lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == want
    assert encode_decode(documents([]), WORD_BPE).collect() == []


def test_word_bpe_query(spark):
    import hashlib
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op7_forced_bpe(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = lib.encode(d["text"], add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(lib.decode(ids, skip_special_tokens=False))


def test_other_kinds_are_refused():
    with pytest.raises((ValueError, KeyError)):
        ForcedBpe(BYTE_BPE)


def test_a_third_of_null_ids_is_dealt_to_several_files(spark, documents):
    import json

    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i % 400}") for i in range(3000)]
    folder = write_token_files(documents(rows), BYTE_BPE, 2)
    got = read_token_files(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    with open(f"{folder.removeprefix('file://')}/manifest.json") as f:
        files = json.load(f)["files"]
    assert sum(f["null_ids"] > 0 for f in files) > 1 and max(f["docs"] for f in files) < 1000
    assert folder.startswith("file:///")
