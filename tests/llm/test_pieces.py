import hashlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece.sentencepiece_model_pb2 import ModelProto, NormalizerSpec

from conftest import ODD
from mailsift.llm.piece_codec import PieceCodec, encode_with_offsets
from mailsift.llm.queries import PIECE_BPE, op12_piece_offsets
from test_tokens import STRANGE, random_texts

SF = "/root/testdata/sf0.001"
TEXTS = [*STRANGE, *random_texts(600), "   x", "▁", "▁▁a b", "a▁b", "<0x41>", "<unk></s>", "  " * 9 + "z", " " * 1000,
         "ﬁ Ⅳ  x　y ", "ｶﾞ ガ が", "\x1c \x1f", " \x1cx ", "\t\x1c  y", "a\n\n b\t", "2024-12-31", "\ue000"]


def model():
    with open(PIECE_BPE, "rb") as f:
        return f.read()


def with_rules(rule, squeeze):
    """The public model with a compiled character map and some unused pieces."""
    spec, norm = ModelProto(), NormalizerSpec()
    spec.ParseFromString(model())
    norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    spec.normalizer_spec.precompiled_charsmap = norm.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces = squeeze
    for k in np.random.default_rng(3).integers(300, 20_000, size=500):
        spec.pieces[int(k)].type = 5
    return spec.SerializeToString()


@pytest.mark.parametrize("make", [model, lambda: with_rules("nmt_nfkc", True), lambda: with_rules("nmt_nfkc_cf", False)])
def test_ids_spans_and_text_equal_the_library(make):
    raw = make()
    mine, lib = PieceCodec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in TEXTS:
        ids = np.frombuffer(mine.encode(t), np.int32)
        assert ids.tolist() == lib.encode(t), repr(t)
        assert mine.decode(ids.tolist()) == lib.decode(ids.tolist()), repr(t)
        starts, ends = mine.spans(t, ids)
        want = [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want, repr(t)


def test_decoding_any_ids_equals_the_library():
    mine, lib = PieceCodec(model()), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rng = np.random.default_rng(5)
    for _ in range(500):
        ids = rng.integers(0, rng.choice([300, 32_000]), size=rng.integers(0, 12)).tolist()
        assert mine.decode(ids) == lib.decode(ids), ids


def test_spans_cover_the_source():
    mine = PieceCodec(model())
    text = "Éa  été 漢 \U0001f525x\n" * 50
    ids = np.frombuffer(mine.encode(text), np.int32)
    starts, ends = mine.spans(text, ids)
    assert b"".join(text.encode()[a:b] for a, b in zip(starts, ends, strict=True)) == text.encode()


def test_very_long_texts():
    mine, lib = PieceCodec(model()), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for text in ("it's  a word,\n" * 200_000, "ab" * 60_000, " " * 300_000, "x▁y " * 20_000):
        assert np.frombuffer(mine.encode(text), np.int32).tolist() == lib.encode(text)


def test_odd_rows(spark, documents):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = encode_with_offsets(documents(ODD), PIECE_BPE).collect()
    assert sorted(str((r["doc_id"], r["ids"], r["decoded"])) for r in got) == sorted(
        str((i, lib.encode(t or ""), lib.decode(lib.encode(t or "")))) for i, t in ODD)
    assert encode_with_offsets(documents([]), PIECE_BPE).collect() == []


def test_query_equals_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op12_piece_offsets(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids, r = lib.encode(d["text"]), got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["n_bytes"]) == (
            len(ids), sha(",".join(map(str, ids))), len(d["text"].encode()))
        assert r["decoded_sha256"] == sha(lib.decode(ids))


def test_other_kinds_are_refused():
    spec = ModelProto()
    spec.ParseFromString(model())
    spec.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        PieceCodec(spec.SerializeToString())
