import re
import zlib

import numpy as np

from conftest import ODD
from mailsift.llm.license_templates import compile_template, scan, scan_licenses, words_of
from mailsift.llm.ppm_langid import build, code_lengths, predict_languages
from mailsift.llm.queries import op3_license_templates, op9_ppm_langid

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(text):
    words = WORD.findall(lower(text or ""))
    hits = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def test_base_phrases_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op3_license_templates(spark, SF).collect()}
    assert sum(r["n_base"] for r in got.values()) > 0
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(d["text"])
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_odd_rows(spark, documents):
    rows = [*ODD, (20, "CC-BY cc by CC,BY Ccby"), (21, "All rights  reserved all RIGHTS reserved")]
    got = scan_licenses(documents(rows)).collect()
    assert sorted(str((r["doc_id"], r["n_words"], len(r["base_spans"]))) for r in got) == sorted(
        str((i, brute(t)[0], brute(t)[1])) for i, t in rows)
    assert scan_licenses(documents([])).collect() == []


def test_template_markup():
    a = compile_template("x", "use of <<beginOptional>>the <<beginOptional>>whole<<endOptional>> <<endOptional>>"
                              "software by <<var;words=2>> is granted")

    def places(text):
        return [(lo, hi) for _, lo, hi in scan(words_of(text.encode()), [a])]
    assert places("Use of software by is granted") == [(0, 6)]
    assert places("any use of the whole software, by A. B. is granted!") == [(1, 11)]
    assert places("use of whole software by x is granted") == []
    assert places("use of software by x y z is granted") == []
    assert places("use of software by x is not granted") == []


def test_code_lengths_are_a_distribution():
    rows = [("a", int.from_bytes(b"\0\0\0x", "big"), 3), ("a", int.from_bytes(b"\0\0xy", "big"), 2),
            ("a", int.from_bytes(b"\0xyx", "big"), 2), ("b", int.from_bytes(b"\0\0\0z", "big"), 1)]
    model = build(rows, 100)
    for start in (b"", b"x", b"xy", b"zz", b"xyx"):
        for i in range(len(model.langs)):
            total = sum(2 ** -(code_lengths(model, start + bytes([c])) - code_lengths(model, start))[i] for c in range(1, 256))
            assert 0.5 < total <= 1.01


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_ppm_langid(spark, SF).collect()
    assert len(got) == len(docs)
    hit = total = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["held_out"]:
            total += 1
            hit += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert hit / total > 0.97


def test_languages_of_odd_rows(spark, documents):
    got = {(r["doc_id"], r["lang_pred"]) for r in predict_languages(documents(ODD)).collect()}
    assert {i for i, p in got if p == "und"} == {1, 2, 3, None}
    assert (None, "en") in got and (8, "en") in got
    unlabelled = documents(ODD).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in predict_languages(unlabelled).collect()} == {"und"}
    assert predict_languages(documents([])).collect() == []


def slow_bits(texts, text):
    """Code length by the definition: contexts of 3, 2, 1 and 0 bytes before each
    byte, escapes, and what longer contexts have ruled out."""
    from collections import Counter, defaultdict
    from math import log2
    seen = sorted({b for t in sum(texts.values(), []) for b in t} - {0})

    def symbols(t):
        return [0, 0, 0, *((seen.index(b) + 1 if b in seen else len(seen) + 1) if b else 0 for b in t)]
    out = []
    for lang in sorted(texts):
        count = defaultdict(Counter)
        for t in texts[lang]:
            s = symbols(t)
            for i in range(3, len(s)):
                for k in range(4):
                    count[k, tuple(s[i - k:i])][s[i]] += 1
        bits, s = 0.0, symbols(text)
        for i in range(3, len(s)):
            gone = set()
            for k in (3, 2, 1, 0):
                here = {x: n for x, n in count[k, tuple(s[i - k:i])].items() if x not in gone}
                total, distinct = sum(here.values()), len(here)
                if s[i] in here:
                    bits -= log2(here[s[i]] / (total + distinct))
                    break
                if distinct:
                    bits -= log2(distinct / (total + distinct))
                gone |= set(here)
            else:
                bits += log2(max(1, 256 - len(gone)))
        out.append(bits)
    return out


def test_code_lengths_equal_brute_force():
    import random
    from collections import Counter
    rng = random.Random(3)
    texts = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))).encode() for _ in range(12)]
             for lang, letters in (("x", "abc "), ("y", "abdé "), ("z", "ba"))}
    grams = Counter()
    for lang, some in texts.items():
        for t in some:
            padded = b"\0\0\0" + t
            grams.update((lang, int.from_bytes(padded[i:i + 4], "big")) for i in range(len(t)))
    model = build([(lang, g, n) for (lang, g), n in grams.items()], 10_000)
    for text in ["", "a", "abcabc", "bababab", "dé dé", "zzz", "a\u6f22b", *("".join(rng.choice("abcdé z") for _ in range(50)) for _ in range(10))]:
        assert np.allclose(code_lengths(model, text.encode()), slow_bits(texts, text.encode()), atol=1e-2), text


def test_null_and_repeated_ids_bring_no_larger_sample(spark):
    rows = [(i, f"text number {n} of many", "en") for i in (None, 7) for n in range(3000)] + [(None, "same text", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    from unittest import mock

    from mailsift.llm import ppm_langid
    with mock.patch.object(ppm_langid, "build", lambda rows, most: seen.extend(rows)):
        ppm_langid.learn(docs, sample_docs=200)
    starts = sum(n for _, gram, n in seen if gram >> 8 == 0)  # the first byte of each sampled text
    assert 0 < starts < 600


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution. {} THIS SOFTWARE IS
PROVIDED BY THE REGENTS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = """3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""


def test_a_license_is_its_whole_wording(spark, documents):
    whole = MIT.format("THE AUTHORS OR COPYRIGHT HOLDERS")
    texts = {1: ("x\n" + whole + "\ny", {"mit", "mit-opening"}), 2: (whole.replace("TORT", "LOVE"), {"mit-opening"}),
             3: (MIT.format(" ".join(["word"] * 11)), {"mit-opening"}), 5: (BSD.format(THIRD), {"bsd-3-clause", "bsd-opening"}),
             4: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the Software), to deal in the Software without restriction, PROVIDED you pay the author "
                 "100 dollars and never redistribute it", {"mit-opening"}),
             6: (BSD.format(""), {"bsd-2-clause", "bsd-opening"}), 7: (BSD.format("3. Pay."), {"bsd-opening"}),
             8: (whole[:-20], {"mit-opening"})}
    got = scan_licenses(documents([(i, t) for i, (t, _) in texts.items()])).collect()
    assert {r["doc_id"]: {s["label"] for s in r["spans"]} for r in got} == {i: want for i, (_, want) in texts.items()}
