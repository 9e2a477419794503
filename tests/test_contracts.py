"""Contracts, source order, hostile messages and date forms."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from mailsift.functions import text as T
from mailsift.functions.dates import infer_columns
from mailsift.operators import model_io as M
from mailsift.sources import messages as SM

GOOD = {"major_category": "core_communication", "sub_action_key": "COMM_REPLY_REQUIRED", "explicit_task": True,
        "confidence": 0.7}


def violations(spark, rows):
    df = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(rows)], "message_id string, raw_text string")
    parsed = M.parse_model_text(df)
    got = parsed.select("message_id", M.contract_violations().alias("v")).collect()
    return [r.v for r in sorted(got, key=lambda r: int(r.message_id))]


def test_output_contract_types(spark):
    action = {"key": "a", "label": "b"}
    cases = [
        ({}, []), ({"confidence": "0.55", "explicit_task": "true"}, []), ({"task_proposal": None}, []),
        ({"recommended_actions": [action | {"rank": "2"}]}, []),
        ({"recommended_actions": [action | {"rank": "high"}]}, ["recommended_actions[0].rank: not an integer"]),
        ({"recommended_actions": "reply"}, ["recommended_actions: not an array"]),
        ({"urgency_signals": 5}, ["urgency_signals: not an object"]),
        ({"urgency_signals": {"reason": None}}, ["urgency_signals.reason: not a string"]),
        ({"evidence": ["a", {"b": 1}]}, ["evidence[1]: not a string"]),
        ({"evidence": None}, ["evidence: not an array"]),
        ({"entities": {"money": [{"text": "x", "amount": "five"}]}}, ["entities.money[0].amount: not a number"]),
        ({"entities": {"money": [{"amount": 5}]}}, ["entities.money[0].text: missing"]),
        ({"sub_action_key": 7}, ["sub_action_key: not a string"]),
    ]
    assert violations(spark, [GOOD | extra for extra, _ in cases]) == [want for _, want in cases]


def checked(spark, messages):
    df = spark.createDataFrame([(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages)],
                               "position long, value string")
    return SM.validate_raw(SM.parse_raw(df))


def test_input_contract_types(spark):
    payload = {"mimeType": "text/plain", "headers": [{"name": "To", "value": "x@y.example"}]}
    cases = [
        ({"id": 5, "payload": payload}, ["id: not a string"]),
        ({"id": "a", "payload": payload | {"headers": "oops"}}, ["payload.headers: not an array"]),
        ({"id": "a", "payload": payload | {"headers": [{"name": "To", "value": {}}]}},
         ["payload.headers[0].value: not a string"]),
        ({"id": "a", "payload": payload | {"parts": "x"}}, ["payload.parts: not an array"]),
        ({"id": "a", "payload": payload | {"parts": [payload | {"headers": [{"name": "a"}]}]}},
         ["payload.parts[0].headers[0].value: missing"]),
    ]
    good, bad = checked(spark, [m for m, _ in cases] + [{"id": "ok", "payload": payload}])
    assert good.count() == 1
    assert [r.violations for r in sorted(bad.collect(), key=lambda r: r.position)] == [v for _, v in cases]


@pytest.mark.parametrize("depth", [9, 40])
def test_any_mime_depth(spark, depth):
    node = {"mimeType": "text/plain", "body": {"data": "aGVsbG8"}}
    for _ in range(depth):
        node = {"mimeType": "multipart/mixed", "parts": [node]}
    good, bad = checked(spark, [{"id": "deep", "payload": node}])
    assert bad.count() == 0
    assert SM.normalize(good).first().body_text == "hello"


HOSTILE = {
    "tags": "<b>" * 350_000, "open script": "<script " * 120_000, "script": "<script>" * 120_000, "angles": "<" * 1_000_000,
    "comments": "<!--" * 250_000, "images": "<img " * 200_000, "mixed": "<br>x" * 200_000,
    "quotes": '<a b="' * 150_000, "one quote": "<" * 500_000 + '="x>', "swallowed": "<" * 500_000 + '=">"',
    "single": "<i a='\">" * 120_000, "equals": "<=" * 400_000 + ">", "open values": "<script a='" * 90_000, "plain": "5 < 6 and 7 > 2"}


@pytest.mark.parametrize("kind", HOSTILE)
def test_html_is_linear(spark, kind):
    df = spark.createDataFrame([(HOSTILE[kind],), ("<p>a</p>b",)], "h string")
    df.select(T.html_to_text("h").alias("t")).collect()
    began = time.time()
    out = [r.t for r in df.select(T.html_to_text("h").alias("t")).collect()]
    assert time.time() - began < 4 and "a\nb" in out


def test_long_headers_and_subjects(spark):
    df = spark.createDataFrame([("x" * 100_000, "Re: " * 20_000 + "topic"), ('"a, b" <c@d.example>, e@f.example', "Fwd: re: z"),
                                ("<" * 100_000, "Re")], "a string, s string")
    began = time.time()
    rows = df.select(SM.parse_addresses("a").alias("a"), T.subject_topic("s").alias("s")).collect()
    assert time.time() - began < 10
    assert [r.s for r in rows][:2] == ["topic", "z"] and [x.email for x in rows[1].a] == ["c@d.example", "e@f.example"]


def test_source_positions_are_dense_and_stable(spark, tmp_path):
    for name, n in (("a", 3), ("b", 5), ("c", 2)):
        (tmp_path / f"{name}.txt").write_text("".join(json.dumps({"id": f"{name}{i}"}) + "\n\n" for i in range(n)))
    for fmt in ("jsonl", "auto"):
        got = SM.read_messages(spark, str(tmp_path), fmt).collect()
        ids = [json.loads(r.value)["id"] for r in sorted(got, key=lambda r: r.position)]
        assert sorted(r.position for r in got) == list(range(10))
        assert ids == ["a0", "a1", "a2", "b0", "b1", "b2", "b3", "b4", "c0", "c1"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        got = SM.read_messages(spark, str(tmp_path)).collect()
        assert [json.loads(r.value)["id"] for r in sorted(got, key=lambda r: r.position)] == ids
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert os.listdir(tmp_path)


def test_date_headers(spark):
    cases = {"Mon, 5 Feb 2024 10:00:00 PST": ("2024-02-05 18:00:00", -480), "5 Feb 24 10:00 EDT": ("2024-02-05 14:00:00", -240),
             "5 Feb 99 10:00:00 GMT": ("1999-02-05 10:00:00", 0), "Feb 5, 2024 10:00:00 +0530": ("2024-02-05 04:30:00", 330),
             "2024-02-05T10:00:00Z": ("2024-02-05 10:00:00", 0), "5 February 2024 10:00 -08:00": ("2024-02-05 18:00:00", -480),
             "Thu, 1 Feb 2024 10:00:00 -0500 (EST)": ("2024-02-01 15:00:00", -300), "nonsense": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    sent, off = SM.parse_date("d")
    got = {r.d: (r.s, r.o) for r in df.select("d", F.date_format(sent, "yyyy-MM-dd HH:mm:ss").alias("s"), off.alias("o")).collect()}
    assert got == cases


def test_absolute_deadlines(spark):
    cases = {"by Mar 5": "2024-03-05", "5 March": "2024-03-05", "3/5/2026": "2026-03-05", "5pm on March 5": "2024-03-05",
             "the 21st of December, 2025": "2025-12-21", "due 2025-01-31": "2025-01-31", "12/1/25": "2025-12-01"}
    df = spark.createDataFrame([(k,) for k in cases], "d string").withColumn("b", F.lit("2024-02-01 09:30:00").cast("timestamp"))
    got = {r.d: r.day for r in infer_columns(df, "d", "b", F.lit(0)).select("d", F.col("_dt.date_iso").alias("day")).collect()}
    assert got == cases


def test_unicode_words_in_signals(spark):
    from mailsift.functions import patterns as P
    df = spark.createDataFrame([("Hi Élodie, thanks",)], "t string")
    assert df.select(T.rx_find("t", P.PERSONAL_REPLY_RE, multiline=True).alias("f")).first().f


def _timed(df):
    df.selectExpr("1").collect()
    t = time.time()
    rows = df.collect()
    return rows, time.time() - t


LIMIT_S = 2.0  # seconds for one hostile row beside good ones


def test_fence_of_a_hostile_answer_is_linear(spark):
    from mailsift.functions.text import strip_fence
    cases = {"```json\n{\"a\": 1}\n```": '{"a": 1}', "``````": "", "```json```": "", "`````": "`````", "```": "```",
             " ```\n x \n``` ": "x", "```jsonx```": "x", "plain": "plain", "": "", "``` ``` ```": "```",
             "```" + " " * 1_000_000 + "x": "```" + " " * 1_000_000 + "x",
             "```" + " \n" * 500_000 + "x```": "x", "```json" + "`" * 1_000_000: "`" * (1_000_000 - 3)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", strip_fence("t").alias("s"))
    rows, took = _timed(df)
    assert {r["t"]: r["s"] for r in rows} == cases and took < LIMIT_S


def test_many_phrases_headers_and_evidence_are_linear(spark):
    from mailsift.functions.text import clean_evidence, extract_time_phrases
    from mailsift.sources.messages import HEADER_TYPE, header_map
    text = " ".join(f"within {i} hours" for i in range(100_000))
    rows, took = _timed(spark.createDataFrame([(text,), ("ASAP asap Today",)], "t string").select(
        extract_time_phrases("t").alias("p")))
    assert rows[0]["p"] == [f"within {i} hours" for i in range(10)] and rows[1]["p"] == ["ASAP", "Today"]
    assert took < LIMIT_S
    headers = [(f"H{i % 60_000}", str(i)) for i in range(100_000)]
    rows, took = _timed(spark.createDataFrame([(headers,), ([("B ", " x "), ("a", "1"), ("b", "y"), (" ", "z"), (None, "n")],)],
                                              f"h {HEADER_TYPE}").select(header_map("h").alias("m")))
    assert rows[0]["m"] == {f"h{i}": str(i) for i in range(60_000)} and rows[1]["m"] == {"b": "x", "a": "1"}
    assert took < LIMIT_S
    rows, took = _timed(spark.createDataFrame([([f"Point {i % 50_000}" for i in range(100_000)],), (["A  b", "a b", " ", "c"],)],
                                              "e array<string>").select(clean_evidence("e").alias("e")))
    assert rows[0]["e"] == ["Point 0", "Point 1", "Point 2"] and rows[1]["e"] == ["A  b".replace("  ", " "), "c"]
    assert took < LIMIT_S


def test_tree_depth_comes_from_the_parsed_message(spark):
    from pyspark.sql import functions as F

    from mailsift.sources.messages import flatten_parts, parse_raw, parts_levels
    escaped = '{"payload":{"mimeType":"a/b","\\u0070arts":[{"mimeType":"c/d","p\\u0061rts":[{"mimeType":"e/f"}]}]}}'
    wide = '{"mimeType":"c/d","parts":[{"mimeType":"e/f"}]}'
    flat = '{"payload":{"mimeType":"a/b","parts":[' + ",".join([wide] * 20_000) + "]}}"
    df = parse_raw(spark.createDataFrame([(escaped,), (flat,)], "value string"))
    rows, took = _timed(df.select(F.size(flatten_parts(F.col("raw"), parts_levels(F.col("raw")))).alias("n")))
    assert [r["n"] for r in rows] == [3, 40_001] and took < 3 * LIMIT_S


def test_quoted_attribute_values_do_not_end_a_tag(spark):
    cases = {'<a title="x>y">in</a>': "in", "<a title='x>y' b=\"c>d\">in</a>out": "in\nout", '<a title="x>y>in': 'y>in',
             "<p>it's</p><p>don't</p>": "it's\n\ndon't".replace("\n\n", "\n"), '<a b=">" c>x': "x", '<i = ">">x': "x",
             '<script a="</script>">bad</script>ok': "ok", '5 = "five" > 4': '5 = "five" > 4', "<a b=c'>x": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", T.html_to_text("h").alias("t"))
    assert {r["h"]: r["t"] for r in df.collect()} == cases
