"""Raw message JSON: reader shapes, input contract, MIME flatten and the
normalized row."""

import base64
import json
import os
import tempfile

from pyspark.sql import functions as F

from mailsift.sources import messages as SM


def b64(s: str) -> str:
    return base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")


def msg(i, payload, headers=None, **top):
    p = dict(payload)
    p["headers"] = headers if headers is not None else [
        {"name": "From", "value": "Sam Doe <sam@example.com>"}, {"name": "To", "value": "a@x.com, B <b@x.com>"},
        {"name": "Subject", "value": " Hello "}, {"name": "Date", "value": "Mon, 29 Jan 2024 10:00:00 -0800 (PST)"}]
    m = {"id": f"m{i}", "threadId": "t1", "internalDate": "1706500000000", "snippet": " hi ", "payload": p}
    m.update(top)
    return m


def leaf(mt, text=None, **kw):
    body = {"size": 0}
    if text is not None:
        body = {"size": len(text), "data": b64(text)}
    return {"mimeType": mt, "body": body, **kw}


def node(mt, *parts):
    return {"mimeType": mt, "body": {"size": 0}, "parts": list(parts)}


def run(spark, objs, texts=None):
    rows = [(i, json.dumps(o)) for i, o in enumerate(objs)] + [(len(objs) + i, t) for i, t in enumerate(texts or [])]
    raw = SM.parse_raw(spark.createDataFrame(rows, "position long, value string"))
    good, bad = SM.validate_raw(raw)
    return {r.position: r for r in SM.normalize(good).collect()}, {r.position: list(r.violations) for r in bad.collect()}


def test_normalize_shapes(spark):
    objs = [
        msg(0, node("multipart/alternative", leaf("text/plain", "plain body\n"), leaf("text/html", "<p>h</p>"))),
        msg(1, node("multipart/alternative", leaf("text/plain", "   "), leaf("text/html", "<p>html only</p>"))),
        msg(2, node("multipart/mixed", node("multipart/related", node("multipart/alternative",
                                                                      leaf("TEXT/HTML", "<div>a</div><div>b</div>"))),
                    leaf("application/pdf", filename="x.pdf"))),
        msg(3, leaf("text/plain", "one\r\n"), headers=[{"name": "subject", "value": "first"},
                                                      {"name": " Subject ", "value": "second"},
                                                      {"name": "FROM", "value": '"Doe, Sam" <d@x.com>'}]),
    ]
    ok, bad = run(spark, objs)
    assert not bad
    assert ok[0].body_text == "plain body" and ok[0].body_html == "<p>h</p>"
    assert ok[0].subject == "Hello" and ok[0].from_name == "Sam Doe" and ok[0].to == ["a@x.com", "b@x.com"]
    assert ok[0].sent_offset_min == -480 and str(ok[0].sent_at) == "2024-01-29 18:00:00"
    assert ok[0].snippet == "hi"
    assert ok[1].body_text == "" and ok[1].body_html == "<p>html only</p>"   # blank plain part blocks fallback
    assert ok[2].body_text == "a\nb"                                          # html-only: text from html
    assert [list(p.path) for p in ok[2].parts] == [[], [0], [0, 0], [0, 0, 0], [1]]
    assert ok[3].subject == "first" and ok[3].from_name == "Doe, Sam" and ok[3].sent_at is None
    assert ok[3].body_text == "one"


def test_contract_reports_every_missing_path(spark):
    objs = [{"payload": {"headers": [{"name": "X"}]}}, {"id": "m1"},
            msg(2, node("multipart/mixed", {"body": {"size": 0}}))]
    _, bad = run(spark, objs, texts=['{"id": "m9", "payload": '])
    assert bad[0] == ["id: missing", "payload.mimeType: missing", "payload.headers[0].value: missing"]
    assert bad[1] == ["payload: missing"]
    assert bad[2] == ["payload.parts[0].mimeType: missing"]
    assert bad[3] == ["json: malformed"]


def test_decode_bad_input(spark):
    good = b64("héllo")
    df = spark.createDataFrame([(good,), (good[:3] + "!!\n" + good[3:],), ("@@@",), (None,),
                                (base64.urlsafe_b64encode(b"a\xffb").decode(),)], "d string")
    got = [r.t for r in df.select(SM.b64url_text("d").alias("t")).collect()]
    assert got == ["héllo", "héllo", "", "", "a�b"]


def test_reader_formats(spark):
    d = tempfile.mkdtemp(prefix="mailsift-read-")
    one = msg(0, leaf("text/plain", "x"))
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump([one, msg(1, leaf("text/plain", "y"))], f)
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump(msg(2, leaf("text/plain", "z")), f, indent=2)
    with open(os.path.join(d, "c.jsonl"), "w") as f:
        f.write(json.dumps(msg(3, leaf("text/plain", "w"))) + "\n\n" + json.dumps(msg(4, leaf("text/plain", "v"))))
    rows = SM.read_messages(spark, d, fmt="auto")
    ids = sorted(r.i for r in SM.parse_raw(rows).select(F.try_variant_get("raw", "$.id", "string").alias("i"))
                 .collect())
    assert ids == ["m0", "m1", "m2", "m3", "m4"]
    lines = SM.read_messages(spark, os.path.join(d, "c.jsonl"), fmt="jsonl")
    assert lines.count() == 2


def test_normalize_is_map_only(spark):
    """Parse, contract check, MIME flatten and normalize add no shuffle."""
    objs = [msg(0, node("multipart/alternative", leaf("text/plain", "x"), leaf("text/html", "<p>y</p>")))]
    raw = SM.parse_raw(spark.createDataFrame([(0, json.dumps(objs[0]))], "position long, value string"))
    good, bad = SM.validate_raw(raw)
    for df in (SM.normalize(good), bad):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_run_log_fallbacks(spark):
    from mailsift.operators.tables import run_log
    rows = [(0, json.dumps({"id": "m0", "threadId": "t0", "snippet": "  a \n  b ",
                            "payload": {"mimeType": "text/plain", "headers": [{"name": "SUBJECT", "value": " S "},
                                                                              {"name": " To ", "value": "x@y"}]}})),
            (1, json.dumps({"message_id": "alt", "thread_id": "t1", "snippet": "x" * 200})),
            (2, "{broken")]
    out = {r["index"]: r for r in run_log(SM.parse_raw(spark.createDataFrame(rows, "position long, value string")))
           .collect()}
    assert out[1].message_id == "m0" and out[1].subject == " S " and out[1].to == "(no to)"
    assert out[1].snippet == "a b" and out[1].total == 3 and out[1].date == "(no date)"
    assert out[2].message_id == "alt" and out[2].thread_id == "t1" and out[2].snippet == "x" * 180 + "…"
    assert out[3].message_id == "index_2" and out[3].subject == "(no subject)"


def test_full_address_grammar():
    from mailsift.sources.messages import mailboxes
    cases = {
        '"Doe, \\"Sam\\" (x)" <a@b.c>, bob@x.y (Bob (the) Builder)': [('Doe, "Sam" (x)', "a@b.c"), ("Bob the Builder", "bob@x.y")],
        "Ann (work) <ann@x>": [("Ann (work)", "ann@x")], "undisclosed-recipients:;": [], "": [], "(only)": [],
        'team: a@b, "C, D" <c@d>; late: e@f;, g@h': [("", "a@b"), ("C, D", "c@d"), ("", "e@f"), ("", "g@h")],
        '"odd one"@x': [("", '"odd one"@x')], "x@y (unclosed": [("unclosed", "x@y")], "a\\,b <c@d>": [("a,b", "c@d")],
        "<a@b": [("", "a@b")], '"never closed <a@b>': [("", "never closed <a@b>")], ",,;": []}
    for text, want in cases.items():
        assert mailboxes(text) == want, text


def test_hostile_addresses_are_linear():
    import time

    from mailsift.sources.messages import mailboxes
    for text in ("(" * 500_000, '"' * 500_000, "<" * 500_000, "a:" * 250_000, "\\" * 500_000, "(a" * 250_000 + ")" * 250_000):
        t = time.time()
        mailboxes(text)
        assert time.time() - t < 2


def test_every_message_is_written_and_read_back(spark, tmp_path, monkeypatch):
    """s01_read_messages: objects, arrays and lines together hold every message,
    malformed ones (55, 152) too."""
    from mailsift.plans import q_sources as Q
    monkeypatch.setattr(Q, "shared_dir", lambda spark, name: str(tmp_path / "out"))
    spark.range(160).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"),
                            F.lit("web").alias("source"), F.lit(9).cast("long").alias("n_chars")).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = Q.s01_read_messages(spark, str(tmp_path)).collect()
    want = [(None if k % 97 in (11, 55) else f"m{k}", k % 97 != 55) for k in range(160)]
    assert sorted(map(str, got)) == sorted(f"Row(message_id={m!r}, parsed={p})" for m, p in want)
    objects = [open(os.path.join(d, f)).read() for d, _, names in os.walk(tmp_path / "out" / "objects")
               for f in names if f.endswith(".txt")]
    assert len(objects) == 4 and all(x.startswith("{\n") for x in objects)


def test_a_bad_line_costs_no_other(spark, tmp_path):
    for name, text in {"a": '{"id": "a"}\nnot json\n{"id": "b"}\n', "b": '{bad\n{"id": "c"}\n',
                       "c": '{"id": "d",\n "x": [\n{"id": "e"},\n{"id": "f"}\n]}\n', "d": "{bad\n"}.items():
        (tmp_path / name).write_text(text)
    got = SM.parse_raw(SM.read_messages(spark, str(tmp_path), "auto"))
    ids = [(r.p, r.i) for r in got.select(F.col("position").alias("p"), F.try_variant_get("raw", "$.id", "string").alias("i")).collect()]
    assert sorted(ids) == [(0, "a"), (1, None), (2, "b"), (3, None), (4, "c"), (5, "d"), (6, None)]
