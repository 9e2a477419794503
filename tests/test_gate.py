"""Gate signals, score and verdict (cases follow the behaviour of each
signal; one Spark job per table of cases)."""

import pytest
from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.operators import gate as G

COLS = "headers map<string,string>, from_email string, from_name string, subject string, body_text string, " \
       "body_html string"


def _msg(headers=None, from_email=None, from_name=None, subject="", body_text="", body_html=None):
    return (headers or {}, from_email, from_name, subject, body_text, body_html)


def _fired(spark, rows, name):
    df = spark.createDataFrame(rows, COLS)
    f, d = G.signal_columns()[name]
    return [(r.f, r.d) for r in df.select(f.alias("f"), d.alias("d")).collect()]


@pytest.mark.parametrize("name,rows,expected", [
    ("list_unsubscribe_header", [_msg({"list-unsubscribe": "<mailto:u@x.com>"}), _msg({"from": "a@b.c"}),
                                 _msg({"list-unsubscribe": ""})], [True, False, True]),
    ("precedence_bulk", [_msg({"precedence": "bulk"}), _msg({"precedence": "list"}), _msg({"precedence": "Junk"}),
                         _msg({"precedence": "normal"}), _msg({})], [True, True, True, False, False]),
    ("auto_submitted", [_msg({"auto-submitted": "auto-generated"}), _msg({"auto-submitted": "no"}), _msg({})],
     [True, False, False]),
    ("reply_to_mismatch", [_msg({"reply-to": "marketing@bigcorp.com"}, "noreply@bigcorp.com"),
                           _msg({"reply-to": "alice@example.com"}, "alice@example.com"),
                           _msg({"reply-to": "Alice <ALICE@example.com>"}, "alice@example.com")],
     [True, False, False]),
    ("bcc_recipient", [_msg({"to": ""}), _msg({"to": "undisclosed-recipients:;"}), _msg({"to": "user@example.com"}),
                       _msg({})], [True, True, False, True]),
])
def test_header_signals(spark, name, rows, expected):
    assert [f for f, _ in _fired(spark, rows, name)] == expected


NOREPLY = ["noreply@company.com", "no-reply@company.com", "no_reply@company.com", "do-not-reply@company.com",
           "mailer-daemon@company.com", "bounce@company.com", "notifications@company.com", "alert@company.com"]
MARKETING = ["marketing@company.com", "promotions@company.com", "newsletter@company.com", "offers@company.com",
             "info@company.com", "updates@company.com", "news@company.com", "digest@company.com"]


def test_sender_signals(spark):
    rows = [_msg(from_email=e) for e in NOREPLY + ["alice@company.com", "mynoreply@x.com"]]
    assert [f for f, _ in _fired(spark, rows, "noreply_sender")] == [True] * len(NOREPLY) + [False, False]
    rows = [_msg(from_email=e) for e in MARKETING + ["sarah@company.com"]]
    assert [f for f, _ in _fired(spark, rows, "marketing_sender")] == [True] * len(MARKETING) + [False]
    names = ["Company Newsletter", "Weekly Digest", "Daily Brief Updates", "Marketing Team", "Sarah Chen"]
    assert [f for f, _ in _fired(spark, [_msg(from_name=n) for n in names], "bulk_sender_name")] == \
        [True, True, True, True, False]


def test_body_signals(spark):
    unsub = ["Click here to unsubscribe from this list", "You can opt out at any time",
             "Manage your email preferences", "Update your preferences", "Change your preferences here",
             "Edit preferences for your account", "Stop receiving these emails",
             "Remove yourself from this mailing list", "You are receiving this because you subscribed",
             "Hi, can you confirm the meeting time for Friday?",
             "You are receiving this email because you signed up"]
    got = _fired(spark, [_msg(body_text=t) for t in unsub], "unsubscribe_body")
    # the last one: whitespace is bound to the "message" branch only
    assert [f for f, _ in got] == [True] * 9 + [False, False]
    assert got[0][1] == "unsubscribe"
    view = ["View in browser", "View this email in your browser", "View as web page",
            "Having trouble viewing this email?", "Can't see this email? View online version",
            "Email not displaying correctly?", "Please review the attached document."]
    assert [f for f, _ in _fired(spark, [_msg(body_text=t) for t in view], "view_in_browser")] == [True] * 6 + [False]
    foot = ["123 Main Street, Suite 100, San Francisco, CA", "© 2026 Acme Corp. All rights reserved.",
            "Copyright 2026 Company Inc", "You are receiving this email because you signed up for our newsletter",
            "Please send me the report by Friday."]
    assert [f for f, _ in _fired(spark, [_msg(body_text=t) for t in foot], "footer_pattern")] == [True] * 4 + [False]


def test_html_signals(spark):
    px = [_msg(body_html='<img src="https://t.example.com/o.gif" width="1" height="1" />'),
          _msg(body_html='<img src="https://example.com/logo.png" width="200" height="50" />'), _msg()]
    assert [f for f, _ in _fired(spark, px, "tracking_pixels")] == [True, False, False]
    utm = [_msg(body_text="https://example.com/sale?utm_source=email&utm_medium=newsletter"),
           _msg(body_text="Visit https://example.com/docs")]
    assert [f for f, _ in _fired(spark, utm, "utm_params")] == [True, False]
    ratio = [_msg(body_text="Short text", body_html="<html>" + "<div>" * 200 + "M" + "</div>" * 200 + "</html>"),
             _msg(body_text="This is a normal email with reasonable text content.",
                  body_html="<p>This is a normal email with reasonable text content.</p>")]
    got = _fired(spark, ratio, "high_html_ratio")
    assert [f for f, _ in got] == [True, False] and got[0][1].startswith("text=10 html=")


def test_negative_signals(spark):
    rows = [_msg(subject="Re: Contract review", body_text="Hi Sarah, thanks for the update. Let me know."),
            _msg(subject="Weekly Newsletter", body_text="Hi Sarah, check out our latest deals.")]
    assert [f for f, _ in _fired(spark, rows, "personal_reply")] == [True, False]
    rows = [_msg(body_text="Can you confirm the meeting for Friday at 2pm?"),
            _msg(body_text="50% off all items this weekend only!")]
    assert [f for f, _ in _fired(spark, rows, "direct_questions")] == [True, False]
    assert P.WEIGHTS["personal_reply"] < 0 and P.WEIGHTS["direct_questions"] < 0


def test_spam_sub_action(spark):
    texts = ["Your weekly newsletter is here", "Daily digest for Feb 20",
             "Big sale! Click here to unsubscribe if you no longer wish to receive.", "Amazing deals just for you!",
             "An expedition awaits"]
    df = spark.createDataFrame([(t,) for t in texts], "body_text string")
    got = [r.k for r in df.select(G.spam_sub_action().alias("k")).collect()]
    assert got == ["SPAM_NEWSLETTER", "SPAM_NEWSLETTER", "SPAM_UNSUBSCRIBE", "SPAM_MARKETING", "SPAM_NEWSLETTER"]


def test_score_and_verdict(spark):
    rows = [
        # list-unsubscribe + precedence + noreply + marketing... clamps to 100
        _msg({"list-unsubscribe": "<x>", "precedence": "bulk", "to": "a@b.c"}, "newsletter@x.com",
             "Weekly Digest", body_text="unsubscribe here. View in browser"),
        # 35+30+25+20-40 = 70 exactly: spam in integer hundredths (summed
        # left to right in binary floating point this is 0.6999...)
        _msg({"list-unsubscribe": "<x>", "precedence": "bulk", "to": "a@b.c"}, "noreply@x.com", None,
             "Re: hello", "Hi Bob, here it is. View in browser"),
        # 20 exactly: not_spam (inclusive)
        _msg({"to": "a@b.c"}, "info@x.com", None, "", "hello"),
        # 35: ambiguous
        _msg({"list-unsubscribe": "<x>", "to": "a@b.c"}, "a@x.com", None, "", "hello"),
        # negative sum clamps to 0
        _msg({"to": "a@b.c"}, "a@x.com", None, "Re: x", "Hi Bob, can you send it?"),
    ]
    g = G.run_gate(spark.createDataFrame(rows, COLS)).collect()
    assert [r.score_h for r in g] == [100, 70, 20, 35, 0]
    assert [r.verdict for r in g] == ["spam", "spam", "not_spam", "ambiguous", "not_spam"]
    assert [r.skip_llm for r in g] == [True, True, False, False, False]
    assert g[0].sub_action_key == "SPAM_UNSUBSCRIBE" and g[2].sub_action_key == "SPAM_MARKETING"
    assert [s.name for s in g[0].signals] == [n for n, _ in P.SIGNALS]
    assert len(g[0].gate_evidence) == 3 and g[0].gate_evidence[0].startswith("[list_unsubscribe_header]")


def test_gate_plan_is_map_only(spark):
    """The gate adds no shuffle and evaluates each regex once."""
    df = spark.createDataFrame([_msg(body_text="x")], COLS)
    plan = G.run_gate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
