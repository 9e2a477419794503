"""Text functions (cases follow the reference's preprocessing tests plus
the semantic traps listed in the survey)."""

from pyspark.sql import functions as F

from mailsift.functions import text as T


def _one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r.y for r in df.select(col(F.col("x")).alias("y")).collect()]


def test_html_to_text(spark):
    got = _one(spark, T.html_to_text, ["<html><body><p>Hello</p><p>World</p></body></html>",
                                       "<style>p{}</style><script>var a='<p>';</script><p>A &amp; B</p><!-- c -->"])
    assert got == ["Hello\nWorld", "A & B"]


def test_normalize_whitespace(spark):
    got = _one(spark, T.normalize_whitespace, ["a\r\nb\rc\t d\n\n\n\ne    f ", "x y"])
    assert got == ["a\nb\nc d\n\ne f", "x y"]


def test_links_money_time(spark):
    assert _one(spark, T.extract_links, ["See https://example.com and http://test.com/path and https://example.com"]) \
        == [["https://example.com", "http://test.com/path"]]
    money = _one(spark, T.extract_money, ["Invoice total is $1,234.56 due soon", "pay 50 USD or 20 dollars",
                                          "pay $1234.56 USD"])
    # an ungrouped amount stops after three digits; the rest matches the suffix form
    assert money == [["$1,234.56"], ["50 USD", "20 dollars"], ["$123", "4.56 USD"]]
    times = _one(spark, T.extract_time_phrases, ["Please send by Friday EOD, thanks. BY FRIDAY again, asap, tomorrow"])
    assert times == [["by Friday", "EOD", "asap", "tomorrow"]]
    many = " ".join(f"within {i} days" for i in range(15))
    assert len(_one(spark, T.extract_time_phrases, [many])[0]) == 10


def test_unsubscribe_flag(spark):
    pos = ["Click here to unsubscribe from this list", "subscribe to our newsletter", "change your preferences here",
           "Change preferences", "edit preferences for your account", "update subscription settings",
           "update preferences", "opt out of future emails", "opt-out", "manage preferences", "mailing list"]
    neg = ["Hi, can you confirm the meeting time?", "Please review the attached document.",
           "Invoice #1234 due by Friday", ""]
    assert _one(spark, T.has_unsubscribe, pos + neg) == [True] * len(pos) + [False] * len(neg)


def test_key_topic_fence(spark):
    assert _one(spark, T.normalize_key, [" schedule-confirm time! ", "", None, "__a__b__"]) == \
        ["SCHEDULE_CONFIRM_TIME", "OTHER", "OTHER", "A_B"]
    assert _one(spark, T.subject_topic, ["Re: Fwd: RE:  Budget", "fw:x", "Item"]) == ["Budget", "x", "Item"]
    assert _one(spark, T.strip_fence, ['```json\n{"a": 1}\n```', '  {"a": 2} ', "```\n[1]```"]) == \
        ['{"a": 1}', '{"a": 2}', "[1]"]


def test_evidence_and_cap(spark):
    got = _one(spark, T.clean_evidence, [["Please confirm", "please   confirm", " ", "Two", "Three", "Four"]],
               "array<string>")
    assert got == [["Please confirm", "Two", "Three"]]
    assert _one(spark, lambda c: T.cap_body(c, 5), ["abcdefgh", "abc"]) == ["abcde\n...[truncated]", "abc"]
    assert _one(spark, T.collapse_snippet, ["  a \n b  ", "x" * 200])[0] == "a b"
