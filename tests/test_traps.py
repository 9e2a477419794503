"""Semantic traps that the matched behaviour has (kept on purpose)."""

from pyspark.sql import functions as F

from mailsift.functions import text as T
from mailsift.functions.dates import infer_columns
from mailsift.operators import gate as G
from mailsift.operators.repair import fill_meeting


def test_footer_street_needs_one_word_and_a_separator(spark):
    df = spark.createDataFrame([("12 Main Street, Springfield",), ("12 Main Street",), ("12 Old Main Street x",),
                                ("12 Main Streetwise",)], "body_text string")
    f, _ = G.signal_columns()["footer_pattern"]
    assert [r.f for r in df.select(f.alias("f")).collect()] == [True, False, False, False]


def test_links_from_html_keep_trailing_quote(spark):
    df = spark.createDataFrame([('<a href="https://x.example/a">go</a>',)], "h string")
    assert df.select(T.extract_links("h").alias("l")).first().l == ['https://x.example/a"']


def test_today_wins_over_weekday_and_french_et_is_a_zone(spark):
    df = spark.createDataFrame([("friday today", "2024-01-29 12:00:00"), ("lundi et mardi friday", "2024-01-29 12:00:00")],
                               "t string, b string").withColumn("b", F.col("b").cast("timestamp"))
    r = {x.t: x.r for x in infer_columns(df, F.col("t"), F.col("b"), F.lit(0), "r").collect()}
    assert r["friday today"].iso == "2024-01-29T00:00:00+00:00"
    assert r["lundi et mardi friday"].zone_name == "America/New_York"


def test_meeting_uses_normalized_key_prefix(spark):
    df = spark.createDataFrame([("other", "SCHEDULE_RSVP", "Re: Fwd: Sync"), ("other", "OTHER", "Re: x")],
                               "c string, k string, s string")
    m = fill_meeting(F.lit(None).cast("struct<topic:string,start_at:string,tz:string>"), F.col("c"), F.col("k"),
                     F.col("s"), F.lit("2024-02-01T10:00:00+00:00"), F.lit(None).cast("string"))
    got = [r.m for r in df.select(m.alias("m")).collect()]
    assert got[0].topic == "Sync" and got[0].start_at == "2024-02-01T10:00:00+00:00" and got[1] is None


def test_plain_text_is_only_trimmed(spark):
    from mailsift.sources.messages import best_bodies
    df = spark.createDataFrame([(["  a\n\n\n\nb  "], [])], "p array<string>, h array<string>")
    text, html = best_bodies("p", "h")
    r = df.select(text.alias("t"), html.alias("h")).first()
    assert r.t == "a\n\n\n\nb" and r.h is None


def test_json_context_keeps_sender_offset(spark):
    import json
    from mailsift.functions.context import context_signals, json_context
    df = spark.createDataFrame(
        [("gmail", "m1", "t1", "Hi", "Sam", "s@x.com", ["a@x.com"], [], "2024-01-29 18:00:00", -480, "", "body",
          None, "not_spam", 0, [])],
        "provider string, message_id string, thread_id string, subject string, from_name string, from_email string, "
        "to array<string>, cc array<string>, sent_at string, sent_offset_min int, snippet string, body_text string, "
        "body_html string, verdict string, score_h int, fired array<string>").withColumn(
        "sent_at", F.col("sent_at").cast("timestamp"))
    ctx = df.select("*", *context_signals()).select(json_context().alias("c")).first().c
    assert json.loads(ctx)["sentAt"] == "2024-01-29T10:00:00-08:00"
