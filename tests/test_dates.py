"""Deadline inference (R8-R11): zones, weekdays, DST, time of day."""

from pyspark.sql import functions as F

from mailsift.functions.dates import infer_columns


def _infer(spark, cases, offset=0):
    df = spark.createDataFrame(cases, "t string, b string").withColumn("b", F.col("b").cast("timestamp"))
    out = infer_columns(df, F.col("t"), F.col("b"), F.lit(offset), "r")
    return {r.t: (r.r.iso, r.r.zone_name, r.r.bad_time, r.r.has_time) for r in out.collect()}


def test_relative_days(spark):
    base = "2024-01-29 21:06:40"  # a Monday, UTC
    got = _infer(spark, [(t, base) for t in ["today", "tomorrow EOD", "Monday", "next Monday 14:30",
                                             "Friday 2pm PT", "Tuesday noon ET", "13:00 sunday utc",
                                             "this afternoon today", "asap", "13pm today", "  "]])
    assert got["today"][0] == "2024-01-29T00:00:00+00:00"
    assert got["tomorrow EOD"][0] == "2024-01-30T17:00:00+00:00"
    assert got["Monday"][0] == "2024-02-05T00:00:00+00:00"          # same weekday -> +7
    assert got["next Monday 14:30"][0] == "2024-02-12T14:30:00+00:00"
    assert got["Friday 2pm PT"][:2] == ("2024-02-02T14:00:00-08:00", "America/Los_Angeles")
    assert got["Tuesday noon ET"][:2] == ("2024-01-30T12:00:00-05:00", "America/New_York")
    assert got["13:00 sunday utc"][:2] == ("2024-02-04T13:00:00+00:00", "UTC")
    assert got["this afternoon today"][0] == "2024-01-29T12:00:00+00:00"  # "afternoon" contains "noon"
    assert got["asap"][0] is None
    assert got["13pm today"][0] is None and got["13pm today"][2] is True
    assert got["  "][0] is None


def test_dst_keeps_wall_clock(spark):
    got = _infer(spark, [("Friday 2pm PT", "2024-03-08 21:00:00")])
    assert got["Friday 2pm PT"][0] == "2024-03-15T14:00:00-07:00"


def test_zone_table_order_and_base_offset(spark):
    got = _infer(spark, [("monday et or pt", "2024-01-29 12:00:00")])
    assert got["monday et or pt"][1] == "America/Los_Angeles"       # first in table order, not in text
    got = _infer(spark, [("tomorrow", "2024-01-29 12:00:00")], offset=-360)
    assert got["tomorrow"][:2] == ("2024-01-30T00:00:00-06:00", "America/Chicago")
    got = _infer(spark, [("tomorrow", "2024-01-29 12:00:00")], offset=330)
    assert got["tomorrow"][:2] == ("2024-01-30T00:00:00+05:30", None)


def test_absolute_dates_take_base_fields(spark):
    got = _infer(spark, [("March 5 2pm", "2024-01-29 21:16:40"), ("2024-04-01", "2024-01-29 21:16:40")])
    assert got["March 5 2pm"][0] == "2024-03-05T14:16:40+00:00"
    assert got["2024-04-01"][0] == "2024-04-01T21:16:40+00:00"


def test_single_fields_take_the_rest_from_the_base(spark):
    base = "2024-01-31 21:16:40"
    got = _infer(spark, [(t, base) for t in ["the 5th", "March", "by Feb.", "June 2025", "5pm", "14:30", "the 31st 5pm", "Feb 31",
                                             "before the 40th", "asap", "EOD", "100th"]])
    assert got["the 5th"][0] == "2024-01-05T21:16:40+00:00" and got["March"][0] == "2024-03-31T21:16:40+00:00"
    assert got["by Feb."][0] == "2024-02-29T21:16:40+00:00" and got["June 2025"][0] == "2025-06-30T21:16:40+00:00"
    assert got["5pm"][0] == "2024-01-31T17:16:40+00:00" and got["14:30"][0] == "2024-01-31T14:30:40+00:00"
    assert got["the 31st 5pm"][0] == "2024-01-31T17:16:40+00:00"
    assert all(got[t][0] is None for t in ("Feb 31", "before the 40th", "asap", "EOD", "100th"))
