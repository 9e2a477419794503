"""Analytic operators against brute force, including a hot key holding a
third of the rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from mailsift.operators import analytics as A
from mailsift.operators import tables as TB


def _events(spark, n=900, seed=7):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        if i % 3 == 0:      # a third of all errors at one instant
            ts = t0 + dt.timedelta(seconds=5000)
        else:
            ts = t0 + dt.timedelta(seconds=rnd.randint(0, 20000), microseconds=rnd.randint(0, 999999))
        rows.append((i, ts))
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp")


def test_rolling_count_matches_brute_force(spark):
    rows, df = _events(spark)
    got = {r.event_id: r.n_window for r in A.rolling_count(df).collect()}
    for eid, t in rows:
        want = sum(1 for _, u in rows if t - dt.timedelta(seconds=300) < u <= t)
        assert got[eid] == want, eid


def test_health_threshold(spark):
    _, df = _events(spark, n=60)
    h = A.health(df, 300, 10).collect()
    assert all((r.status == "degraded") == (r.n_window >= 10) for r in h)


def test_latest_per_key_with_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 17}", i, f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v string")
    got = {r.k: (r.o, r.v) for r in TB.latest_per_key(df, ["k"], "o").collect()}
    want = {}
    for k, o, v in rows:
        if k not in want or o > want[k][0]:
            want[k] = (o, v)
    assert got == want


def test_top_values_and_distribution(spark):
    df = spark.createDataFrame([(f"k{i % 25}",) for i in range(1000)] + [("k0",)] * 5, "x string")
    top = A.top_values(df, "x", 20).orderBy("rank").collect()
    assert len(top) == 20 and top[0].value == "k0" and top[0].n == 45 and top[0].more == 5
    assert [r.rank for r in top] == list(range(1, 21))
    d = A.distribution(df, "x").collect()
    assert d[0].value == "k0" and sum(r.n for r in d) == 1005


def test_thread_context_keeps_last_five(spark):
    rows = [(1 if i < 40 else i, i, "user", f"text {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, order_key long, sender string, body_text string") \
        .withColumn("subject", F.lit(""))
    from mailsift.functions.context import thread_context
    got = {r.conv_id: r.thread_text for r in thread_context(df, thread="conv_id").collect()}
    assert got[1].count("From: user") == 5 and got[1].endswith("text 39")
    assert got[1].startswith("From: user | Subject: \ntext 35")
