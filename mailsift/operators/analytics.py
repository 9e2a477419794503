"""Relational and analytic operators (Q1-Q12).

Aggregations rely on Spark's partial (map-side) aggregation so a hot key
ships one partial row per task; top-k uses ordered limits, which Spark plans
as per-partition top-k plus a merge; the health window avoids a global
unpartitioned window (see ``rolling_count``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions import patterns as P


# ------------------------------------------------------------------------ Q1
def lookup(ids: DataFrame, msgs: DataFrame, key: str = "message_id"):
    """Q1: (found, missing). Job ids are a small side; the planner broadcasts
    it only when its size estimate is under the broadcast threshold. The error
    text is a fixed value."""
    found = msgs.join(ids.select(key).distinct(), key, "left_semi")
    missing = (ids.select(key).distinct().join(msgs.select(key), key, "left_anti")
               .select(key, F.concat(F.lit("row not found for id="), F.col(key)).alias("error")))
    return found, missing


# ------------------------------------------------------------------------ Q2
def message_insight_task(msgs: DataFrame, insights: DataFrame, tasks: DataFrame) -> DataFrame:
    """Q2: key joins message -> insight (1:1) -> tasks (1:n on thread)."""
    return (msgs.join(insights, "message_id", "inner")
            .join(tasks, msgs["thread_id"] == tasks["thread_id"], "left")
            .drop(tasks["thread_id"]))


# --------------------------------------------------------------------- Q3, Q4
def distribution(df: DataFrame, col: str) -> DataFrame:
    """Q3: value counts ordered by count, ties by value."""
    return (df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")))


def top_values(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """Q4: top ``k`` values plus how many distinct values were left out."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # scalar subquery: one value, no join
    more = counts.select(F.greatest(F.count(F.lit(1)) - k, F.lit(0))).scalar()
    # ``orderBy().limit(k)`` becomes TakeOrderedAndProject: per-task top-k + merge.
    top = counts.orderBy(F.desc("n"), F.asc("value")).limit(k)
    w = Window.orderBy(F.desc("n"), F.asc("value"))  # over k rows only
    return top.withColumn("rank", F.row_number().over(w)).withColumn("more", more)


# ------------------------------------------------------------------------ Q5
def batch_summary(results: DataFrame, status: str = "status") -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(F.col(status) == "success").alias("succeeded"),
                       F.count_if(F.col(status) != "success").alias("failed"))


# ------------------------------------------------------------------------ Q7
def thread_groups(msgs: DataFrame, thread="thread_id", ts="internal_date", key="message_id") -> DataFrame:
    """Q7: one row per thread with size and latest message (partial
    aggregation: a hot thread costs one partial row per task)."""
    return msgs.groupBy(thread).agg(F.count(F.lit(1)).alias("n"),
                                    F.max_by(F.col(key), F.struct(F.col(ts).isNotNull(), F.col(ts), F.col(key))).alias("latest_id"),
                                    F.max(ts).alias("latest_at"))


# ------------------------------------------------------------------------ Q9
def rolling_count(events: DataFrame, ts: str = "ts", key: str = "event_id", seconds: int = 300) -> DataFrame:
    """For every event at time t: the number of events with t - seconds < ts
    <= t, without a global single-partition window.

    Events are collapsed to one row per distinct time with a count (partial
    aggregation: an instant holding a third of all events becomes one row).
    Time is cut into buckets as wide as the window, so t - seconds lies in the
    bucket before t's, and the answer needs these two only: events up to t in
    its own bucket, plus the earlier bucket's events after t - seconds. Both
    are running counts within a bucket. Each event then looks its time up; a
    hot instant there is a skewed equi-join that AQE splits."""
    width = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    at = events.select(micros.alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_c"))
    point = lambda t, own: F.struct((F.col("_t") - t).alias("m"), F.lit(own).alias("own"))
    points = at.select("_t", "_c", F.explode(F.array(point(0, True), point(width, False))).alias("p")).select(
        "_t", F.col("p.m").alias("_m"), F.col("p.own").alias("_own"),
        F.when(F.col("p.own"), F.col("_c")).otherwise(F.lit(0)).alias("_c"))
    bucket = Window.partitionBy((F.col("_m") - F.pmod(F.col("_m"), F.lit(width))).alias("_b"))
    upto = F.sum("_c").over(bucket.orderBy("_m").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = points.select("_t", F.when(F.col("_own"), upto).otherwise(F.sum("_c").over(bucket) - upto).alias("_n"))
    window = counted.groupBy("_t").agg(F.sum("_n").alias("n_window"))
    return events.withColumn("_t", micros).join(window, "_t").drop("_t")


def health(errors: DataFrame, seconds: int = 300, threshold: int = 10, ts: str = "ts",
           key: str = "event_id") -> DataFrame:
    """Q9 batch twin: at each error time, errors newer than ``seconds``;
    ``threshold`` or more -> degraded."""
    rc = rolling_count(errors, ts, key, seconds)
    return rc.withColumn("status", F.when(F.col("n_window") >= threshold, F.lit("degraded"))
                         .otherwise(F.lit("healthy")))


# ----------------------------------------------------------------------- Q10
def recent_errors(errors: DataFrame, keep: int = 50, show: int = 10, ts: str = "ts",
                  text: str = "error") -> DataFrame:
    """Q10: ring buffer of the last ``keep`` errors, newest ``show`` shown,
    text capped. Both limits are the feature (top-k), planned as per-task
    top-k plus merge."""
    kept = errors.orderBy(F.desc(ts), F.desc("event_id")).limit(keep)
    return (kept.orderBy(F.desc(ts), F.desc("event_id")).limit(show)
            .withColumn(text, F.substring(F.col(text), 1, P.ERROR_CHARS)))


# ----------------------------------------------------------------------- Q11
def request_counts(requests: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """Q11: per endpoint plus a ``total`` row (rollup)."""
    return (requests.rollup(endpoint).agg(F.count(F.lit(1)).alias("n"))
            .select(F.coalesce(F.col(endpoint), F.lit("total")).alias("endpoint"), "n"))


# ----------------------------------------------------------------------- Q12
def gate_effectiveness(gated: DataFrame, bin_h: int = 10) -> DataFrame:
    """Q12: share skipped, per-signal fire counts, score histogram and
    verdict mix as (metric, value) rows, in one scan: each message emits its
    metric keys, then one partial aggregation counts them."""
    m = lambda name, v: F.struct(name.alias("metric"), v.cast("double").alias("v"))
    keys = F.concat(
        F.array(m(F.lit("skip_share"), F.col("skip_llm").cast("int")),
                m(F.concat(F.lit("score_bin:"), F.lpad((F.floor(F.col("score_h") / bin_h) * bin_h)
                                                       .cast("string"), 3, "0")), F.lit(1)),
                m(F.concat(F.lit("verdict:"), F.col("verdict")), F.lit(1))),
        F.transform("fired", lambda s: m(F.concat(F.lit("fired:"), s), F.lit(1))))
    agg = (gated.select(F.explode(keys).alias("k")).groupBy(F.col("k.metric").alias("metric"))
           .agg(F.sum("k.v").alias("s"), F.count(F.lit(1)).alias("c")))
    return agg.select("metric", F.when(F.col("metric") == "skip_share", F.col("s") / F.col("c"))
                      .otherwise(F.col("c").cast("double")).alias("value"))
