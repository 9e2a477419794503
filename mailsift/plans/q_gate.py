"""Gate queries G1-G23 and the flagship verdict mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.operators import gate as G
from mailsift.plans import sqlgen as S
from mailsift.plans.fixtures import with_mail
from mailsift.plans.registry import gated, register


def _gate_sql(body: str, extra: str = "") -> str:
    return with_mail(body, S.gate_ctes() + (", " + extra if extra else ""))


# --------------------------------------------------------- G1-G16: one signal each
def _signal_query(idx: int, name: str):
    def q(spark, sf_dir):
        g = gated(spark, sf_dir)
        s = F.col("signals")[idx]
        return g.select("message_id", s["fired"].alias("fired"), s["detail"].alias("detail"))
    q.__name__ = f"signal_{name}"
    return q


for _i, (_name, _w) in enumerate(P.SIGNALS):
    register(f"g{_i + 1:02d}_{_name}",
             _gate_sql(f"select message_id, f{_i} as fired, d{_i} as detail from gate"))(_signal_query(_i, _name))


@register("g17_score", _gate_sql("select message_id, score_h, score_h / 100.0 as score from gate"))
def g17_score(spark, sf_dir):
    return gated(spark, sf_dir).select("message_id", "score_h", "score")


@register("g18_verdict", _gate_sql("select message_id, verdict, skip_llm from gated"))
def g18_verdict(spark, sf_dir):
    return gated(spark, sf_dir).select("message_id", "verdict", "skip_llm")


@register("g19_fired_signals", _gate_sql(
    "select message_id, fired_csv as fired, length(fired_csv) - length(replace(fired_csv, ',', '')) "
    "+ case when fired_csv = '' then 0 else 1 end as n_fired from gate"))
def g19_fired_signals(spark, sf_dir):
    g = gated(spark, sf_dir)
    summary = G.signal_summary(F.col("signals"))
    return g.select("message_id", F.array_join("fired", ",").alias("fired"),
                    F.size(F.filter(F.map_values(summary), lambda v: v)).alias("n_fired"))


@register("g20_spam_sub_action", _gate_sql("select message_id, sub_action_key from gated where verdict = 'spam'"))
def g20_spam_sub_action(spark, sf_dir):
    return gated(spark, sf_dir).filter(F.col("verdict") == "spam").select("message_id", "sub_action_key")


@register("g21_gate_evidence", _gate_sql(f"select message_id, {S.join('gate_evidence')} as evidence from gate"))
def g21_gate_evidence(spark, sf_dir):
    return gated(spark, sf_dir).select("message_id", F.array_join("gate_evidence", "|").alias("evidence"))


@register("g22_spam_insights", _gate_sql(
    "select message_id, 'spam' as major_category, sub_action_key, false as explicit_task, "
    "least(round(score_h / 100.0, 3) + 0.1, 1.0) as confidence, "
    "'Automated email from ' || case when coalesce(length(from_email), 0) > 0 then from_email else 'unknown' end "
    "|| ': ' || case when coalesce(length(subject), 0) > 0 then subject else '(no subject)' end as ask, "
    f"{S.lit(P.SPAM_REASON_GATE)} as reason, 'low' as urgency, {S.join('gate_evidence')} as evidence, "
    "'archive|unsubscribe' as action_keys from gated where skip_llm"))
def g22_spam_insights(spark, sf_dir):
    caught, _ = G.route(gated(spark, sf_dir))
    ins = G.spam_insights(caught)
    return ins.select("message_id", "major_category", "sub_action_key", "explicit_task",
                      F.col("confidence"), F.col("extracted_summary.ask").alias("ask"),
                      F.col("urgency_signals.reason").alias("reason"),
                      F.col("urgency_signals.urgency").alias("urgency"),
                      F.array_join("evidence", "|").alias("evidence"),
                      F.array_join(F.transform("recommended_actions", lambda a: a["key"]), "|").alias("action_keys"))


@register("g23_route", _gate_sql(
    "select case when skip_llm then 'caught' when verdict = 'ambiguous' then 'model_with_hints' "
    "else 'model' end as branch, count(*) as n from gated group by 1"))
def g23_route(spark, sf_dir):
    caught, rest = G.route(gated(spark, sf_dir))
    both = caught.select(F.lit("caught").alias("branch")).unionByName(
        rest.select(F.when(F.col("verdict") == "ambiguous", F.lit("model_with_hints"))
                    .otherwise(F.lit("model")).alias("branch")))
    return both.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@register("gate_verdict_counts", _gate_sql(
    "select verdict, count(*) as n, sum(score_h) as score_h_sum from gated group by verdict"))
def gate_verdict_counts(spark, sf_dir):
    """Flagship: the whole gate over every message, then its verdict mix."""
    return (gated(spark, sf_dir).groupBy("verdict")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("score_h").alias("score_h_sum")))
