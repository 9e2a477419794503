"""The whole triage job: messages -> gate -> {gate spam insights | model
answers -> parse -> contract -> repair} -> insights + errors.

Plan notes: the gate is the only CPU-heavy step; its result is projected to
the narrow columns later steps need (bodies dropped) and written to the shared
folder, so the two branches share one gate pass. The only shuffle is the key join to the
model answers (sort-merge on message_id, or broadcast when AQE sees a small
side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.config import DEFAULT_CONFIG, TriageConfig, stored
from mailsift.functions.text import keep_rows
from mailsift.operators import gate as G
from mailsift.operators import model_io as M
from mailsift.operators import repair as R

INSIGHT_COLS = ["message_id", "thread_id", "provider", "major_category", "sub_action_key", "explicit_task",
                "confidence", "suggested_reply_action", "task_proposal", "recommended_actions", "urgency_signals",
                "extracted_summary", "entities", "evidence", "debug", "msg_provider", "msg_time", "position"]
MSG_COLS = ["provider", "message_id", "thread_id", "subject", "from_name", "from_email", "sent_at",
            "sent_offset_min", "internal_date", "position"]
GATE_COLS = ["score_h", "score", "verdict", "skip_llm", "sub_action_key", "fired", "gate_evidence"]


BODY_COLS = ["to", "cc", "snippet", "body_text", "body_html"]


def gate_stage(msgs: DataFrame, cfg: TriageConfig = DEFAULT_CONFIG, persist: bool = True,
               keep_bodies: bool = False) -> DataFrame:
    if "position" not in msgs.columns:
        msgs = msgs.withColumn("position", F.lit(None).cast("long"))
    keep = MSG_COLS + (BODY_COLS if keep_bodies else [])
    g = G.run_gate(msgs, cfg).select(*[c for c in keep if c in msgs.columns], *GATE_COLS)
    return stored(g, "gate") if persist else g


def model_stage(rest: DataFrame, answers, cfg: TriageConfig, run_ts: Column, persist: bool = True):
    """(repaired model rows, error rows) for the messages the gate passed.
    With ``persist`` the parsed and checked answers are written once.
    ``answers`` is a table of model answers, or a ``Scorer`` (U1) that is
    handed the JSON context (T11) of each message and returns answers."""
    if callable(answers):
        answers = answers(contexts(rest, cfg))
    # provider metadata is optional in an answers table
    for c, t in (("input_tokens", "bigint"), ("output_tokens", "bigint"), ("response_id", "string"),
                 ("provider", "string")):
        if c not in answers.columns:
            answers = answers.withColumn(c, F.lit(None).cast(t))
    rest = rest.withColumnRenamed("sub_action_key", "gate_sub_action_key").withColumnRenamed(
        "provider", "msg_provider")
    rows = M.checked(M.parse_model_text(M.joined(rest, answers))).withColumn("violations", F.when(
        F.col("raw_text").isNull(), F.array(F.lit("no_model_output"))).otherwise(F.col("violations"))).drop("raw_text")
    if persist:
        rows = stored(rows, "answers")
        valid, invalid = rows.filter(F.size("violations") == 0), rows.filter(F.size("violations") > 0)
    else:
        flagged = rows.withColumn("_ok", F.size("violations") == 0).withColumn("_bad", F.size("violations") > 0)
        valid, invalid = keep_rows(flagged, "_ok").drop("_ok", "_bad"), keep_rows(flagged, "_bad").drop("_ok", "_bad")
    repaired = R.repair(valid, cfg, run_ts)
    out = repaired.select(
        "message_id", "thread_id", F.coalesce(F.col("model_provider"), F.lit("model")).alias("provider"),
        "major_category", "sub_action_key", F.coalesce(F.col("explicit_task"), F.lit(False)).alias("explicit_task"),
        "confidence", "suggested_reply_action", "task_proposal", "recommended_actions", "urgency_signals",
        "extracted_summary", "entities", "evidence", G.debug_struct(cfg, run_ts).alias("debug"),
        "msg_provider", G.message_time().alias("msg_time"), "position",
        "input_tokens", "output_tokens", "response_id", "reply_by_bad_time", "reply_by_unparsed")
    failed = F.concat(F.lit("invalid_model_output: "), F.array_join("violations", "; "))
    errors = invalid.select("message_id", "msg_provider", "position", F.lit("model").alias("stage"), F.when(
        F.element_at("violations", 1) == "no_model_output", F.lit("no_model_output")).otherwise(
        F.substring(failed, 1, 500)).alias("error"))
    return out, errors


def contexts(rest: DataFrame, cfg: TriageConfig = DEFAULT_CONFIG) -> DataFrame:
    """T11 context per message for a scorer: (message_id, context)."""
    from mailsift.functions.context import context_signals, json_context
    need = ["to", "cc", "snippet", "body_text", "body_html"]
    base = rest
    for c in need:
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("array<string>" if c in ("to", "cc") else "string"))
    base = base.withColumn("body_text", F.coalesce("body_text", F.lit("")))
    return base.select("*", *context_signals(cfg)).select("message_id", json_context(cfg).alias("context"))


def finish(ins: DataFrame, run_ts: Column) -> DataFrame:
    """Derived flags and denormalized hot fields."""
    u = F.col("urgency_signals.urgency")
    return ins.withColumns({
        "reply_required": R.reply_required(u, F.col("suggested_reply_action")),
        "is_actionable": R.is_actionable(F.col("major_category"), F.col("explicit_task"), u,
                                         F.col("suggested_reply_action")),
        "task_type": F.col("task_proposal.type"),
        "reason": F.col("extracted_summary.ask"),
        "predicted_at": run_ts,
    })


def triage(msgs: DataFrame, answers, cfg: TriageConfig = DEFAULT_CONFIG,
           run_ts: Column | None = None, persist: bool = True):
    """Returns (insights, errors). Every input message ends in exactly one
    of them. ``answers``: a table of model answers or a scorer (U1); bodies
    are carried past the gate only for a scorer, which needs the context.
    With ``persist`` the narrow gate output is written to the shared folder
    once and both branches read it back."""
    run_ts = run_ts if run_ts is not None else F.current_timestamp()
    gated = gate_stage(msgs, cfg, persist, keep_bodies=callable(answers))
    caught, rest = G.route(gated)
    spam = G.spam_insights(caught, cfg, run_ts).select(
        *INSIGHT_COLS, F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"),
        F.lit(None).cast("string").alias("response_id"), F.lit(False).alias("reply_by_bad_time"),
        F.lit(False).alias("reply_by_unparsed"))
    model, errors = model_stage(rest, answers, cfg, run_ts, persist)
    insights = finish(spam.unionByName(model), run_ts)
    return insights, errors
