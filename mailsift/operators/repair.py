"""Deterministic repair of model output (R1-R19), in the order the contract
applies them: clamp + key, spam override, evidence, urgency, reply_by, task,
actions, summary, sender, dates, meeting, debug. Every step is a projection
(struct rebuilds and higher-order array functions); nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.config import DEFAULT_CONFIG, TriageConfig
from mailsift.functions import patterns as P
from mailsift.functions.dates import infer_array, infer_columns
from mailsift.functions.text import blank, clean_evidence, normalize_key, py_strip, subject_topic


def _nb(c: Column) -> Column:
    """Non-blank (Python truthiness of a stripped string)."""
    return ~blank(c)


def clamp01(c) -> Column:
    """Clamp to [0, 1]; non-numeric -> 0."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.least(F.greatest(x.try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def spam_override(df: DataFrame) -> DataFrame:
    """R2: forced fields for spam, before every later step."""
    spam = F.col("major_category") == "spam"
    u = F.col("urgency_signals")
    urg = F.when(spam, F.struct(F.lit("low").alias("urgency"), F.lit(False).alias("deadline_detected"),
                                F.lit(None).cast("string").alias("deadline_text"),
                                F.lit(None).cast("string").alias("reply_by"),
                                F.lit(P.SPAM_REASON_MODEL).alias("reason"))).otherwise(u)
    return df.withColumns({
        "urgency_signals": urg,
        "explicit_task": F.when(spam, F.lit(False)).otherwise(F.col("explicit_task")),
        "suggested_reply_action": F.when(spam, F.array().cast("array<string>"))
                                   .otherwise(F.col("suggested_reply_action")),
        "task_proposal": F.when(spam, F.lit(None)).otherwise(F.col("task_proposal")),
    })


def normalize_urgency(u: Column) -> Column:
    """R3."""
    lvl = F.lower(py_strip(F.coalesce(F.nullif(u["urgency"], F.lit("")), F.lit("medium"))))
    return u.withField("reason", py_strip(F.coalesce(u["reason"], F.lit("")))) \
            .withField("urgency", F.when(lvl.isin(*P.URGENCY_LEVELS), lvl).otherwise(F.lit("medium")))


def base_time(run_ts: Column) -> Column:
    """Sent -> internal -> run time."""
    return F.coalesce(F.col("sent_at"), F.col("internal_date"), run_ts)


def base_offset() -> Column:
    """Offset (minutes) of the base time: the sender's when the sent time is
    used, else UTC."""
    return F.when(F.col("sent_at").isNotNull(), F.coalesce(F.col("sent_offset_min"), F.lit(0))).otherwise(F.lit(0))


def fill_reply_by(df: DataFrame, run_ts: Column) -> DataFrame:
    """reply_by from the deadline text when the text is set and reply_by
    is empty (``deadline_detected`` is not consulted)."""
    u = F.col("urgency_signals")
    df = infer_columns(df, u["deadline_text"], base_time(run_ts), base_offset(), "_rb")
    r = F.col("_rb")
    need = _nb(u["deadline_text"]) & blank(u["reply_by"])
    return df.withColumns({
        "urgency_signals": F.when(need & r["iso"].isNotNull(), u.withField("reply_by", r["iso"])).otherwise(u),
        "reply_by_bad_time": need & r["bad_time"],
        "reply_by_unparsed": need & r["unparsed"],
    }).drop("_rb")


def clean_task(task: Column, reply_by: Column) -> Column:
    """R5."""
    pr = F.lower(py_strip(F.coalesce(F.nullif(task["priority"], F.lit("")), F.lit("medium"))))
    return F.when(task.isNotNull(), F.struct(
        F.nullif(py_strip(F.coalesce(task["type"], F.lit(""))), F.lit("")).alias("type"),
        py_strip(F.coalesce(task["title"], F.lit(""))).alias("title"),
        py_strip(F.coalesce(task["description"], F.lit(""))).alias("description"),
        F.when(pr.isin(*P.URGENCY_LEVELS), pr).otherwise(F.lit("medium")).alias("priority"),
        F.lit("open").alias("status"),
        task["scheduled_for"].alias("scheduled_for"),
        F.when(blank(task["due_at"]) & _nb(reply_by), reply_by).otherwise(task["due_at"]).alias("due_at"),
        task["waiting_on"].alias("waiting_on")))


def rerank_actions(actions: Column) -> Column:
    """Kinds upper-cased into the domain, trims, stable sort by rank,
    ranks renumbered 1..n (no cap)."""
    norm = F.transform(actions, lambda a, i: F.struct(
        py_strip(F.coalesce(a["key"], F.lit(""))).alias("key"),
        py_strip(F.coalesce(a["label"], F.lit(""))).alias("label"),
        F.when(F.upper(F.coalesce(F.nullif(a["kind"], F.lit("")), F.lit("SECONDARY"))).isin(*P.ACTION_KINDS),
               F.upper(F.coalesce(F.nullif(a["kind"], F.lit("")), F.lit("SECONDARY"))))
         .otherwise(F.lit("SECONDARY")).alias("kind"),
        a["rank"].alias("rank"), i.alias("pos")))
    srt = F.array_sort(norm, lambda x, y: F.when(x["rank"] < y["rank"], -1).when(x["rank"] > y["rank"], 1)
                       .when(x["pos"] < y["pos"], -1).when(x["pos"] > y["pos"], 1).otherwise(0))
    return F.transform(srt, lambda a, i: F.struct(a["key"].alias("key"), a["label"].alias("label"),
                                                  a["kind"].alias("kind"), (i + 1).alias("rank")))


def clean_summary(s: Column) -> Column:
    """R7."""
    mi = F.filter(F.transform(F.coalesce(s["missing_info"], F.array().cast("array<string>")),
                              lambda x: py_strip(F.coalesce(x, F.lit("")))), lambda x: F.length(x) > 0)
    return F.struct(py_strip(F.coalesce(s["ask"], F.lit(""))).alias("ask"),
                    py_strip(F.coalesce(s["success_criteria"], F.lit(""))).alias("success_criteria"),
                    F.slice(mi, 1, 3).alias("missing_info"))


def fill_sender(people: Column, from_email: Column) -> Column:
    """The first person with the sender's address (any case) gets role
    ``sender`` when blank; otherwise the sender is put first."""
    fe = F.lower(from_email)
    idx = F.array_position(F.transform(people, lambda p: F.lower(F.coalesce(p["email"], F.lit("")))), fe)
    patched = F.transform(people, lambda p, i: F.when((i + 1 == idx) & blank(p["role"]),
                                                      p.withField("role", F.lit("sender"))).otherwise(p))
    added = F.concat(F.array(F.struct(from_email.alias("email"), F.lit("sender").alias("role"))), people)
    return (F.when(blank(from_email), people).when(idx > 0, patched).otherwise(added))


def fill_dates(dates: Column, run_ts: Column):
    """(dates with ISO filled, best ISO, best zone name). Given ISO
    values are kept; others are inferred (datetime when a time is present,
    else the date). Best = first given parseable ISO or first inferred value
    with a time."""
    inferred = infer_array(F.transform(dates, lambda d: d["text"]), base_time(run_ts), base_offset())
    filled = F.transform(F.arrays_zip(dates.alias("d"), inferred.alias("r")), lambda z: F.struct(
        F.struct(z["d"]["text"].alias("text"),
                 F.when(_nb(z["d"]["iso"]), z["d"]["iso"])
                  .when(z["r"]["iso"].isNotNull(), F.when(z["r"]["has_time"], z["r"]["iso"])
                        .otherwise(z["r"]["date_iso"])).alias("iso"),
                 z["d"]["type"].alias("type")).alias("d"),
        F.when(_nb(z["d"]["iso"]), F.when(F.try_to_timestamp(z["d"]["iso"]).isNotNull(), z["d"]["iso"]))
         .when(z["r"]["has_time"] & z["r"]["iso"].isNotNull(), z["r"]["iso"]).alias("best"),
        F.when(~_nb(z["d"]["iso"]), z["r"]["zone_name"]).alias("zone")))
    first = F.try_element_at(F.filter(filled, lambda x: x["best"].isNotNull()), F.lit(1))
    return F.transform(filled, lambda x: x["d"]), first["best"], first["zone"]


def fill_meeting(meeting: Column, category: Column, key: Column, subject: Column, best: Column,
                 zone: Column) -> Column:
    """For scheduling outputs create/complete the meeting."""
    wants = (category == "schedule_and_time") | F.upper(key).startswith("SCHEDULE_")
    m = F.coalesce(meeting, F.struct(F.lit(None).cast("string").alias("topic"),
                                     F.lit(None).cast("string").alias("start_at"),
                                     F.lit(None).cast("string").alias("tz")))
    filled = F.struct(
        F.when(blank(m["topic"]), subject_topic(subject)).otherwise(m["topic"]).alias("topic"),
        F.when(blank(m["start_at"]) & best.isNotNull(), best).otherwise(m["start_at"]).alias("start_at"),
        F.when(blank(m["tz"]) & zone.isNotNull(), zone).otherwise(m["tz"]).alias("tz"))
    return F.when(wants, filled).otherwise(meeting)


def repair(df: DataFrame, cfg: TriageConfig = DEFAULT_CONFIG, run_ts: Column | None = None) -> DataFrame:
    """R1-R16 over joined (message + parsed model) rows."""
    run_ts = run_ts if run_ts is not None else F.current_timestamp()
    df = df.withColumns({"confidence": clamp01("confidence"),
                         "sub_action_key": normalize_key("sub_action_key")})
    df = spam_override(df)
    df = df.withColumns({"evidence": clean_evidence("evidence"),
                         "urgency_signals": normalize_urgency(F.col("urgency_signals"))})
    df = fill_reply_by(df, run_ts)
    df = df.withColumns({
        "task_proposal": clean_task(F.col("task_proposal"), F.col("urgency_signals.reply_by")),
        "recommended_actions": rerank_actions(F.col("recommended_actions")),
        "extracted_summary": clean_summary(F.col("extracted_summary")),
    })
    dates, best, zone = fill_dates(F.col("entities.dates"), run_ts)
    ents = F.col("entities")
    df = df.withColumns({"_dates": dates, "_best": best, "_zone": zone})
    df = df.withColumn("entities", F.struct(
        fill_sender(ents["people"], F.col("from_email")).alias("people"),
        F.col("_dates").alias("dates"), ents["money"].alias("money"), ents["docs"].alias("docs"),
        fill_meeting(ents["meeting"], F.col("major_category"), F.col("sub_action_key"), F.col("subject"),
                     F.col("_best"), F.col("_zone")).alias("meeting")))
    return df.drop("_dates", "_best", "_zone")


def reply_required(urgency: Column, replies: Column) -> Column:
    """R17."""
    return urgency.isin("critical", "high") | (F.coalesce(F.size(replies), F.lit(0)) > 0)


def is_actionable(category: Column, explicit_task: Column, urgency: Column, replies: Column) -> Column:
    """Never for spam."""
    return (category != "spam") & (F.coalesce(explicit_task, F.lit(False)) | reply_required(urgency, replies))
