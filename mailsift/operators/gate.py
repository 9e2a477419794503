"""The weighted 16-signal gate (G1-G23) as Column expressions.

Plan shape: one projection materializes every signal flag and detail once,
a second builds the signal array, the integer score and the verdict. Both
are narrow, so the whole gate is a single map-only stage with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.config import DEFAULT_CONFIG, TriageConfig
from mailsift.functions import patterns as P
from mailsift.functions.text import keep_rows, py_strip, rx_find, rx_first

SIGNAL_NAMES = [n for n, _ in P.SIGNALS]
_PIXEL_IN_IMAGE = P.spark_re("^" + P.TRACKING_PIXEL_RE.removeprefix("<img"))


def _hdr(headers: Column, key: str) -> Column:
    """``headers.get(key, "")``."""
    return F.coalesce(F.try_element_at(headers, F.lit(key)), F.lit(""))


def _nonempty(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def signal_columns(headers="headers", from_email="from_email", from_name="from_name",
                   subject="subject", body_text="body_text", body_html="body_html",
                   found: dict[str, Column] | None = None) -> dict:
    """name -> (fired Column, detail Column), in evaluation order. ``found``:
    the first matches of G9-G11, if they are columns already."""
    found = found or first_matches(body_text)
    H = F.col(headers)
    fe, fn = F.col(from_email), F.col(from_name)
    text = F.coalesce(F.col(body_text), F.lit(""))
    html = F.col(body_html)
    out = {}
    # G1: header present (even if empty)
    lu = F.coalesce(F.map_contains_key(H, F.lit("list-unsubscribe")), F.lit(False))
    out["list_unsubscribe_header"] = (lu, F.when(lu, F.substring(_hdr(H, "list-unsubscribe"), 1, 100)).otherwise(""))
    # Detail set even when not fired
    prec = F.lower(_hdr(H, "precedence"))
    out["precedence_bulk"] = (prec.isin(*P.BULK_PRECEDENCE), prec)
    # G3
    auto = F.lower(_hdr(H, "auto-submitted"))
    out["auto_submitted"] = ((auto != "") & (auto != "no"), auto)
    # Whole local part, anchored at start
    for name, pat in (("noreply_sender", P.NOREPLY_RE), ("marketing_sender", P.MARKETING_SENDER_RE)):
        f = _nonempty(fe) & rx_find(fe, pat)
        out[name] = (f, F.when(f, fe).otherwise(""))
    # G6
    f = _nonempty(fn) & rx_find(fn, P.BULK_SENDER_NAME_RE)
    out["bulk_sender_name"] = (f, F.when(f, fn).otherwise(""))
    # G7
    rt = F.lower(py_strip(_hdr(H, "reply-to")))
    fl = F.lower(py_strip(F.coalesce(fe, F.lit(""))))
    f = (F.length(rt) > 0) & (F.length(fl) > 0) & (rt != fl) & (F.instr(rt, fl) == 0)
    out["reply_to_mismatch"] = (f, F.when(f, F.concat(F.lit("from="), fl, F.lit(" reply-to="), rt)).otherwise(""))
    # G8
    to_v = F.lower(py_strip(_hdr(H, "to")))
    f = (F.length(to_v) == 0) | to_v.contains("undisclosed")
    out["bcc_recipient"] = (f, F.when(f, F.substring(to_v, 1, 80)).otherwise(""))
    # Search the body; no pattern matches the empty string, so the
    # first match also tells the flag
    for name, cap in (("unsubscribe_body", None), ("view_in_browser", None), ("footer_pattern", 80)):
        hit = found[name]
        d = py_strip(hit)
        out[name] = (F.length(hit) > 0, F.substring(d, 1, cap) if cap else d)
    # Each image's own piece is searched from its start only
    images = F.split(F.coalesce(html, F.lit("")), "(?i)<img", -1)
    out["tracking_pixels"] = (F.exists(F.slice(images, 2, F.greatest(F.size(images) - 1, F.lit(0))),
                                       lambda p: p.rlike(_PIXEL_IN_IMAGE)), F.lit(""))
    # G13
    out["utm_params"] = (rx_find(F.concat(F.coalesce(html, F.lit("")), F.lit(" "), text), P.UTM_RE), F.lit(""))
    # Integer form of html/max(text,1) > 5
    tl, hl = F.length(py_strip(text)), F.length(py_strip(F.coalesce(html, F.lit(""))))
    f = _nonempty(html) & (hl > 500) & ((tl == 0) | (hl > F.greatest(tl, F.lit(1)) * 5))
    out["high_html_ratio"] = (f, F.when(f, F.format_string("text=%d html=%d", tl, hl)).otherwise(""))
    # G15
    subj = F.lower(F.coalesce(F.col(subject), F.lit("")))
    out["personal_reply"] = (subj.startswith("re:") & rx_find(F.substring(text, 1, 500), P.PERSONAL_REPLY_RE,
                                                               multiline=True), F.lit(""))
    # G16
    out["direct_questions"] = (rx_find(F.substring(text, 1, 1000), P.QUESTION_RE), F.lit(""))
    return out


def first_matches(body_text="body_text") -> dict[str, Column]:
    """First matches of the G9-G11 patterns in the body, or ''."""
    text = F.coalesce(F.col(body_text), F.lit(""))
    return {name: rx_first(text, pat) for name, pat in (
        ("unsubscribe_body", P.UNSUBSCRIBE_BODY_RE), ("view_in_browser", P.VIEW_IN_BROWSER_RE),
        ("footer_pattern", P.FOOTER_RE))}


def spam_sub_action(body_text="body_text", opt_out: Column | None = None) -> Column:
    """Newsletter words as plain substrings, else opt-out language
    (``opt_out`` if already known), else marketing."""
    low = F.lower(F.coalesce(F.col(body_text), F.lit("")))
    news = None
    for t in P.NEWSLETTER_TERMS:
        c = low.contains(t)
        news = c if news is None else (news | c)
    return (F.when(news, F.lit("SPAM_NEWSLETTER"))
             .when(opt_out if opt_out is not None else rx_find(F.col(body_text), P.UNSUBSCRIBE_BODY_RE),
                   F.lit("SPAM_UNSUBSCRIBE"))
             .otherwise(F.lit("SPAM_MARKETING")))


def run_gate(msgs: DataFrame, cfg: TriageConfig = DEFAULT_CONFIG) -> DataFrame:
    """G1-G21 on a normalized message frame. Adds ``signals`` (array of
    name/weight/fired/detail in evaluation order), ``score_h`` (hundredths,
    clamped to 0..100), ``score``, ``verdict``, ``skip_llm``,
    ``sub_action_key``, ``fired`` (names) and ``gate_evidence``."""
    matches = first_matches()
    sig = signal_columns(found={n: F.col(f"_m_{n}") for n in matches})
    base_cols = list(msgs.columns)
    stage1 = msgs.select(*base_cols, *[c.alias(f"_m_{n}") for n, c in matches.items()]).select(
        *base_cols, *[f.alias(f"_f_{n}") for n, (f, _) in sig.items()],
        *[d.alias(f"_d_{n}") for n, (_, d) in sig.items()])
    signals = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight_h"),
                                 F.col(f"_f_{n}").alias("fired"), F.col(f"_d_{n}").alias("detail"))
                        for n, w in P.SIGNALS])
    raw = sum(F.when(F.col(f"_f_{n}"), F.lit(w)).otherwise(F.lit(0)) for n, w in P.SIGNALS)
    score_h = F.least(F.greatest(raw, F.lit(0)), F.lit(100))
    stage2 = stage1.select(*base_cols, signals.alias("signals"), score_h.alias("score_h"),
                           F.col("_f_unsubscribe_body").alias("_opt_out"))
    verdict = (F.when(F.col("score_h") >= cfg.spam_threshold_h, F.lit("spam"))
                .when(F.col("score_h") <= cfg.not_spam_threshold_h, F.lit("not_spam"))
                .otherwise(F.lit("ambiguous")))
    fired = F.filter("signals", lambda s: s["fired"])
    out = stage2.select(
        *base_cols, "signals", "score_h",
        (F.col("score_h") / F.lit(100.0)).alias("score"),
        verdict.alias("verdict"),
        (F.col("score_h") >= cfg.spam_threshold_h).alias("skip_llm"),
        F.when(F.col("score_h") >= cfg.spam_threshold_h, spam_sub_action(opt_out=F.col("_opt_out")))
         .otherwise(F.lit("SPAM_MARKETING")).alias("sub_action_key"),
        F.transform(fired, lambda s: s["name"]).alias("fired"),
        gate_evidence(fired).alias("gate_evidence"))
    return out


def gate_evidence(fired: Column, limit: int = 3) -> Column:
    """First fired signals with a non-empty detail as ``[name] detail``."""
    with_detail = F.filter(fired, lambda s: F.length(s["detail"]) > 0)
    return F.slice(F.transform(with_detail, lambda s: F.concat(F.lit("["), s["name"], F.lit("] "), s["detail"])),
                   1, limit)


def signal_summary(signals: Column) -> Column:
    """Name -> fired map."""
    return F.map_from_entries(F.transform(signals, lambda s: F.struct(s["name"], s["fired"])))


def route(gated: DataFrame):
    """(caught, remaining). Caught rows end at the gate; the rest go on,
    ambiguous ones carrying their hints."""
    rest = gated.withColumn("_pass", ~F.col("skip_llm"))
    return keep_rows(gated, "skip_llm"), keep_rows(rest, "_pass").drop("_pass")


def spam_insights(caught: DataFrame, cfg: TriageConfig = DEFAULT_CONFIG, run_ts: Column | None = None) -> DataFrame:
    """Insight rows for gate-caught spam without the model. Texts, keys
    and labels are fixed values."""
    run_ts = run_ts if run_ts is not None else F.current_timestamp()
    subj = F.when(F.coalesce(F.length(F.col("subject")), F.lit(0)) > 0, F.col("subject")).otherwise("(no subject)")
    frm = F.when(F.coalesce(F.length(F.col("from_email")), F.lit(0)) > 0, F.col("from_email")).otherwise("unknown")
    rounded = F.round(F.col("score_h") / F.lit(100.0), 3)
    action = lambda k, lbl, kind, r: F.struct(F.lit(k).alias("key"), F.lit(lbl).alias("label"),
                                              F.lit(kind).alias("kind"), F.lit(r).alias("rank"))
    return caught.select(
        "message_id", "thread_id",
        F.lit("spam").alias("major_category"),
        F.col("sub_action_key"),
        F.lit(False).alias("explicit_task"),
        F.least(rounded + F.lit(0.1), F.lit(1.0)).alias("confidence"),
        F.array().cast("array<string>").alias("suggested_reply_action"),
        F.lit(None).cast(TASK_TYPE).alias("task_proposal"),
        F.array(action("archive", "Archive", "PRIMARY", 1),
                action("unsubscribe", "Unsubscribe", "SECONDARY", 2)).alias("recommended_actions"),
        F.struct(F.lit("low").alias("urgency"), F.lit(False).alias("deadline_detected"),
                 F.lit(None).cast("string").alias("deadline_text"), F.lit(None).cast("string").alias("reply_by"),
                 F.lit(P.SPAM_REASON_GATE).alias("reason")).alias("urgency_signals"),
        F.struct(F.concat(F.lit("Automated email from "), frm, F.lit(": "), subj).alias("ask"),
                 F.lit(P.SPAM_SUCCESS_CRITERIA).alias("success_criteria"),
                 F.array().cast("array<string>").alias("missing_info")).alias("extracted_summary"),
        empty_entities().alias("entities"),
        F.col("gate_evidence").alias("evidence"),
        debug_struct(cfg, run_ts).alias("debug"),
        F.lit("gate").alias("provider"),
        F.col("provider").alias("msg_provider"), message_time().alias("msg_time"),
        F.col("position") if "position" in caught.columns else F.lit(None).cast("long").alias("position"),
    )


def message_time() -> Column:
    return F.coalesce("sent_at", "internal_date")


def iso_utc(ts: Column) -> Column:
    """``isoformat()`` of an aware UTC datetime (fraction only when
    non-zero)."""
    frac = F.unix_micros(ts) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(F.lit("")),
                    F.lit("+00:00"))


def debug_struct(cfg: TriageConfig, run_ts: Column) -> Column:
    """Run time, versions and the gate summary."""
    return F.struct(
        iso_utc(run_ts).alias("analysis_timestamp"),
        F.lit(cfg.model_version).alias("model_version"),
        F.lit(cfg.prompt_version).alias("prompt_version"),
        F.struct(F.col("verdict").alias("verdict"), F.round(F.col("score_h") / F.lit(100.0), 3).alias("score"),
                 F.col("skip_llm").alias("skip_llm"), F.col("fired").alias("fired_signals")).alias("gate"))


TASK_TYPE = ("struct<type:string,title:string,description:string,priority:string,status:string,"
             "scheduled_for:string,due_at:string,waiting_on:string>")
ENTITIES_TYPE = ("struct<people:array<struct<email:string,role:string>>,"
                 "dates:array<struct<text:string,iso:string,type:string>>,"
                 "money:array<struct<text:string,amount:double,currency:string>>,"
                 "docs:array<struct<title:string,url:string,type:string>>,"
                 "meeting:struct<topic:string,start_at:string,tz:string>>")


def empty_entities() -> Column:
    return F.struct(
        F.array().cast("array<struct<email:string,role:string>>").alias("people"),
        F.array().cast("array<struct<text:string,iso:string,type:string>>").alias("dates"),
        F.array().cast("array<struct<text:string,amount:double,currency:string>>").alias("money"),
        F.array().cast("array<struct<title:string,url:string,type:string>>").alias("docs"),
        F.lit(None).cast("struct<topic:string,start_at:string,tz:string>").alias("meeting"))
