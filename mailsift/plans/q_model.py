"""Model-ingest, repair and end-to-end triage queries (M1-M5, R1-R19,
T12, T14, T15) plus the insight-level analytics (Q2-Q6, Q8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions import text as T
from mailsift.functions.dates import infer_columns
from mailsift.operators import analytics as A
from mailsift.operators import model_io as M
from mailsift.operators import repair as R
from mailsift.plans import sqlgen as S
from mailsift.plans.fixtures import mail_view, model_output, table, with_mail
from mailsift.plans.triage import triage
from mailsift.plans.registry import ORACLES, messages, register, spread

RUN_TS = "2024-02-01 00:00:00"


def run_ts():
    return F.lit(RUN_TS).cast("timestamp")


def answers(spark, sf_dir):
    return model_output(mail_view(spread(table(spark, sf_dir, "documents"))))


def parsed(spark, sf_dir):
    return M.parse_model_text(answers(spark, sf_dir))


def triaged(spark, sf_dir):
    msgs = messages(spark, sf_dir).withColumn("position", F.col("doc_id"))
    return triage(msgs, answers(spark, sf_dir), run_ts=run_ts())


def model_rows(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return ins.filter(F.col("provider") == "model")


def _m(body: str) -> str:
    return with_mail(body, S.model_ctes())


# ----------------------------------------------------------------- T15, M1, M2
@register("t15_fence_strip", _m(f"select message_id, {S.fence_strip('raw_text')} as text from model_output"))
def t15_fence_strip(spark, sf_dir):
    return answers(spark, sf_dir).select("message_id", T.strip_fence("raw_text").alias("text"))


@register("m01_parse_model_text", _m(
    "select message_id, parse_ok, major_category, sub_action_key, explicit_task, confidence from parsed"))
def m01_parse_model_text(spark, sf_dir):
    return parsed(spark, sf_dir).select("message_id", "parse_ok", "major_category", "sub_action_key",
                                        "explicit_task", "confidence")


@register("m02_output_contract", _m(
    "select message_id, array_to_string(violations, '; ') as violations from viol where len(violations) > 0"))
def m02_output_contract(spark, sf_dir):
    _, bad = M.validate(parsed(spark, sf_dir))
    return bad.select("message_id", F.array_join("violations", "; ").alias("violations"))


@register("m03_attach_missing", _m(
    "select r.message_id, 'no_model_output' as error from rest r where r.message_id not in "
    "(select message_id from model_output)"))
def m03_attach_missing(spark, sf_dir):
    from mailsift.operators.gate import route
    from mailsift.plans.registry import gated
    _, rest = route(gated(spark, sf_dir))
    _, missing = M.attach(rest.select("message_id"), answers(spark, sf_dir))
    return missing


@register("m04_provider_usage", _m(
    "select provider, count(*) as n, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens from "
    "(select 'gate' as provider, 0::bigint as input_tokens, 0::bigint as output_tokens from gated where skip_llm "
    "union all select 'model', input_tokens, output_tokens from valid) group by provider"))
def m04_provider_usage(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return M.usage(ins)


def _all_insights_sql() -> str:
    return ("ins as (select message_id, thread_id, 'spam' as major_category, sub_action_key, false as explicit_task, "
            "'low' as urgency, 0 as n_replies from gated where skip_llm union all select message_id, thread_id, "
            "major_category, key_n, explicit_c, urgency_c, len(replies_c) from repaired)")


def _ins(body: str) -> str:
    return with_mail(body, S.model_ctes() + ", " + _all_insights_sql())


_DIMS = "(" + " union all ".join(
    f"select '{c}' as category, '{k}' as key" for c, keys in P.TAXONOMY for k in keys) + ")"


@register("m05_taxonomy_report", _ins(
    f"select i.major_category as category, i.sub_action_key as key, count(*) as n, "
    f"bool_or(d.key is not null) as in_taxonomy from ins i left join {_DIMS} d on d.category = i.major_category "
    f"and d.key = i.sub_action_key group by 1, 2"))
def m05_taxonomy_report(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return M.taxonomy_report(ins)


# --------------------------------------------------------------- T12, T14, R1
@register("t12_key_normalize", _m(f"select message_id, {S.key_norm('sub_action_key')} as key from parsed where parse_ok"))
def t12_key_normalize(spark, sf_dir):
    return parsed(spark, sf_dir).filter("parse_ok").select("message_id", T.normalize_key("sub_action_key").alias("key"))


@register("t14_evidence_clean", _m(
    f"select message_id, {S.join(S.evidence_clean('evidence'))} as evidence from parsed where parse_ok"))
def t14_evidence_clean(spark, sf_dir):
    return parsed(spark, sf_dir).filter("parse_ok").select(
        "message_id", F.array_join(T.clean_evidence("evidence"), "|").alias("evidence"))


@register("r01_clamp_confidence", _m(
    "select message_id, coalesce(least(greatest(confidence, 0.0), 1.0), 0.0) as confidence from parsed where parse_ok"))
def r01_clamp_confidence(spark, sf_dir):
    """R1 alone (before the contract, which rejects out-of-range values)."""
    return parsed(spark, sf_dir).filter("parse_ok").select("message_id", R.clamp01("confidence").alias("confidence"))


# ------------------------------------------------------------------ R2-R7
@register("r02_spam_override", _m(
    "select message_id, urgency_c as urgency, reason_c as reason, explicit_c as explicit_task, "
    "len(replies_c) as n_replies, task0 is null as no_task, reply_by_c is null as no_reply_by "
    "from repaired where is_spam"))
def r02_spam_override(spark, sf_dir):
    m = model_rows(spark, sf_dir).filter(F.col("major_category") == "spam")
    return m.select("message_id", F.col("urgency_signals.urgency").alias("urgency"),
                    F.col("urgency_signals.reason").alias("reason"), "explicit_task",
                    F.size("suggested_reply_action").alias("n_replies"),
                    F.col("task_proposal").isNull().alias("no_task"),
                    F.col("urgency_signals.reply_by").isNull().alias("no_reply_by"))


@register("r03_urgency", _m("select message_id, urgency_c as urgency, reason_c as reason from repaired"))
def r03_urgency(spark, sf_dir):
    return model_rows(spark, sf_dir).select("message_id", F.col("urgency_signals.urgency").alias("urgency"),
                                            F.col("urgency_signals.reason").alias("reason"))


@register("r04_reply_by", _m("select message_id, reply_by_c as reply_by from repaired"))
def r04_reply_by(spark, sf_dir):
    return model_rows(spark, sf_dir).select("message_id", F.col("urgency_signals.reply_by").alias("reply_by"))


def _task_sql() -> str:
    pr = f"lower({S.strip("coalesce(nullif(task0.priority, ''), 'medium')")})"
    return _m(
        f"select message_id, nullif({S.sc('task0.type')}, '') as type, "
        f"{S.sc('task0.title')} as title, "
        f"{S.sc('task0.description')} as description, "
        f"case when {pr} in ('low', 'medium', 'high', 'critical') then {pr} else 'medium' end as priority, "
        f"'open' as status, case when not {S.nb('task0.due_at')} and {S.nb('reply_by_c')} then reply_by_c "
        f"else task0.due_at end as due_at from repaired where task0 is not null")


@register("r05_task_clean", _task_sql())
def r05_task_clean(spark, sf_dir):
    t = F.col("task_proposal")
    return model_rows(spark, sf_dir).filter(t.isNotNull()).select(
        "message_id", t["type"].alias("type"), t["title"].alias("title"), t["description"].alias("description"),
        t["priority"].alias("priority"), t["status"].alias("status"), t["due_at"].alias("due_at"))


def _actions_sql() -> str:
    kind = "upper(coalesce(nullif(a.kind, ''), 'SECONDARY'))"
    return _m(
        "select message_id, coalesce(string_agg(k || ':' || l || ':' || kd || ':' || cast(rk as varchar), '|' "
        "order by rk), '') as actions from (select message_id, k, l, kd, row_number() over "
        "(partition by message_id order by rank, pos) as rk from (select message_id, "
        f"{S.sc('a.key')} as k, {S.sc('a.label')} as l, "
        f"case when {kind} in ('PRIMARY', 'SECONDARY', 'DANGER') then {kind} else 'SECONDARY' end as kd, "
        "coalesce(a.rank, 1) as rank, pos from (select message_id, unnest(recommended_actions) as a, "
        "generate_subscripts(recommended_actions, 1) as pos from repaired))) group by message_id "
        "union all select message_id, '' from repaired where len(recommended_actions) = 0")


@register("r06_rerank_actions", _actions_sql())
def r06_rerank_actions(spark, sf_dir):
    acts = F.transform("recommended_actions", lambda a: F.concat_ws(":", a["key"], a["label"], a["kind"],
                                                                    a["rank"].cast("string")))
    return model_rows(spark, sf_dir).select("message_id", F.array_join(acts, "|").alias("actions"))


@register("r07_summary_clean", _m(
    f"select message_id, {S.sc('s.ask')} as ask, "
    f"{S.sc('s.success_criteria')} as success_criteria, "
    f"array_to_string(list_filter(list_transform(coalesce(s.missing_info, []), lambda x: {S.sc('x')}), "
    "lambda x: length(x) > 0)[1:3], '|') as missing_info from repaired"))
def r07_summary_clean(spark, sf_dir):
    s = F.col("extracted_summary")
    return model_rows(spark, sf_dir).select("message_id", s["ask"].alias("ask"),
                                            s["success_criteria"].alias("success_criteria"),
                                            F.array_join(s["missing_info"], "|").alias("missing_info"))


# ------------------------------------------------------------------ R8-R11
def _deadline_sql() -> str:
    ctes, last = S.infer_ctes("mail", "deadline_text", "epoch_ms(internal_date_ms)", "rb")
    return with_mail(f"select message_id, rb_iso as iso, rb_date_iso as date_iso, rb_zone_name as zone_name, "
                     f"rb_has_time as has_time from {last} where deadline_text is not null", ctes)


@register("r09_relative_dates", _deadline_sql())
def r09_relative_dates(spark, sf_dir):
    """R8-R11 on every deadline phrase of the mail view, base = internal
    time (UTC)."""
    m = messages(spark, sf_dir).filter(F.col("deadline_text").isNotNull())
    d = infer_columns(m, F.col("deadline_text"), F.col("internal_date"), F.lit(0), "_d")
    return d.select("message_id", F.col("_d.iso").alias("iso"), F.col("_d.date_iso").alias("date_iso"),
                    F.col("_d.zone_name").alias("zone_name"), F.col("_d.has_time").alias("has_time"))


# --------------------------------------------------------------- R12, R17-R19
def _people_sql() -> str:
    idx = "list_position(list_transform(coalesce(e.people, []), lambda x: lower(coalesce(x.email, ''))), lower(from_email))"
    patched = (f"list_transform(coalesce(e.people, []), lambda x, i: case when i = {idx} and not {S.nb('x.role')} "
               "then {'email': x.email, 'role': 'sender'} else x end)")
    added = "list_concat([{'email': from_email, 'role': 'sender'}], coalesce(e.people, []))"
    ppl = f"case when not {S.nb('from_email')} then coalesce(e.people, []) when {idx} > 0 then {patched} else {added} end"
    return _m(f"select message_id, array_to_string(list_transform({ppl}, lambda x: x.email || ':' || x.role), '|') "
              "as people from repaired")


@register("r12_fill_sender", _people_sql())
def r12_fill_sender(spark, sf_dir):
    ppl = F.transform("entities.people", lambda p: F.concat_ws(":", p["email"], p["role"]))
    return model_rows(spark, sf_dir).select("message_id", F.array_join(ppl, "|").alias("people"))


@register("r17_r18_flags", _m(
    "select message_id, urgency_c in ('critical', 'high') or len(replies_c) > 0 as reply_required, "
    "major_category <> 'spam' and (coalesce(explicit_c, false) or urgency_c in ('critical', 'high') "
    "or len(replies_c) > 0) as is_actionable from repaired"))
def r17_r18_flags(spark, sf_dir):
    return model_rows(spark, sf_dir).select("message_id", "reply_required", "is_actionable")


@register("r19_denormalize", _m(
    f"select message_id, nullif({S.sc('task0.type')}, '') as task_type, "
    f"{S.sc('s.ask')} as reason, len(evidence_c) as n_evidence from repaired"))
def r19_denormalize(spark, sf_dir):
    return model_rows(spark, sf_dir).select("message_id", "task_type", "reason",
                                            F.size("evidence").alias("n_evidence"))


@register("r16_debug", _m(
    "select message_id, 'model-1' as model_version, 'prompt-1' as prompt_version, verdict, "
    "round(score_h / 100.0, 3) as score, fired_csv as fired, '2024-02-01T00:00:00+00:00' as analysis_timestamp "
    "from repaired"))
def r16_debug(spark, sf_dir):
    d = F.col("debug")
    return model_rows(spark, sf_dir).select(
        "message_id", d["model_version"].alias("model_version"), d["prompt_version"].alias("prompt_version"),
        d["gate"]["verdict"].alias("verdict"), d["gate"]["score"].alias("score"),
        F.array_join(d["gate"]["fired_signals"], ",").alias("fired"),
        d["analysis_timestamp"].alias("analysis_timestamp"))


# ---------------------------------------------------------------- end to end
@register("full_triage", _m(
    "select message_id, 'gate' as provider, 'spam' as major_category, sub_action_key, "
    "least(round(score_h / 100.0, 3) + 0.1, 1.0) as confidence, 'low' as urgency, cast(null as varchar) as reply_by, "
    "false as is_actionable from gated where skip_llm union all select message_id, 'model', major_category, key_n, "
    "conf_c, urgency_c, reply_by_c, major_category <> 'spam' and (coalesce(explicit_c, false) or urgency_c in "
    "('critical', 'high') or len(replies_c) > 0) from repaired"))
def full_triage(spark, sf_dir):
    """Flagship end to end: every message through gate, model ingest and
    repair; one insight row per message that is not an error."""
    ins, _ = triaged(spark, sf_dir)
    return ins.select("message_id", "provider", "major_category", "sub_action_key", "confidence",
                      F.col("urgency_signals.urgency").alias("urgency"),
                      F.col("urgency_signals.reply_by").alias("reply_by"), "is_actionable")


@register("triage_errors", _m(
    "select message_id, 'model' as stage, 'no_model_output' as error from rest where message_id not in "
    "(select message_id from model_output) union all select message_id, 'model', "
    "substr('invalid_model_output: ' || array_to_string(violations, '; '), 1, 500) from joined "
    "where len(violations) > 0"))
def triage_errors(spark, sf_dir):
    _, err = triaged(spark, sf_dir)
    return err.select("message_id", "stage", "error")


# ------------------------------------------------------------ Q3-Q6 on insights
@register("q03_category_distribution", _ins("select major_category as value, count(*) as n from ins group by 1"))
def q03_category_distribution(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return A.distribution(ins, "major_category")


@register("q04_sub_action_top20", _ins(
    "select value, n, rank, more from (select value, n, row_number() over (order by n desc, value) as rank, "
    "greatest(count(*) over () - 20, 0) as more from (select sub_action_key as value, count(*) as n from ins "
    "group by 1)) where rank <= 20"))
def q04_sub_action_top20(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return A.top_values(ins, "sub_action_key", 20)


@register("q05_batch_summary", _m(
    "select (select count(*) from mail) as total, (select count(*) from gated where skip_llm) + "
    "(select count(*) from repaired) as succeeded, (select count(*) from mail) - (select count(*) from gated "
    "where skip_llm) - (select count(*) from repaired) as failed"))
def q05_batch_summary(spark, sf_dir):
    ins, err = triaged(spark, sf_dir)
    results = ins.select(F.lit("success").alias("status")).unionByName(err.select(F.lit("error").alias("status")))
    return A.batch_summary(results)


@register("q06_inbox_actionable", _ins(
    "select i.message_id, i.thread_id, i.major_category from ins i join repaired r on r.message_id = i.message_id "
    "where r.major_category <> 'spam' and (coalesce(r.explicit_c, false) or r.urgency_c in ('critical', 'high') "
    "or len(r.replies_c) > 0)"))
def q06_inbox_actionable(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return ins.filter("is_actionable").select("message_id", "thread_id", "major_category")


@register("q06_inbox_reply_required", _ins(
    "select message_id, urgency from ins where urgency in ('critical', 'high') or n_replies > 0"))
def q06_inbox_reply_required(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return ins.filter("reply_required").select("message_id", F.col("urgency_signals.urgency").alias("urgency"))


@register("q06_inbox_by_category", _ins(
    "select major_category, sub_action_key, count(*) as n from ins group by 1, 2"))
def q06_inbox_by_category(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return ins.groupBy("major_category", "sub_action_key").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------- S4-S9, Q2, Q8 (tables)
from mailsift.config import DEFAULT_CONFIG, stored  # noqa: E402
from mailsift.operators import tables as TB  # noqa: E402


def _ins_rows(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return TB.insight_rows(ins, DEFAULT_CONFIG.contract)


@register("s04_upsert", _ins(
    "select message_id as email_message_id, '2024-0' || case when id % 5 <> 0 then '2-01' else '1-31' end || ' 00:00:00' "
    "as predicted_at, '2024-0' || case when id % 3 <> 0 then '1-31' else '2-01' end || ' 00:00:00' as created_at, "
    "case when id % 5 <> 0 then major_category else 'stored' end as major_category from (select *, "
    "cast(substr(message_id, 2) as bigint) as id from ins) where id % 15 <> 0"))
def s04_upsert(spark, sf_dir):
    """A stored version (an earlier run, without every third message)
    merged with this run's rows (without every fifth): replaced, inserted and
    kept rows; ``created_at`` of stored rows stays."""
    rows = stored(_ins_rows(spark, sf_dir), "s04")
    number = F.substring("email_message_id", 2, 20).cast("long")
    old = rows.filter(number % 3 != 0).withColumns({
        "predicted_at": F.lit("2024-01-31 00:00:00").cast("timestamp"), "major_category": F.lit("stored"),
        "created_at": F.lit("2024-01-31 00:00:00").cast("timestamp")})
    m = TB.upsert(old, rows.filter(number % 5 != 0))
    return m.select("email_message_id", F.date_format("predicted_at", "yyyy-MM-dd HH:mm:ss").alias("predicted_at"),
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "major_category")


@register("s05_status_update", _ins(
    "select m.message_id as provider_message_id, case when i.message_id is null then 'pending' else 'processed' "
    "end as processing_status, case when i.message_id is null then null when i.major_category = 'spam' then false "
    "else coalesce(i.explicit_task, false) or i.urgency in ('critical', 'high') or i.n_replies > 0 end "
    "as is_actionable from mail m left join ins i on i.message_id = m.message_id"))
def s05_status_update(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    store = TB.message_store(messages(spark, sf_dir).withColumn("position", F.col("doc_id")))
    s = TB.status_update(store, ins)
    return s.select("provider_message_id", "processing_status", "is_actionable")


def _tasks_sql() -> str:
    hint = f"coalesce(nullif({S.sc('task0.type')}, ''), 'task')"
    pr = f"lower({S.strip("coalesce(nullif(task0.priority, ''), 'medium')")})"
    return ("tk as (select thread_id as provider_thread_id, " + hint + " as task_id_hint, message_id, (internal_date_ms, message_id) as newest, "
            f"{S.sc('task0.title')} as title, "
            f"case when {pr} in ('low', 'medium', 'high', 'critical') then {pr} else 'medium' end as priority, "
            "'open' as status from repaired where task0 is not null), "
            "tasks as (select provider_thread_id, task_id_hint, arg_max(message_id, newest) as email_message_id, "
            "arg_max(title, newest) as title, arg_max(priority, newest) as priority, "
            "arg_max(status, newest) as status from tk group by 1, 2)")


def _tasks_q(body: str) -> str:
    return with_mail(body, S.model_ctes() + ", " + _all_insights_sql() + ", " + _tasks_sql())


@register("s06_tasks", _tasks_q("select * from tasks"))
def s06_tasks(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return TB.tasks(ins).select("provider_thread_id", "task_id_hint", "email_message_id", "title", "priority",
                                "status")


@register("q08_open_tasks", _tasks_q(
    "select provider_thread_id, status, count(*) as n from tasks where status = 'open' group by 1, 2"))
def q08_open_tasks(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    t = TB.tasks(ins)
    return t.filter(F.col("status") == "open").groupBy("provider_thread_id", "status").agg(
        F.count(F.lit(1)).alias("n"))


@register("q02_message_insight_task", _tasks_q(
    "select m.message_id, i.major_category, t.task_id_hint from mail m join ins i on i.message_id = m.message_id "
    "left join tasks t on t.provider_thread_id = m.thread_id"))
def q02_message_insight_task(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    t = TB.tasks(ins).select(F.col("provider_thread_id").alias("thread_id"), "task_id_hint")
    msgs = messages(spark, sf_dir).select("message_id", "thread_id")
    j = A.message_insight_task(msgs, ins.select("message_id", "major_category"), t)
    return j.select("message_id", "major_category", "task_id_hint")


@register("s07_item_results", _m(
    "select message_id, doc_id as \"index\", 'success' as status, true as has_output, cast(null as varchar) as error "
    "from mail where message_id in (select message_id from gated where skip_llm union all select message_id "
    "from repaired) union all select e.message_id, m.doc_id, 'error', false, e.error from (select message_id, "
    "'no_model_output' as error from rest where message_id not in (select message_id from model_output) union all "
    "select message_id, substr('invalid_model_output: ' || array_to_string(violations, '; '), 1, 500) from joined "
    "where len(violations) > 0) e join mail m on m.message_id = e.message_id"))
def s07_item_results(spark, sf_dir):
    ins, err = triaged(spark, sf_dir)
    r = TB.item_results(ins, err)
    return r.select("message_id", "index", "status", F.col("output").isNotNull().alias("has_output"), "error")


@register("s08_error_sink", _m(
    "select message_id as input_message_id, cast(null as integer) as status_code, 'no_model_output' as error "
    "from rest where message_id not in (select message_id from model_output) union all select message_id, null, "
    "substr('invalid_model_output: ' || array_to_string(violations, '; '), 1, 500) from joined "
    "where len(violations) > 0"))
def s08_error_sink(spark, sf_dir):
    ins, err = triaged(spark, sf_dir)
    _, bad = TB.split_results(TB.item_results(ins, err))
    return bad


@register("s09_output_contract", _ins("select message_id, '' as violations from ins"))
def s09_output_contract(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    return ins.select("message_id", F.array_join(TB.output_violations(), "; ").alias("violations"))


# ------------------------------------------------------------------ R13, R14, U1
def _dates_ctes() -> str:
    ctes, last = S.infer_ctes("dts", "dtext", "epoch_ms(internal_date_ms)", "dd")
    return ", ".join([
        "dts as (select message_id, internal_date_ms, d.text as dtext, d.iso as diso, pos from (select message_id, "
        "internal_date_ms, unnest(e.dates) as d, generate_subscripts(e.dates, 1) as pos from repaired))",
        ctes,
        f"dd7 as (select *, case when {S.nb('diso')} then diso when dd_iso is not null then (case when dd_has_time "
        f"then dd_iso else dd_date_iso end) end as iso_f, case when {S.nb('diso')} then (case when "
        f"try_cast(diso as timestamptz) is not null then diso end) when dd_has_time and dd_iso is not null then dd_iso "
        f"end as best, case when not {S.nb('diso')} then dd_zone_name end as zone from {last})",
        "dagg as (select message_id, string_agg(dtext || '=' || coalesce(iso_f, ''), '|' order by pos) as dates, "
        "arg_min(best, pos) filter (where best is not null) as best, arg_min(zone, pos) filter (where best is not null) "
        "as zone from dd7 group by message_id)",
    ])


def _dq(body: str) -> str:
    return with_mail(body, S.model_ctes() + ", " + _dates_ctes())


@register("r13_fill_dates", _dq(
    "select r.message_id, coalesce(a.dates, '') as dates from repaired r left join dagg a on a.message_id = r.message_id"))
def r13_fill_dates(spark, sf_dir):
    d = F.transform("entities.dates", lambda x: F.concat(x["text"], F.lit("="), F.coalesce(x["iso"], F.lit(""))))
    return model_rows(spark, sf_dir).select("message_id", F.array_join(d, "|").alias("dates"))


@register("r14_fill_meeting", _dq(
    f"select r.message_id, case when w then {S.subject_topic('subject')} end as topic, case when w then a.best end "
    "as start_at, case when w then a.zone end as tz from (select *, major_category = 'schedule_and_time' or "
    "starts_with(upper(key_n), 'SCHEDULE_') as w from repaired) r left join dagg a on a.message_id = r.message_id"))
def r14_fill_meeting(spark, sf_dir):
    m = F.col("entities.meeting")
    return model_rows(spark, sf_dir).select("message_id", m["topic"].alias("topic"), m["start_at"].alias("start_at"),
                                            m["tz"].alias("tz"))


@register("u01_replay_scorer", ORACLES["full_triage"])
def u01_replay_scorer(spark, sf_dir):
    """The same triage with the answers behind a scorer function that
    receives each message's JSON context (T11)."""
    ins, _ = triage(messages(spark, sf_dir), M.replay_scorer(answers(spark, sf_dir)), run_ts=run_ts(),
                    persist=False)
    return ins.select("message_id", "provider", "major_category", "sub_action_key", "confidence",
                      F.col("urgency_signals.urgency").alias("urgency"),
                      F.col("urgency_signals.reply_by").alias("reply_by"), "is_actionable")


# ------------------------------------------------------------ R8, R10, Q6 status
def _deadline_ctes():
    return S.infer_ctes("mail", "deadline_text", "epoch_ms(internal_date_ms)", "rb")


@register("r08_infer_zone", with_mail("select message_id, rb_zone as zone from {} where deadline_text is not null"
                                      .format(_deadline_ctes()[1]), _deadline_ctes()[0]))
def r08_infer_zone(spark, sf_dir):
    """Zone of each deadline phrase (word in table order, else the base
    offset's zone)."""
    from mailsift.functions.dates import zone_stage
    m = messages(spark, sf_dir).filter(F.col("deadline_text").isNotNull())
    return m.select("message_id", zone_stage(F.col("deadline_text"), F.col("internal_date"), F.lit(0))["zone"]
                    .alias("zone"))


@register("r10_time_of_day", with_mail(
    "select message_id, rb_hour as hour, rb_minute as minute, rb_bad as bad_time from {} "
    "where deadline_text is not null".format(_deadline_ctes()[1]), _deadline_ctes()[0]))
def r10_time_of_day(spark, sf_dir):
    """Hour and minute of each deadline phrase (noon, midnight, eod,
    12-hour, in-range 24-hour)."""
    from mailsift.functions.dates import time_of_day
    m = messages(spark, sf_dir).filter(F.col("deadline_text").isNotNull())
    h, mi, bad = time_of_day(F.col("deadline_text"))
    return m.select("message_id", h.alias("hour"), mi.alias("minute"), bad.alias("bad_time"))


@register("q06_inbox_by_status", _ins(
    "select case when i.message_id is null then 'pending' else 'processed' end as processing_status, count(*) as n "
    "from mail m left join ins i on i.message_id = m.message_id group by 1"))
def q06_inbox_by_status(spark, sf_dir):
    ins, _ = triaged(spark, sf_dir)
    store = TB.message_store(messages(spark, sf_dir).withColumn("position", F.col("doc_id")))
    return TB.status_update(store, ins).groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------- R11
_SINGLE_MONTH = ("make_date(case when doc_id % 5 = 4 then 2025 else 2024 end, cast(1 + doc_id % 12 as integer), "
                 "least(31, day(last_day(make_date(case when doc_id % 5 = 4 then 2025 else 2024 end, cast(1 + doc_id % 12 as integer), 1)))))")


@register("r11_single_fields",
          "select doc_id, strftime(case when doc_id % 5 in (0, 3) then make_date(2024, 1, cast(1 + doc_id % 28 as integer)) "
          f"when doc_id % 5 in (1, 4) then {_SINGLE_MONTH} else make_date(2024, 1, 31) end, '%Y-%m-%d') || 'T' || "
          "case when doc_id % 5 = 2 then cast(13 + doc_id % 11 as varchar) || ':30' when doc_id % 5 = 3 then '14:05' else '09:30' "
          "end || ':00+00:00' as iso from documents")
def r11_single_fields(spark, sf_dir):
    """Deadlines that name one field: a day of the month, a month (with a
    year), a time; the others come from the base time."""
    from mailsift.functions.dates import infer_columns
    d = F.col("doc_id")
    nth = F.concat(F.lit("the "), 1 + d % 28, F.lit("th"))
    month = F.date_format(F.make_date(F.lit(2024), (1 + d % 12).cast("int"), F.lit(1)), "MMMM")
    text = (F.when(d % 5 == 0, nth).when(d % 5 == 1, F.concat(F.lit("by "), month))
            .when(d % 5 == 2, F.concat(1 + d % 11, F.lit("pm"))).when(d % 5 == 3, F.concat(nth, F.lit(" at 14:05")))
            .otherwise(F.concat(month, F.lit(" 2025"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("phrase"), F.lit("2024-01-31 09:30:00").cast("timestamp").alias("base"))
    return infer_columns(docs, "phrase", "base", F.lit(0)).select("doc_id", F.col("_dt.iso").alias("iso"))


@register("r11_absolute_dates",
          "select doc_id, strftime(make_date(case doc_id % 6 when 2 then 2026 when 4 then 2025 when 5 then 2023 else 2024 "
          "end, cast(1 + doc_id % 12 as integer), cast(1 + doc_id % 28 as integer)), '%Y-%m-%d') as date_iso from documents")
def r11_absolute_dates(spark, sf_dir):
    """Deadlines that name a day (month names and abbreviations, day
    first, ordinals, slashes, ISO; the year of the base time if none)."""
    from mailsift.functions.dates import infer_columns
    d = F.col("doc_id")
    day, month = 1 + d % 28, 1 + d % 12
    name = F.date_format(F.make_date(F.lit(2024), month.cast("int"), F.lit(1)), "MMMM")
    text = F.lit("")
    forms = [F.concat(F.lit("by "), F.substring(name, 1, 3), F.lit(" "), day), F.concat(day, F.lit(" "), name),
             F.concat(month, F.lit("/"), day, F.lit("/2026")), F.concat(F.lit("5pm on "), name, F.lit(" "), day),
             F.concat(name, F.lit(" "), day, F.lit("th, 2025")),
             F.date_format(F.make_date(F.lit(2023), month.cast("int"), day.cast("int")), "yyyy-MM-dd")]
    for i, form in enumerate(forms):
        text = F.when(d % 6 == i, form).otherwise(text)
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("phrase"), F.lit("2024-02-01 09:30:00").cast("timestamp").alias("base"))
    return infer_columns(docs, "phrase", "base", F.lit(0)).select("doc_id", F.col("_dt.date_iso").alias("date_iso"))
