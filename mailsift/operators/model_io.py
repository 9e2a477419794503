"""Model-output ingest (M1-M5) and the scorer surface.

The network call itself is not built: model answers arrive as data, one row
per message (``message_id, raw_text`` plus provider metadata). Parsing uses
``try_parse_json`` into a VARIANT and typed ``try_variant_get`` per field, so
one bad row never fails the job; contract checks produce a violations array
(every failure is listed, not just the first)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions.text import keep_rows, py_strip, strip_fence
from mailsift.operators.gate import ENTITIES_TYPE, TASK_TYPE
from mailsift.operators.tables import latest_per_key

ACTION_TYPE = "array<struct<key:string,label:string,kind:string,rank:int>>"
URGENCY_TYPE = "struct<urgency:string,deadline_detected:boolean,deadline_text:string,reply_by:string,reason:string>"
SUMMARY_TYPE = "struct<ask:string,success_criteria:string,missing_info:array<string>>"

# A scorer maps (message_id, context) rows to (message_id, raw_text, ...)
# rows; the shipped one replays a table of stored answers (M3).
Scorer = Callable[[DataFrame], DataFrame]


def replay_scorer(answers: DataFrame) -> Scorer:
    """Scorer backed by a table of stored model answers, joined on the
    message key (a missing answer surfaces later as ``no_model_output``)."""
    def score(contexts: DataFrame) -> DataFrame:
        return contexts.select("message_id").join(answers, "message_id", "inner")
    return score


def _get(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, "$." + path, typ)


# Types of the output contract: a trailing ``?`` allows null; a field may be
# absent unless listed in REQUIRED_ITEMS. Numbers and booleans may come as text.
FIELD_TYPES = {
    "sub_action_key": "string", "major_category": "string", "explicit_task": "boolean", "confidence": "number",
    "suggested_reply_action": "array", "task_proposal": "object?", "recommended_actions": "array",
    "urgency_signals": "object", "extracted_summary": "object", "entities": "object", "evidence": "array",
    "task_proposal.type": "string?", "task_proposal.title": "string", "task_proposal.description": "string",
    "task_proposal.priority": "string", "task_proposal.status": "string", "task_proposal.scheduled_for": "string?",
    "task_proposal.due_at": "string?", "task_proposal.waiting_on": "string?",
    "urgency_signals.urgency": "string", "urgency_signals.deadline_detected": "boolean",
    "urgency_signals.deadline_text": "string?", "urgency_signals.reply_by": "string?", "urgency_signals.reason": "string",
    "extracted_summary.ask": "string", "extracted_summary.success_criteria": "string",
    "extracted_summary.missing_info": "array", "entities.people": "array", "entities.dates": "array",
    "entities.money": "array", "entities.docs": "array", "entities.meeting": "object?",
    "entities.meeting.topic": "string?", "entities.meeting.start_at": "string?", "entities.meeting.tz": "string?",
}
ITEM_TYPES = {  # arrays: their items' type, or their items' fields
    "suggested_reply_action": "string", "evidence": "string", "extracted_summary.missing_info": "string",
    "recommended_actions": {"key": "string", "label": "string", "kind": "string", "rank": "integer"},
    "entities.people": {"email": "string", "role": "string"},
    "entities.dates": {"text": "string", "iso": "string?", "type": "string"},
    "entities.money": {"text": "string", "amount": "number?", "currency": "string?"},
    "entities.docs": {"title": "string?", "url": "string?", "type": "string?"},
}
REQUIRED_ITEMS = {"entities.money": ["text"]}  # those of actions, people and dates have rules of their own


def _wrong(v: Column, want: str) -> Column:
    """Is the variant there, but not of the wanted type?"""
    kind = F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0), F.lit("MISSING"))
    want, null_ok = want.rstrip("?"), want.endswith("?")
    number = kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    text = F.lower(py_strip(F.try_variant_get(v, "$", "string")))
    ok = {"string": kind == "STRING", "array": kind == "ARRAY", "object": kind == "OBJECT",
          "number": number | (kind == "STRING") & text.try_cast("double").isNotNull(),
          "integer": (number | (kind == "STRING")) & (text.try_cast("double") == F.floor(text.try_cast("double"))),
          "boolean": (kind == "BOOLEAN") | (number | (kind == "STRING")) & text.isin(
              "true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")}[want]
    return ~F.coalesce(ok, F.lit(False)) & (kind != "MISSING") & ((kind != "VOID") if null_ok else F.lit(True))


def _with(fn, *more):
    return lambda x, i: fn(x, i, *more)


def type_violations(v: Column) -> Column:
    """M2: ``path: not <type>`` for every value of a wrong type, items included."""
    field = lambda root, path: F.try_variant_get(root, "$." + path, "variant")
    say = lambda path, want: path + ": not " + ("an " if want[0] in "aeiou" else "a ") + want.rstrip("?")
    out = [F.array(*[F.when(_wrong(field(v, p), w), F.lit(say(p, w))) for p, w in FIELD_TYPES.items()])]
    for path, want in ITEM_TYPES.items():
        items = F.coalesce(F.try_variant_get(v, "$." + path, "array<variant>"), F.array().cast("array<variant>"))

        def item_rules(x, i, path, want):
            here = F.concat(F.lit(path), F.format_string("[%d]", i))
            if isinstance(want, str):
                return F.array(F.when(_wrong(x, want), F.concat(here, F.lit(say("", want)))))
            return F.array(F.when(_wrong(x, "object"), F.concat(here, F.lit(": not an object"))), *[
                F.when(_wrong(field(x, c), w), F.concat(here, F.lit(say("." + c, w)))) for c, w in want.items()], *[
                F.when(field(x, c).isNull(), F.concat(here, F.lit(f".{c}: missing"))) for c in REQUIRED_ITEMS.get(path, [])])
        out.append(F.flatten(F.transform(items, _with(item_rules, path, want))))
    return F.filter(F.concat(*out), lambda m: m.isNotNull())


def parse_model_text(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """M1: fence strip (T15), JSON parse, typed fields with the contract's
    defaults. Adds ``parse_ok`` and one column per output field."""
    v = F.try_parse_json(strip_fence(F.col(text)))
    base = df.withColumn("_v", v)
    vv = F.col("_v")
    urg = _get(vv, "urgency_signals", URGENCY_TYPE)
    summ = _get(vv, "extracted_summary", SUMMARY_TYPE)
    tp = _get(vv, "task_proposal", TASK_TYPE)
    ents = _get(vv, "entities", ENTITIES_TYPE)
    acts = _get(vv, "recommended_actions", ACTION_TYPE)
    empty = lambda t: F.array().cast(t)
    return base.select(
        *[c for c in df.columns],
        (vv.isNotNull() & (F.schema_of_variant(vv).startswith("OBJECT"))).alias("parse_ok"),
        _get(vv, "major_category", "string").alias("major_category"),
        _get(vv, "sub_action_key", "string").alias("sub_action_key"),
        _get(vv, "explicit_task", "boolean").alias("explicit_task"),
        _get(vv, "confidence", "double").alias("confidence"),
        F.coalesce(_get(vv, "suggested_reply_action", "array<string>"), empty("array<string>"))
         .alias("suggested_reply_action"),
        F.when(tp.isNotNull(), F.struct(
            tp["type"].alias("type"), F.coalesce(tp["title"], F.lit("")).alias("title"),
            F.coalesce(tp["description"], F.lit("")).alias("description"),
            F.coalesce(tp["priority"], F.lit("medium")).alias("priority"),
            F.coalesce(tp["status"], F.lit("open")).alias("status"),
            tp["scheduled_for"].alias("scheduled_for"), tp["due_at"].alias("due_at"),
            tp["waiting_on"].alias("waiting_on"))).alias("task_proposal"),
        F.transform(F.coalesce(acts, empty(ACTION_TYPE)), lambda a: F.struct(
            a["key"].alias("key"), a["label"].alias("label"),
            F.coalesce(a["kind"], F.lit("SECONDARY")).alias("kind"),
            F.coalesce(a["rank"], F.lit(1)).alias("rank"))).alias("recommended_actions"),
        F.struct(F.coalesce(urg["urgency"], F.lit("medium")).alias("urgency"),
                 F.coalesce(urg["deadline_detected"], F.lit(False)).alias("deadline_detected"),
                 urg["deadline_text"].alias("deadline_text"), urg["reply_by"].alias("reply_by"),
                 F.coalesce(urg["reason"], F.lit("")).alias("reason")).alias("urgency_signals"),
        F.struct(F.coalesce(summ["ask"], F.lit("")).alias("ask"),
                 F.coalesce(summ["success_criteria"], F.lit("")).alias("success_criteria"),
                 F.coalesce(summ["missing_info"], empty("array<string>")).alias("missing_info"))
         .alias("extracted_summary"),
        F.struct(F.coalesce(ents["people"], empty("array<struct<email:string,role:string>>")).alias("people"),
                 F.transform(F.coalesce(ents["dates"], empty("array<struct<text:string,iso:string,type:string>>")),
                             lambda d: F.struct(d["text"].alias("text"), d["iso"].alias("iso"),
                                                F.coalesce(d["type"], F.lit("other")).alias("type"))).alias("dates"),
                 F.coalesce(ents["money"], empty("array<struct<text:string,amount:double,currency:string>>"))
                  .alias("money"),
                 F.coalesce(ents["docs"], empty("array<struct<title:string,url:string,type:string>>")).alias("docs"),
                 ents["meeting"].alias("meeting")).alias("entities"),
        F.coalesce(_get(vv, "evidence", "array<string>"), empty("array<string>")).alias("evidence"),
        F.when(vv.isNotNull() & F.schema_of_variant(vv).startswith("OBJECT"), type_violations(vv)).alias("type_violations"),
    )


def contract_violations() -> Column:
    """M2: every failed rule of the output contract, in a fixed order."""
    cat, conf = F.col("major_category"), F.col("confidence")
    rules = [
        (~F.col("parse_ok"), "invalid_json"),
        (F.col("parse_ok") & cat.isNull(), "major_category: missing"),
        (cat.isNotNull() & ~cat.isin(*P.CATEGORIES), "major_category: not in domain"),
        (F.col("parse_ok") & F.col("sub_action_key").isNull(), "sub_action_key: missing"),
        (F.col("parse_ok") & F.col("explicit_task").isNull(), "explicit_task: missing"),
        (F.col("parse_ok") & conf.isNull(), "confidence: missing"),
        (conf.isNotNull() & ((conf < 0) | (conf > 1)), "confidence: out of range"),
        (F.exists("recommended_actions", lambda a: a["key"].isNull() | a["label"].isNull()),
         "recommended_actions: key/label missing"),
        (F.exists("entities.people", lambda p: p["email"].isNull() | p["role"].isNull()),
         "entities.people: email/role missing"),
        (F.exists("entities.dates", lambda d: d["text"].isNull()), "entities.dates: text missing"),
    ]
    return F.concat(F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in rules]), lambda x: x.isNotNull()),
                    F.coalesce("type_violations", F.array().cast("array<string>")))


def checked(parsed: DataFrame) -> DataFrame:
    """M2: the parsed rows with their ``violations`` (none: the row is valid)."""
    return parsed.withColumn("violations", contract_violations()).drop("type_violations")


def validate(parsed: DataFrame):
    """M2: (valid rows, invalid rows with ``violations``)."""
    v = parsed.withColumn("violations", contract_violations()).withColumn("_ok", F.size("violations") == 0)
    bad = v.withColumn("_bad", ~F.col("_ok"))
    return (keep_rows(v, "_ok").drop("violations", "_ok", "type_violations"),
            keep_rows(bad, "_bad").drop("_ok", "_bad", "type_violations"))


def attach(msgs: DataFrame, model: DataFrame, key: str = "message_id"):
    """M3: left join of the messages that need the model to their answers;
    (joined rows, ``no_model_output`` error rows). The key is the id, and the
    message's provider too if the answers name it (``message_provider``). Of
    several answers to a message the smallest by response id, then text,
    counts."""
    j = joined(msgs, model, key)
    missing = j.filter(F.col("raw_text").isNull()).select(
        *[c for c in (key, "msg_provider", "position") if c in j.columns], F.lit("no_model_output").alias("error"))
    return j.filter(F.col("raw_text").isNotNull()), missing


def joined(msgs: DataFrame, model: DataFrame, key: str = "message_id") -> DataFrame:
    """M3: the messages with their answers, or a null ``raw_text``."""
    m = model.withColumnRenamed("provider", "model_provider")
    keys = [key]
    if "message_provider" in m.columns and "msg_provider" in msgs.columns:
        m = m.withColumnRenamed("message_provider", "msg_provider")
        keys.append("msg_provider")
    order = [c for c in ("response_id", "raw_text") if c in m.columns]
    m = latest_per_key(m, keys, order, newest=False)
    return msgs.join(m, keys, "left")


def usage(df: DataFrame) -> DataFrame:
    """M4: token totals per provider (gate rows report provider ``gate``)."""
    return df.groupBy("provider").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum(F.coalesce(F.col("input_tokens"), F.lit(0))).alias("input_tokens"),
                                      F.sum(F.coalesce(F.col("output_tokens"), F.lit(0))).alias("output_tokens"))


def taxonomy_dims(spark) -> DataFrame:
    """Dimension rows (category, key); 40-odd fixed rows."""
    rows = [(c, k) for c, keys in P.TAXONOMY for k in keys]
    return spark.createDataFrame(rows, "category string, key string")


def taxonomy_report(insights: DataFrame) -> DataFrame:
    """M5: (category, key, n, in_taxonomy). The dims table is fixed-size, so
    broadcasting it is bounded; the counts are partial aggregations."""
    dims = taxonomy_dims(insights.sparkSession)
    counts = insights.groupBy(F.col("major_category").alias("category"),
                              F.col("sub_action_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(dims.withColumn("in_taxonomy", F.lit(True)))
    return (counts.join(known, ["category", "key"], "left")
            .select("category", "key", "n", F.coalesce("in_taxonomy", F.lit(False)).alias("in_taxonomy")))
