"""Tables and sinks (S3-S11): message store, insight upsert, status update,
tasks, per-item results, split sinks, output contract, run log, batch
limit.

"Latest per key" uses aggregate functions (``min_by`` / ``max_by``) rather
than windows, so a key holding a large share of the rows is pre-aggregated per
task before the shuffle; first copies are told from keys and positions alone.
Upserts are a full outer join on the key (no table format with MERGE is
assumed); ``keyed`` keeps the tables in buckets, of which a merge rewrites
those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.config import stored
from mailsift.functions import patterns as P
from mailsift.functions.text import collapse_snippet, keep_rows

# FIXED VALUES: insight columns an upsert replaces; the rest (identity, created_at) stay.
REPLACED = ["reference", "predicted_at", "major_category", "sub_action_key", "reply_required", "explicit_task",
            "task_type", "confidence", "reason", "evidence", "entities", "full_response"]
KEPT = ["provider_message_id", "provider_thread_id", "created_at"]
INSIGHT_KEY = ["provider", "email_message_id"]


def latest_per_key(df: DataFrame, keys: list[str], order: str | list[str], newest: bool = True) -> DataFrame:
    """One row per key: the row with the largest (or smallest) ``order``
    (columns, compared in turn; a null comes last). Partial aggregation keeps a
    hot key to one row per task before the shuffle."""
    cols = [c for c in df.columns]
    pick = F.max_by if newest else F.min_by
    names = [order] if isinstance(order, str) else order
    place = F.struct(*[x for n in names for x in (
        (F.col(n).isNotNull() if newest else F.col(n).isNull()).alias(f"_known_{n}"), F.col(n).alias(f"_by_{n}"))])
    agg = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in cols]), place).alias("_r"))
    return agg.select("_r.*")


def without(df: DataFrame, dropped: DataFrame, row: str = "position") -> DataFrame:
    """``df`` without the rows whose number ``row`` is in ``dropped``. The numbers
    are written as sets of bits, one word for 64 neighbours, so the planner knows
    how small they are: while they can be broadcast, and dense numbers long can, the
    rows of ``df`` stay where they are; beyond that it is a join by word."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{row}`, 64L) as int))")
    numbers = dropped.select(F.col(row).cast("bigint").alias(row)).filter(F.col(row).isNotNull())
    words = stored(numbers.groupBy(F.shiftright(row, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "dropped")
    return df.join(words, (F.shiftright(F.col(row).cast("bigint"), 6) == F.col("_word"))
                   & (F.col("_bits").bitwiseAND(bit) != 0), "left_anti")


def first_by_key(df: DataFrame, keys: list[str], position: str = "position", row: str | None = None) -> DataFrame:
    """The row of each key with the smallest ``position`` (unique, not null).
    Only keys and positions are grouped and compared; the other columns stay where
    they are (``without``, by ``row`` if the positions are not dense). ``df`` is
    read three times: give a written table."""
    row = row or position
    narrow = df.select(*keys, *{position: 0, row: 0})
    repeated = narrow.groupBy(*keys).agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    later = narrow.join(repeated, keys).filter(F.col(position) > F.col("_first")).select(row)
    return without(df, later, row)


# ------------------------------------------------------------------------ S3
MESSAGE_KEY = ["provider", "provider_message_id"]
TASK_KEY = ["provider", "provider_thread_id", "task_id_hint"]


def message_store(msgs: DataFrame, raw_json: Column | None = None) -> DataFrame:
    """S3: normalized columns + raw payload, unique on (provider, id), first
    ingested copy kept, status ``pending``."""
    return first_by_key(store_rows(msgs, raw_json), MESSAGE_KEY)


def store_rows(msgs: DataFrame, raw_json: Column | None = None) -> DataFrame:
    """S3 rows of messages that are unique already."""
    return msgs.select(
        "provider", F.col("message_id").alias("provider_message_id"), F.col("thread_id").alias("provider_thread_id"),
        "subject", "from_name", "from_email", F.col("to").alias("to_emails"), F.col("cc").alias("cc_emails"),
        "internal_date", "snippet", "body_text", "body_html",
        (raw_json if raw_json is not None else F.lit(None).cast("string")).alias("raw_payload"),
        F.lit(None).cast("boolean").alias("is_actionable"), F.lit("pending").alias("processing_status"),
        F.col("position"))


# ------------------------------------------------------------------------ S4
def insight_rows(insights: DataFrame, cfg_contract: str) -> DataFrame:
    """Insight table rows (denormalized hot fields + full JSON, R19)."""
    return insights.select(
        F.col("message_id").alias("email_message_id"), F.col("msg_provider").alias("provider"),
        F.col("message_id").alias("provider_message_id"), F.col("thread_id").alias("provider_thread_id"),
        F.lit(cfg_contract).alias("reference"), F.col("predicted_at"), "major_category", "sub_action_key",
        "reply_required", "explicit_task", "task_type", "confidence", "reason",
        F.to_json("evidence").alias("evidence"), F.to_json("entities").alias("entities"),
        F.to_json(F.struct(*[F.col(c) for c in ["major_category", "sub_action_key", "explicit_task", "confidence",
                                                "suggested_reply_action", "task_proposal", "recommended_actions",
                                                "urgency_signals", "extracted_summary", "entities", "evidence",
                                                "debug"]])).alias("full_response"),
        F.col("predicted_at").alias("created_at"))


def upsert(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = tuple(INSIGHT_KEY)) -> DataFrame:
    """Insert or replace the listed columns; identity columns and
    ``created_at`` keep the stored value. Of several new rows of a key the one
    predicted last counts. Idempotent: merging the same new rows again changes
    nothing."""
    e = existing.alias("e")
    n = latest_per_key(new, list(keys), ["predicted_at", "full_response"]).alias("n")
    on = [F.col(f"e.{k}") == F.col(f"n.{k}") for k in keys]
    j = e.join(n, on, "full_outer")
    last = keys[-1]
    cols = [F.coalesce(F.col(f"e.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    cols += [F.when(F.col(f"n.{last}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
             for c in REPLACED]
    cols += [F.when(F.col(f"e.{last}").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in KEPT]
    return j.select(*cols)


def write_version(df: DataFrame, base_dir: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write a table version to ``base_dir/v=<n>``; readers follow the
    version that ``publish`` names."""
    path = f"{base_dir}/v={version:06d}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# ------------------------------------------------------------------------ S5
def status_update(store: DataFrame, insights: DataFrame) -> DataFrame:
    """Processed + is_actionable for triaged messages; others untouched."""
    return with_status(store.join(status_rows(insights), MESSAGE_KEY, "left"), store.columns)


def status_rows(insights: DataFrame) -> DataFrame:
    """The keys of triaged messages with their flag."""
    return insights.groupBy(F.col("msg_provider").alias("provider"), F.col("message_id").alias("provider_message_id")).agg(
        F.max("is_actionable").alias("_act"), F.lit(True).alias("_hit"))


def with_status(joined: DataFrame, columns: list[str]) -> DataFrame:
    """S5 of store rows joined to ``status_rows``."""
    return joined.select(*[F.col(c) for c in columns if c not in ("is_actionable", "processing_status")],
                         F.when(F.col("_hit"), F.col("_act")).otherwise(F.col("is_actionable")).alias("is_actionable"),
                         F.when(F.col("_hit"), F.lit("processed")).otherwise(F.col("processing_status"))
                          .alias("processing_status"))


# ------------------------------------------------------------------------ S6
def tasks(insights: DataFrame) -> DataFrame:
    """One task per (thread, hint) from insights with a task proposal.
    Our mapping: hint = task type (``task`` when empty); the newest
    message's proposal wins (by message time, then id)."""
    t = F.col("task_proposal")
    rows = keep_rows(insights.withColumn("_has", t.isNotNull()), "_has").select(
        F.col("thread_id").alias("provider_thread_id"),
        F.coalesce(t["type"], F.lit("task")).alias("task_id_hint"),
        F.col("message_id").alias("email_message_id"),
        F.coalesce(F.nullif(t["title"], F.lit("")), F.col("extracted_summary.ask")).alias("title"),
        t["description"].alias("instruction"), F.col("sub_action_key").alias("action_type"),
        t["priority"].alias("priority"), F.try_to_timestamp(t["due_at"]).alias("due_at"),
        t["status"].alias("status"), F.col("msg_provider").alias("provider"), F.col("msg_time").alias("proposed_at"))
    return newest_tasks(rows)


def newest_tasks(rows: DataFrame) -> DataFrame:
    """S6 over task rows, stored ones and new ones alike."""
    return latest_per_key(rows, TASK_KEY, ["proposed_at", "email_message_id"])


# ------------------------------------------------------------------------ S7
def item_results(insights: DataFrame, errors: DataFrame) -> DataFrame:
    """One result per input item: message id, 0-based index (the position
    that its message carries), status, output JSON or error text (<= 500
    chars)."""
    ok = insights.select("message_id", F.col("position").alias("index"), F.lit("success").alias("status"),
                         F.to_json(F.struct(*[F.col(c) for c in insights.columns if c not in (
                             "message_id", "thread_id", "provider", "msg_provider", "msg_time", "position", "input_tokens",
                             "output_tokens", "response_id", "reply_by_bad_time", "reply_by_unparsed",
                             "predicted_at")])).alias("output"),
                         F.lit(None).cast("string").alias("error"))
    bad = errors.select("message_id", F.col("position").alias("index"), F.lit("error").alias("status"),
                        F.lit(None).cast("string").alias("output"), F.substring("error", 1, P.ERROR_CHARS).alias("error"))
    return ok.unionByName(bad)


# ------------------------------------------------------------------------ S8
def split_results(results: DataFrame):
    """(ok rows, error rows with input id, status, error)."""
    ok = results.filter(F.col("status") == "success").select("message_id", "output")
    bad = results.filter(F.col("status") != "success").select(
        F.col("message_id").alias("input_message_id"), F.lit(None).cast("int").alias("status_code"), "error")
    return ok, bad


# ------------------------------------------------------------------------ S9
def output_violations() -> Column:
    """Contract of a finished insight."""
    conf, cat = F.col("confidence"), F.col("major_category")
    rules = [
        (cat.isNull(), "major_category: missing"),
        (cat.isNotNull() & ~cat.isin(*P.CATEGORIES), "major_category: not in domain"),
        (F.col("sub_action_key").isNull(), "sub_action_key: missing"),
        (F.col("explicit_task").isNull(), "explicit_task: missing"),
        (conf.isNull() | (conf < 0) | (conf > 1), "confidence: out of range"),
        (F.col("urgency_signals").isNull(), "urgency_signals: missing"),
        (F.col("debug").isNull(), "debug: missing"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull())


# ----------------------------------------------------------------------- S10
def run_log(raw: DataFrame) -> DataFrame:
    """Input reference per item from the raw JSON: 1-based index,
    total, id with fallbacks, thread, from/to/date/subject header values
    (case-insensitive, first match, untrimmed) with placeholders, and the
    collapsed snippet (180 chars + ellipsis); placeholders are fixed values.
    ``total`` is a scalar
    subquery, not a global window."""
    from mailsift.sources.messages import HEADER_TYPE, header_lookup
    r = F.col("raw")
    h = F.try_variant_get(r, "$.payload.headers", HEADER_TYPE)
    total = raw.select(F.count(F.lit(1))).scalar()
    g = lambda path: F.nullif(F.try_variant_get(r, path, "string"), F.lit(""))
    hv = lambda name, ph: F.coalesce(F.nullif(header_lookup(h, name), F.lit("")), F.lit(ph))
    return raw.select(
        (F.col("position") + 1).alias("index"), total.alias("total"),
        F.coalesce(g("$.id"), g("$.message_id"), F.concat(F.lit("index_"), F.col("position").cast("string")))
         .alias("message_id"),
        F.coalesce(g("$.threadId"), g("$.thread_id")).alias("thread_id"),
        hv("From", "(no from)").alias("from"), hv("To", "(no to)").alias("to"),
        hv("Date", "(no date)").alias("date"), hv("Subject", "(no subject)").alias("subject"),
        collapse_snippet(g("$.snippet")).alias("snippet"))


# ----------------------------------------------------------------------- S11
def batch_limit(df: DataFrame, n: int, order: str = "position") -> DataFrame:
    """The first ``n`` items (ordered limit: per-task top-n + merge)."""
    return df.orderBy(order).limit(n)
