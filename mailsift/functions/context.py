"""Context documents handed to a scorer: thread context (T9), plain-text
context (T10) and the JSON context (T11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.config import DEFAULT_CONFIG, TriageConfig
from mailsift.functions import patterns as P
from mailsift.functions.dates import iso_with_offset
from mailsift.functions.text import (cap_body, extract_links, extract_money, extract_time_phrases,
                                     has_unsubscribe, normalize_whitespace, party_line, py_strip)


def thread_context(msgs: DataFrame, thread="thread_id", order="order_key", sender="sender",
                   subject="subject", body="body_text", n: int = 5,
                   max_chars: int = DEFAULT_CONFIG.max_body_chars) -> DataFrame:
    """Last ``n`` messages of each thread, oldest first, each as a
    ``From/Subject`` line plus normalized body, joined by a rule line and
    capped. ``row_number() <= n`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so a hot thread ships at most ``n``
    rows per map task."""
    w = Window.partitionBy(thread).orderBy(F.col(order).desc())
    chunk = F.concat(F.lit("From: "), F.coalesce(F.col(sender), F.lit("")), F.lit(" | Subject: "),
                     F.coalesce(F.col(subject), F.lit("")), F.lit("\n"),
                     normalize_whitespace(py_strip(F.coalesce(F.col(body), F.lit("")))))
    last = (msgs.select(thread, order, chunk.alias("chunk"))
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "chunk"))),
                                      lambda s: s["chunk"]), P.THREAD_SEPARATOR)
    return (last.groupBy(thread).agg(joined.alias("thread_text"))
            .select(thread, cap_body("thread_text", max_chars, P.LEGACY_TRUNCATED_SUFFIX).alias("thread_text")))


def plain_context(message_id="message_id", thread_id="thread_id", subject="subject", from_parties="from_parties",
                  to_parties="to_parties", cc_parties="cc_parties", body="body_text",
                  cfg: TriageConfig = DEFAULT_CONFIG) -> Column:
    """Plain-text context with optional signal sections (titles are
    fixed values)."""
    b = cap_body(py_strip(F.col(body)), cfg.max_body_chars, P.LEGACY_TRUNCATED_SUFFIX)
    links, money, times = extract_links(b), extract_money(b), extract_time_phrases(b)
    sect = lambda title, arr: F.when(F.size(arr) > 0, F.concat(
        F.lit("\n\n" + title + "\n"), F.array_join(arr, "\n"))).otherwise(F.lit(""))
    doc = F.concat(
        F.lit("EMAIL_ID: "), F.col(message_id), F.lit("\nTHREAD_ID: "), F.coalesce(F.col(thread_id), F.lit("")),
        F.lit("\nSUBJECT: "), py_strip(F.coalesce(F.col(subject), F.lit(""))),
        F.lit("\nFROM: "), party_line(from_parties), F.lit("\nTO: "), party_line(to_parties),
        F.lit("\nCC: "), party_line(cc_parties), F.lit("\n\nBODY:\n"), b,
        sect("LINKS_DETECTED:", links), sect("MONEY_STRINGS_DETECTED:", money),
        sect("TIME_PHRASES_DETECTED:", times),
        F.when(has_unsubscribe(b), F.lit("\n\nUNSUBSCRIBE_SIGNAL_DETECTED: true")).otherwise(F.lit("")))
    return py_strip(doc)


def context_signals(cfg: TriageConfig = DEFAULT_CONFIG) -> list[Column]:
    """Signal columns of the JSON context: taken from the capped body; links
    come from the HTML whenever it exists (uncapped)."""
    body = cap_body(py_strip(F.col("body_text")), cfg.max_body_chars, P.TRUNCATED_SUFFIX)
    link_src = F.coalesce(F.nullif(F.col("body_html"), F.lit("")), body)
    return [body.alias("ctx_body"),
            extract_time_phrases(body).alias("time_phrases"),
            F.slice(extract_links(link_src), 1, P.LINK_LIMIT).alias("links"),
            F.slice(extract_money(body), 1, P.MONEY_LIMIT).alias("money"),
            has_unsubscribe(body).alias("has_unsubscribe")]


def json_context(cfg: TriageConfig = DEFAULT_CONFIG) -> Column:
    """T11 over a gated frame that already holds ``context_signals``: null
    fields are written as JSON null; the gate verdict, score and fired names
    are added only when the verdict is ambiguous."""
    base = [F.col("time_phrases").alias("timePhrases"), F.col("links").alias("links"),
            F.col("money").alias("moneyStrings"), F.col("has_unsubscribe").alias("hasUnsubscribeSignal")]
    hints = [F.lit("ambiguous").alias("gateVerdict"),
             F.round(F.col("score_h") / F.lit(100.0), 3).alias("gateScore"),
             F.col("fired").alias("gateFiredSignals")]

    def payload(signals):
        return F.struct(
            F.col("provider").alias("provider"), F.col("message_id").alias("messageId"),
            F.col("thread_id").alias("threadId"), F.col("subject").alias("subject"),
            F.struct(F.col("from_name").alias("name"), F.col("from_email").alias("email")).alias("from"),
            F.col("to").alias("to"), F.col("cc").alias("cc"),
            iso_with_offset("sent_at", "sent_offset_min").alias("sentAt"),
            F.col("snippet").alias("snippet"), F.col("ctx_body").alias("bodyText"),
            F.struct(*signals).alias("signals"))
    opts = {"ignoreNullFields": "false"}
    return F.when(F.col("verdict") == "ambiguous", F.to_json(payload(base + hints), opts)) \
            .otherwise(F.to_json(payload(base), opts))
