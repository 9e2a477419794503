"""Source, normalize and sink queries (S1-S11, P1-P11) over the raw nested
messages that Spark derives from the mail view. The oracles compute the
expected normalized values straight from the mail view columns, so each
check is a full encode -> parse round trip."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.operators import tables as TB
from mailsift.plans import sqlgen as S
from mailsift.plans.fixtures import mail_view, raw_messages, table, with_mail
from mailsift.config import released, shared_dir, stored
from mailsift.plans.registry import register, spread
from mailsift.sources import messages as SM


def raw(spark, sf_dir):
    return SM.parse_raw(raw_messages(mail_view(spread(table(spark, sf_dir, "documents")))))


def normalized(spark, sf_dir):
    good, _ = SM.validate_raw(raw(spark, sf_dir))
    return SM.normalize(good)


# rows that pass the input contract (a part without mimeType only exists
# in the depth-4 tree, i.e. doc_id % 4 = 3)
_VALID = "not (doc_id % 97 in (11, 22, 33, 44, 55) or (doc_id % 97 = 66 and doc_id % 4 = 3))"
_HTML = ("case when doc_id % 29 = 5 and body_html is null then '<p>' || body_text || '</p>' "
         "else body_html end")
_OFF = "case doc_id % 5 when 1 then -480 when 2 then 330 when 4 then -300 else 0 end"


def _body_sql() -> str:
    return (f"case when doc_id % 21 = 10 then {S.normalize_ws(S.strip_tags('body_html'))} "
            f"when doc_id % 29 = 5 then '' when doc_id % 37 = 9 then {S.strip('body_text || chr(65533)')} "
            f"else {S.strip('body_text')} end")


@register("s02_input_contract", with_mail(
    "select doc_id as position, case doc_id % 97 when 11 then 'id: missing' when 22 then 'payload: missing' "
    "when 33 then 'payload.mimeType: missing' when 44 then 'payload.headers[' || cast(2 + "
    "(case when h_to is not null then 1 else 0 end) + (case when doc_id % 10 = 3 then 1 else 0 end) + "
    "(case when doc_id % 5 <> 3 then 1 else 0 end) as varchar) || '].value: missing' when 55 then 'json: malformed' "
    "else 'payload.parts[0].mimeType: missing' end as violations from mail where not " + _VALID))
def s02_input_contract(spark, sf_dir):
    _, bad = SM.validate_raw(raw(spark, sf_dir))
    return bad.select("position", F.array_join("violations", "; ").alias("violations"))


@register("p11_normalize", with_mail(
    "select message_id, thread_id, subject, from_name, from_email, "
    "case when contains(h_to, '@') then h_to else '' end as to_list, "
    "case when doc_id % 8 = 3 then 'ann@example.com|bob@example.com' else '' end as cc_list, "
    "case when doc_id % 5 = 3 then null else strftime(epoch_ms(internal_date_ms - 300000), '%Y-%m-%d %H:%M:%S') "
    f"end as sent_at, case when doc_id % 5 = 3 then null else {_OFF} end as sent_offset_min, "
    "case when doc_id % 43 = 17 then null else strftime(epoch_ms(internal_date_ms), '%Y-%m-%d %H:%M:%S') end "
    f"as internal_date, {S.strip('substr(body_text, 1, 60)')} as snippet, {_body_sql()} as body_text, "
    f"{_HTML} as body_html from mail where {_VALID}"))
def p11_normalize(spark, sf_dir):
    n = normalized(spark, sf_dir)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return n.select("message_id", "thread_id", "subject", "from_name", "from_email",
                    F.array_join("to", "|").alias("to_list"), F.array_join("cc", "|").alias("cc_list"),
                    fmt("sent_at").alias("sent_at"), "sent_offset_min", fmt("internal_date").alias("internal_date"),
                    "snippet", "body_text", "body_html")


@register("p01_header_map", with_mail(
    "select message_id, array_to_string(list_sort(list_filter(['from', case when h_to is not null then 'to' end, "
    "'subject', case when doc_id % 5 <> 3 then 'date' end, 'message-id', case when doc_id % 8 = 3 then 'cc' end, "
    "case when h_reply_to is not null then 'reply-to' end, case when h_list_unsubscribe is not null then "
    "'list-unsubscribe' end, case when h_precedence is not null then 'precedence' end, case when h_auto_submitted "
    "is not null then 'auto-submitted' end], lambda x: x is not null)), ',') as header_keys, subject as subject_value "
    f"from mail where {_VALID}"))
def p01_header_map(spark, sf_dir):
    n = normalized(spark, sf_dir)
    return n.select("message_id", F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("header_keys"),
                    F.col("headers")["subject"].alias("subject_value"))


@register("p02_header_lookup", with_mail(
    "select doc_id as position, subject from mail where doc_id % 97 not in (22, 55) and doc_id % 6 <> 2"))
def p02_header_lookup(spark, sf_dir):
    r = raw(spark, sf_dir).filter(F.col("raw").isNotNull())
    h = F.try_variant_get(F.col("raw"), "$.payload.headers", SM.HEADER_TYPE)
    return r.select("position", SM.header_lookup(h, "subject").alias("subject")).filter(F.col("subject").isNotNull())


def _parts_sql() -> str:
    html = "(body_html is not null or doc_id % 29 = 5)"
    plain = "(doc_id % 21 <> 10)"
    depth = f"greatest(doc_id % 4 + 1, case when {html} or doc_id % 21 = 10 then 2 else 1 end)"
    root = ("case when doc_id % 97 = 33 then null when d = 1 then 'text/plain' when d = 2 then "
            "'multipart/alternative' else 'multipart/mixed' end")
    hp = "case when p then '1' else '0' end"     # html index under its parent
    rows = [
        f"select position, '' as path, {root} as mime_type, d = 1 as has_data from t",
        "select position, '0', 'text/plain', true from t where d = 2 and p",
        f"select position, {hp}, 'text/html', true from t where d = 2 and h",
        "select position, '0', 'multipart/alternative', false from t where d = 3",
        "select position, '0.0', 'text/plain', true from t where d = 3 and p",
        f"select position, '0.' || {hp}, 'text/html', true from t where d = 3 and h",
        "select position, '1', 'application/pdf', false from t where d = 3",
        "select position, '0', case when doc_id % 97 = 66 then null else 'multipart/related' end, false "
        "from t where d = 4",
        "select position, '0.0', 'multipart/alternative', false from t where d = 4",
        "select position, '0.0.0', 'text/plain', true from t where d = 4 and p",
        f"select position, '0.0.' || {hp}, 'text/html', true from t where d = 4 and h",
        "select position, '0.1', 'image/png', true from t where d = 4",
    ]
    return with_mail(
        "select position, row_number() over (partition by position order by path) - 1 as ord, path, mime_type, "
        "has_data from (" + " union all ".join(rows) + ")",
        f"t as (select doc_id, doc_id as position, {depth} as d, {plain} as p, {html} as h from mail "
        "where doc_id % 97 not in (22, 55))")


@register("p04_mime_parts", _parts_sql())
def p04_mime_parts(spark, sf_dir):
    """P4 as a parts table: one row per MIME part in pre-order."""
    r = raw(spark, sf_dir)
    parts = SM.flatten_parts(F.col("raw"), SM.parts_levels(F.col("raw")))
    return r.select("position", F.posexplode(parts).alias("ord", "p")).select(
        "position", "ord", F.array_join(F.transform("p.path", lambda i: i.cast("string")), ".").alias("path"),
        F.col("p.mime_type").alias("mime_type"),
        F.coalesce(F.length("p.data") > 0, F.lit(False)).alias("has_data"))


@register("p05_best_body_html_only", with_mail(
    f"select message_id, {S.normalize_ws(S.strip_tags('body_html'))} as body_text from mail "
    f"where doc_id % 21 = 10 and {_VALID}"))
def p05_best_body_html_only(spark, sf_dir):
    n = normalized(spark, sf_dir)
    return n.filter(F.size(F.filter("parts", lambda p: p["mime_type"] == "text/plain")) == 0).select(
        "message_id", "body_text")


def _runlog_sql() -> str:
    snip = S.strip(r"regexp_replace(substr(body_text, 1, 60), '\s+', ' ', 'g')")
    date_v = ("case when doc_id % 5 = 3 then '(no date)' else strftime(epoch_ms(internal_date_ms - 300000) + "
              f"to_minutes({_OFF}), '%a, %-d %b %Y %H:%M:%S ') || case when {_OFF} < 0 then '-' else '+' end || "
              f"lpad(cast(abs({_OFF}) // 60 as varchar), 2, '0') || lpad(cast(abs({_OFF}) % 60 as varchar), 2, '0') "
              "|| case when doc_id % 5 = 4 then ' (EST)' else '' end end")
    # names of To/Subject are padded when doc_id % 6 = 2: the lookup does not
    # trim names, so those rows get the placeholders
    bad = "doc_id % 97 in (22, 55)"
    return with_mail(
        "select doc_id + 1 as \"index\", (select count(*) from mail) as total, "
        "case when doc_id % 97 in (11, 55) then 'index_' || cast(doc_id as varchar) else message_id end as message_id, "
        "case when doc_id % 97 = 55 then null else thread_id end as thread_id, "
        f"case when {bad} then '(no from)' else '\"' || from_name || '\" <' || from_email || '>' end as \"from\", "
        f"case when {bad} or h_to is null or doc_id % 6 = 2 then '(no to)' else h_to end as \"to\", "
        f"case when {bad} then '(no date)' else {date_v} end as \"date\", "
        f"case when {bad} or doc_id % 6 = 2 then '(no subject)' else subject end as subject, "
        f"case when doc_id % 97 = 55 then '' else {snip} end as snippet from mail")


@register("s10_run_log", _runlog_sql())
def s10_run_log(spark, sf_dir):
    return TB.run_log(raw(spark, sf_dir))


@register("s01_array_files", with_mail(
    "select row_number() over (order by doc_id) - 1 as position, case when doc_id % 97 <> 11 then message_id end as message_id "
    "from mail where doc_id % 97 <> 55"))
def s01_array_files(spark, sf_dir):
    """Files that are one JSON array each (500 messages), read in splits:
    every element at its place."""
    rows = raw(spark, sf_dir).filter(F.try_parse_json("value").isNotNull())
    files = rows.groupBy(F.format_string("%09d", F.floor(F.col("position") / 500)).alias("file")).agg(
        F.array_sort(F.collect_list(F.struct("position", "value"))).alias("m"))
    path = shared_dir(spark, f"arrays-{uuid.uuid4().hex}")
    files.select("file", F.concat(F.lit("[\n"), F.array_join("m.value", ",\n"), F.lit("\n]")).alias("value")).write.partitionBy("file").text(path)
    got = SM.read_messages(spark, path, "array")
    return got.select("position", F.get_json_object("value", "$.id").alias("message_id"))


@register("s11_batch_limit", with_mail("select doc_id as position, message_id from mail order by doc_id limit 5"))
def s11_batch_limit(spark, sf_dir):
    n = raw(spark, sf_dir).select("position", F.concat(F.lit("m"), F.col("position").cast("string"))
                                  .alias("message_id"))
    return TB.batch_limit(n, 5)


@register("s03_message_store", with_mail(
    "select 'gmail' as provider, message_id as provider_message_id, thread_id as provider_thread_id, subject, "
    f"'pending' as processing_status from mail where {_VALID}"))
def s03_message_store(spark, sf_dir):
    n = stored(normalized(spark, sf_dir).drop("raw", "parts"), "normalized")  # read three times
    # every message ingested twice (a replayed batch): the store keeps one row per key
    twice = n.unionByName(n.withColumn("position", F.col("position") + F.lit(10 ** 12)))
    st = TB.message_store(twice, F.lit(None).cast("string"))
    return st.select("provider", "provider_message_id", "provider_thread_id", "subject", "processing_status")


@register("p03_base64url_decode", with_mail(
    "select doc_id as position, case when doc_id % 29 = 5 then '   ' when doc_id % 37 = 9 then body_text || "
    "chr(65533) else body_text end as text from mail where doc_id % 97 not in (22, 55) and doc_id % 21 <> 10 "
    "and not (doc_id % 97 = 33 and doc_id % 4 = 0 and body_html is null and doc_id % 29 <> 5)"))
def p03_base64url_decode(spark, sf_dir):
    """P3 on the text/plain part of every parseable message (junk
    characters, missing padding and bad UTF-8 included)."""
    r = raw(spark, sf_dir).filter(F.col("raw").isNotNull())
    parts = SM.flatten_parts(F.col("raw"), SM.parts_levels(F.col("raw")))
    plain = F.filter(parts, lambda p: (p["mime_type"] == "text/plain") & p["data"].isNotNull())
    return r.select("position", SM.b64url_text(F.try_element_at(plain, F.lit(1))["data"]).alias("text")) \
        .filter(F.size(plain) > 0)


@register("s01_read_messages", with_mail(
    "select case when doc_id % 97 in (11, 55) then null else message_id end as message_id, doc_id % 97 <> 55 as parsed "
    "from mail"))
def s01_read_messages(spark, sf_dir):
    """The derived messages, malformed ones too, written as JSON-array files,
    single-object files and JSON-lines files, read back with format detection per
    file (rows check: one row per message)."""
    base = shared_dir(spark, f"s01-{uuid.uuid4().hex[:12]}")
    with released(spark):
        rm = stored(raw(spark, sf_dir).select("position", "value", F.col("raw").isNotNull().alias("ok")), "raw")
        # pretty-printed objects: each in a file (and folder) of its own
        single = F.col("position") % 50 == 2
        (rm.filter(single).select(F.monotonically_increasing_id().alias("m"), F.concat(
            F.lit("{\n  "), F.expr("substring(value, 2)"), F.lit("\n")).alias("value"))
         .write.partitionBy("m").text(os.path.join(base, "objects")))
        # arrays: messages grouped into arrays of about 50, one array per line-free file;
        # a text that is no JSON cannot be an element
        array = ~single & (F.col("position") % 3 == 1) & F.col("ok")
        arr = (rm.filter(array).groupBy(F.floor(F.col("position") / 150).alias("g"))
               .agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")))
        # one array per file: each group is written by one task into its own folder
        arr.select("g", "value").write.partitionBy("g").text(os.path.join(base, "arrays"))
        # JSON lines: one message per line, malformed or not
        rm.filter(~single & ~array).select("value").write.option("maxRecordsPerFile", 1000).text(os.path.join(base, "lines"))
    got = SM.read_messages(spark, os.path.join(base, "*"), fmt="auto")
    return SM.parse_raw(got).select(F.try_variant_get("raw", "$.id", "string").alias("message_id"),
                                    (F.col("raw").isNotNull()).alias("parsed"))


@register("s01_positions", "select count(*) as n, 0 as low, count(*) - 1 as high, count(*) as different from documents")
def s01_positions(spark, sf_dir):
    """Positions of messages read back from many files are dense."""
    import os
    import uuid
    from mailsift.config import shared_dir
    base = os.path.join(shared_dir(spark, f"s01-{uuid.uuid4().hex[:12]}"), "lines")
    raw_messages(mail_view(spread(table(spark, sf_dir, "documents")))).select("value").write.text(base)
    got = SM.read_messages(spark, base)
    return got.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("low"), F.max("position").alias("high"),
                   F.count_distinct("position").alias("different"))


@register("p10_snippet", "select doc_id, case when length(s) > 180 then substr(s, 1, 180) || '…' else s end as snippet "
          "from (select doc_id, " + S.strip(r"regexp_replace(text, '\s+', ' ', 'g')") + " as s from documents)")
def p10_snippet(spark, sf_dir):
    from mailsift.functions.text import collapse_snippet
    return table(spark, sf_dir, "documents").select("doc_id", collapse_snippet("text").alias("snippet"))


# --------------------------------------------------- P6-P9 as their own queries
def _p(body: str) -> str:
    return with_mail(body + f" from mail where {_VALID}")


@register("p06_addresses", _p(
    "select message_id, from_name, from_email, case when contains(h_to, '@') then h_to else '' end as to_list, "
    "case when doc_id % 8 = 3 then 'ann@example.com|bob@example.com' else '' end as cc_list"))
def p06_addresses(spark, sf_dir):
    """From (quoted display name), To (group syntax dropped), Cc list."""
    n = normalized(spark, sf_dir)
    return n.select("message_id", "from_name", "from_email", F.array_join("to", "|").alias("to_list"),
                    F.array_join("cc", "|").alias("cc_list"))


# address lists made of the mail view's names and addresses: (Spark and SQL text
# of the value, SQL text of the names and addresses that it stands for)
_ADDRESS_FORMS = [
    ("'\"Doe, \\\\\"' || from_name || '\\\\\" (x)\" <' || from_email || '>, bob@x.example (Bob (the) Builder)'",
     "'Doe, \"' || from_name || '\" (x)=' || from_email || '|Bob the Builder=bob@x.example'"),
    ("from_name || ' (work) <' || from_email || '>'", "from_name || ' (work)=' || from_email"),
    ("'team: ' || from_email || ', \"C, D\" <c@d.example>; late: e@f.example;, g@h.example'",
     "'=' || from_email || '|C, D=c@d.example|=e@f.example|=g@h.example'"),
    ("'(' || from_name || ') ' || from_email || ', \"odd one\"@x.example'", "from_name || '=' || from_email || '|=\"odd one\"@x.example'"),
    ("from_name || ' <' || from_email || '>, plain@x.example'", "from_name || '=' || from_email || '|=plain@x.example'"),
]


def _form(i: int, spark: bool) -> str:
    """The value or what it stands for, by document."""
    texts = [f[i] if spark else f[i].replace("\\\\", "\\") for f in _ADDRESS_FORMS]
    return "case doc_id % 5 " + " ".join(f"when {k} then {t}" for k, t in enumerate(texts)) + " end"


@register("p06_address_forms", with_mail(f"select message_id, {_form(1, False)} as mailboxes from mail"))
def p06_address_forms(spark, sf_dir):
    """Escaped quotes, nested comments, several groups, comments as names,
    quoted local parts."""
    mail = mail_view(table(spark, sf_dir, "documents"))
    found = mail.select("message_id", SM.parse_addresses(F.expr(_form(0, True))).alias("a"))
    return found.select("message_id", F.array_join(F.transform("a", lambda x: F.concat(x["name"], F.lit("="), x["email"])), "|")
                        .alias("mailboxes"))


@register("p07_date_header", _p(
    "select message_id, case when doc_id % 5 = 3 then null else strftime(epoch_ms(internal_date_ms - 300000), "
    f"'%Y-%m-%d %H:%M:%S') end as sent_at, case when doc_id % 5 = 3 then null else {_OFF} end as offset_min"))
def p07_date_header(spark, sf_dir):
    """Date header -> instant + sender offset (weekday, comment, no
    header)."""
    n = normalized(spark, sf_dir)
    return n.select("message_id", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent_at"),
                    F.col("sent_offset_min").alias("offset_min"))


@register("p08_internal_date", _p(
    "select message_id, case when doc_id % 43 = 17 then null else strftime(epoch_ms(internal_date_ms), "
    "'%Y-%m-%d %H:%M:%S') end as internal_date"))
def p08_internal_date(spark, sf_dir):
    """Epoch-ms string -> timestamp; not a number -> null."""
    n = normalized(spark, sf_dir)
    return n.select("message_id", F.date_format("internal_date", "yyyy-MM-dd HH:mm:ss").alias("internal_date"))


@register("p09_base_time", _p(
    "select message_id, case when doc_id % 5 <> 3 then strftime(epoch_ms(internal_date_ms - 300000), "
    "'%Y-%m-%d %H:%M:%S') when doc_id % 43 <> 17 then strftime(epoch_ms(internal_date_ms), '%Y-%m-%d %H:%M:%S') "
    "else '2024-02-01 00:00:00' end as base_time"))
def p09_base_time(spark, sf_dir):
    """Sent -> internal -> the job's run time."""
    from mailsift.operators.repair import base_time
    n = normalized(spark, sf_dir)
    return n.select("message_id", F.date_format(base_time(F.lit("2024-02-01 00:00:00").cast("timestamp")),
                                                "yyyy-MM-dd HH:mm:ss").alias("base_time"))
