"""Derived views the queries run on. Each is computed by Spark from the driver
tables, so its work grows with them; the SQL twin feeds the DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions.text import bind, once

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _case(key: Column, pairs, default=None) -> Column:
    out = None
    for k, v in pairs:
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(default) if default is not None else out


def mail_view(docs: DataFrame) -> DataFrame:
    """Messages with header columns ``h_*`` (null = header absent), derived
    row by row from ``documents`` (no shuffle)."""
    d = F.col("doc_id")
    m = lambda k: d % k
    local = _case(m(9), [(0, "noreply"), (1, "newsletter"), (2, "Alerts"), (3, "info")],
                  F.concat(F.lit("user"), _s(m(50))))
    opt = lambda cond, text: F.when(cond, F.lit(text)).otherwise(F.lit(""))
    body = F.when(m(21) == 10, F.col("text")).otherwise(F.concat(
        opt(m(4) == 1, "Hi Sam, "),
        opt(m(8) == 5, "can you confirm Friday at 2pm PT? "),
        F.col("text"), F.lit("\n"),
        opt(m(6) == 0, "Invoice total $1,234.56 due by Friday EOD; pay 50 USD today. "
                       "See https://ex.example/p?utm_source=mail&x=1 "),
        opt(m(5) == 0, "Click to unsubscribe or manage your email preferences. "),
        opt(m(10) == 7, "View this email in your browser. "),
        opt(m(15) == 0, "Your weekly newsletter edition. "),
        opt(m(12) == 0, "12 Main Street, Springfield. All rights reserved.")))
    # an HTML message with far more markup than text
    html = (F.when(m(21) == 10, F.concat(F.repeat(F.lit("<div></div>"), (F.length("text") / 2).cast("int") + 60),
                                         F.lit("<div>"), F.col("text"), F.lit("</div>")))
             .when(m(14) == 0, F.concat(
                 F.lit('<html><img src="http://t.example/o.gif" width="1" height="1"><p>'),
                 F.col("text"), F.lit("</p></html>"))))
    return docs.select(
        F.concat(F.lit("m"), _s(d)).alias("message_id"),
        F.concat(F.lit("t"), _s(d - m(5))).alias("thread_id"),
        d.alias("doc_id"),
        F.concat(local, F.lit("@"), F.col("source"), F.lit(".example.com")).alias("from_email"),
        F.when(m(9) == 1, F.lit("Weekly Digest")).when(m(9) == 0, F.lit("No Reply"))
         .otherwise(F.lit("Sam Doe")).alias("from_name"),
        F.concat(F.when(m(4) == 1, F.lit("Re: item ")).otherwise(F.lit("Item ")), _s(d)).alias("subject"),
        F.when(m(17) == 3, F.lit("undisclosed-recipients:;")).when(m(19) == 4, F.lit(None))
         .otherwise(F.lit("box@example.com")).alias("h_to"),
        F.when(m(13) == 2, F.lit("other@elsewhere.example")).alias("h_reply_to"),
        F.when(m(3) == 0, F.lit("<mailto:u@x.example>")).alias("h_list_unsubscribe"),
        F.when(m(7) == 0, F.lit("Bulk")).when(m(7) == 1, F.lit("normal")).alias("h_precedence"),
        F.when(m(11) == 5, F.lit("auto-generated")).when(m(11) == 6, F.lit("no")).alias("h_auto_submitted"),
        (F.lit(1706500000000) + d * 600000).alias("internal_date_ms"),
        body.alias("body_text"),
        html.alias("body_html"),
        _case(m(8), [(0, "Friday 2pm PT"), (1, "tomorrow EOD"), (2, "next Monday 14:30"), (3, "today"),
                     (4, "asap"), (5, "Tuesday noon ET"), (6, "13:00 sunday utc")]).alias("deadline_text"),
    )


def mail_messages(docs: DataFrame) -> DataFrame:
    """The mail view in the normalized message shape the operators take:
    a header MAP (first occurrence wins, absent headers left out), to-list,
    UTC timestamps."""
    mv = mail_view(docs)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in [
        ("to", "h_to"), ("reply-to", "h_reply_to"), ("list-unsubscribe", "h_list_unsubscribe"),
        ("precedence", "h_precedence"), ("auto-submitted", "h_auto_submitted")]])
    return mv.select(
        F.lit("gmail").alias("provider"), "message_id", "thread_id", "doc_id", "subject", "from_name",
        "from_email",
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("headers"),
        F.when(F.col("h_to").isNotNull() & (F.col("h_to").contains("@")), F.array(F.col("h_to")))
         .otherwise(F.array().cast("array<string>")).alias("to"),
        F.array().cast("array<string>").alias("cc"),
        F.lit(None).cast("timestamp").alias("sent_at"),
        F.lit(None).cast("int").alias("sent_offset_min"),
        F.timestamp_millis("internal_date_ms").alias("internal_date"),
        F.lit("").alias("snippet"),
        "body_text", "body_html", "deadline_text")


# SQL twin of ``mail_view`` for DuckDB (string type = varchar).
MAIL_SQL = """
select 'm'||cast(doc_id as varchar) as message_id,
  't'||cast(doc_id - doc_id % 5 as varchar) as thread_id, doc_id,
  case doc_id % 9 when 0 then 'noreply' when 1 then 'newsletter' when 2 then 'Alerts' when 3 then 'info'
       else 'user'||cast(doc_id % 50 as varchar) end || '@' || source || '.example.com' as from_email,
  case when doc_id % 9 = 1 then 'Weekly Digest' when doc_id % 9 = 0 then 'No Reply' else 'Sam Doe' end as from_name,
  case when doc_id % 4 = 1 then 'Re: item ' else 'Item ' end || cast(doc_id as varchar) as subject,
  case when doc_id % 17 = 3 then 'undisclosed-recipients:;' when doc_id % 19 = 4 then null else 'box@example.com' end as h_to,
  case when doc_id % 13 = 2 then 'other@elsewhere.example' end as h_reply_to,
  case when doc_id % 3 = 0 then '<mailto:u@x.example>' end as h_list_unsubscribe,
  case when doc_id % 7 = 0 then 'Bulk' when doc_id % 7 = 1 then 'normal' end as h_precedence,
  case when doc_id % 11 = 5 then 'auto-generated' when doc_id % 11 = 6 then 'no' end as h_auto_submitted,
  1706500000000 + doc_id * 600000 as internal_date_ms,
  case when doc_id % 21 = 10 then text else
    case when doc_id % 4 = 1 then 'Hi Sam, ' else '' end
    || case when doc_id % 8 = 5 then 'can you confirm Friday at 2pm PT? ' else '' end
    || text || chr(10)
    || case when doc_id % 6 = 0 then 'Invoice total $1,234.56 due by Friday EOD; pay 50 USD today. See https://ex.example/p?utm_source=mail&x=1 ' else '' end
    || case when doc_id % 5 = 0 then 'Click to unsubscribe or manage your email preferences. ' else '' end
    || case when doc_id % 10 = 7 then 'View this email in your browser. ' else '' end
    || case when doc_id % 15 = 0 then 'Your weekly newsletter edition. ' else '' end
    || case when doc_id % 12 = 0 then '12 Main Street, Springfield. All rights reserved.' else '' end
  end as body_text,
  case when doc_id % 21 = 10 then repeat('<div></div>', length(text) // 2 + 60) || '<div>' || text || '</div>'
       when doc_id % 14 = 0 then '<html><img src="http://t.example/o.gif" width="1" height="1"><p>' || text || '</p></html>'
  end as body_html,
  case doc_id % 8 when 0 then 'Friday 2pm PT' when 1 then 'tomorrow EOD' when 2 then 'next Monday 14:30'
       when 3 then 'today' when 4 then 'asap' when 5 then 'Tuesday noon ET' when 6 then '13:00 sunday utc' end as deadline_text
from documents
"""


def with_mail(sql_body: str, extra_ctes: str = "") -> str:
    """Prefix an oracle query with the mail CTE (and more CTEs if given)."""
    ctes = "mail as (" + MAIL_SQL + ")"
    if extra_ctes:
        ctes += ", " + extra_ctes
    return "with " + ctes + "\n" + sql_body


def _cat_case(col: str) -> str:
    from mailsift.functions.patterns import TAXONOMY
    return "case " + col + " % 12 " + " ".join(
        f"when {i} then '{c}'" for i, (c, _) in enumerate(TAXONOMY)) + " end"


def _key_case(col: str) -> str:
    from mailsift.functions.patterns import TAXONOMY
    return "case " + col + " % 12 " + " ".join(
        f"when {i} then '{keys[1] if len(keys) > 1 else keys[0]}'" for i, (_, keys) in enumerate(TAXONOMY)) + " end"


# Model output text per message, varied by doc_id (plain, fenced,
# malformed, missing field, category outside the domain, confidence above 1,
# untidy key, unordered ranks, duplicate evidence, blank task type, numeric
# string). One expression text that Spark (``expr``) and DuckDB both run.
_MODEL_JSON = (
    "'{\"major_category\": \"' || (case when doc_id % 11 = 3 then 'urgent_stuff' else " + _cat_case("doc_id")
    + " end) || '\", \"sub_action_key\": \"' || (case when doc_id % 11 = 5 then ' schedule-confirm time! ' else "
    + _key_case("doc_id") + " end) || '\", ' "
    "|| (case when doc_id % 11 = 2 then '' else '\"explicit_task\": ' || (case when doc_id % 2 = 0 then 'true' "
    "else 'false' end) || ', ' end) "
    "|| '\"confidence\": ' || (case when doc_id % 11 = 4 then '1.5' when doc_id % 11 = 9 then '\"0.55\"' "
    "else '0.' || cast(5 + doc_id % 5 as string) end) || ', ' "
    "|| '\"suggested_reply_action\": ' || (case when doc_id % 3 = 0 then '[\"Confirm\", \"Decline\"]' else '[]' end)"
    " || ', \"task_proposal\": ' || (case when doc_id % 4 = 0 then '{\"type\": \"' || (case when doc_id % 11 = 8 "
    "then '  ' else 'reply' end) || '\", \"title\": \"  Follow up item ' || cast(doc_id as string) || '  \", "
    "\"description\": \" Reply to sender \", \"priority\": \"' || (case doc_id % 7 when 0 then 'High ' when 1 then "
    "'low' when 2 then 'urgent' else 'medium' end) || '\", \"status\": \"done\", \"due_at\": null}' else 'null' end)"
    " || ', \"recommended_actions\": ' || (case when doc_id % 11 = 6 then '[{\"key\": \" reply \", \"label\": "
    "\"Reply \", \"kind\": \"primary\", \"rank\": 2}, {\"key\": \"archive\", \"label\": \"Archive\", \"kind\": "
    "\"weird\", \"rank\": 1}, {\"key\": \"snooze\", \"label\": \"Snooze\", \"rank\": 2}]' else '[{\"key\": "
    "\"reply\", \"label\": \"Reply\", \"kind\": \"PRIMARY\", \"rank\": 1}, {\"key\": \"archive\", \"label\": "
    "\"Archive\", \"kind\": \"SECONDARY\", \"rank\": 2}]' end) "
    "|| ', \"urgency_signals\": {\"urgency\": \"' || (case doc_id % 5 when 0 then ' High' when 1 then 'low' "
    "when 2 then 'CRITICAL' when 3 then 'soon' else 'medium' end) || '\", \"deadline_detected\": ' || (case when "
    "deadline_text is null then 'false' else 'true' end) || ', \"deadline_text\": ' || (case when deadline_text "
    "is null then 'null' else '\"' || deadline_text || '\"' end) || ', \"reply_by\": null, \"reason\": "
    "\" Needs a reply \"}' "
    "|| ', \"extracted_summary\": {\"ask\": \" Please confirm item ' || cast(doc_id as string) || ' \", "
    "\"success_criteria\": \"Confirmed \", \"missing_info\": [\" \", \"budget\", \"owner \", \"date\", \"scope\"]}' "
    "|| ', \"entities\": {\"people\": [' || (case when doc_id % 3 = 1 then '{\"email\": \"' || upper(from_email) "
    "|| '\", \"role\": \"\"}' when doc_id % 3 = 2 then '{\"email\": \"pat@example.com\", \"role\": \"cc\"}' "
    "else '' end) || '], \"dates\": [' || (case when deadline_text is null then '' else '{\"text\": \"' || "
    "deadline_text || '\", \"type\": \"deadline\"}' end) || (case when doc_id % 6 = 1 then (case when "
    "deadline_text is null then '' else ', ' end) || '{\"text\": \"kickoff\", \"iso\": "
    "\"2024-02-01T10:00:00+00:00\", \"type\": \"meeting\"}' else '' end) || '], \"money\": [], \"docs\": [], "
    "\"meeting\": null}' "
    "|| ', \"evidence\": ' || (case when doc_id % 11 = 7 then '[\"Please confirm\", \"please   confirm\", \" \", "
    "\"Second point\", \"Third\", \"Fourth\"]' else '[\"Asked to confirm\"]' end) || '}'")

MODEL_TEXT_EXPR = (
    "(case when doc_id % 11 = 0 then '```json' || chr(10) else '' end) || (case when doc_id % 11 = 1 then substr("
    + _MODEL_JSON + ", 1, 60) else " + _MODEL_JSON + " end) || (case when doc_id % 11 = 0 then chr(10) || '```' "
    "else '' end)")
MODEL_OUTPUT_COLS = [
    "message_id",
    MODEL_TEXT_EXPR + " as raw_text",
    "cast(length(body_text) % 997 + 300 as bigint) as input_tokens",
    "cast(200 + doc_id % 50 as bigint) as output_tokens",
    "'msg_' || cast(doc_id as string) as response_id",
    "'model' as provider",
]
MODEL_OUTPUT_WHERE = "doc_id % 23 <> 7"


def model_output(mail: DataFrame) -> DataFrame:
    """One model answer per message (a few missing), derived from the
    mail view row by row."""
    return mail.filter(MODEL_OUTPUT_WHERE).selectExpr(*MODEL_OUTPUT_COLS)


MODEL_OUTPUT_SQL = ("model_output as (select " + ", ".join(MODEL_OUTPUT_COLS) + " from mail where "
                    + MODEL_OUTPUT_WHERE + ")")


# ---------------------------------------------------------------------------
# Raw nested messages (provider JSON), derived row by row from the mail
# view: base64url bodies in a MIME tree 1-4 levels deep, header lists with
# mixed case, padding, repeats, a quoted sender, group syntax, Cc, a Date
# with several offsets (or none), and bad shapes (missing id / payload /
# mimeType / header value, malformed JSON, bad base64, bad UTF-8).
def _jstr(c: Column) -> Column:
    """A JSON string literal for a string column (null -> null)."""
    j = F.to_json(F.struct(c.alias("v")))  # {"v":"..."}
    return F.when(c.isNull(), F.lit("null")).otherwise(bind(j, lambda v: v.substr(F.lit(6), F.length(v) - F.lit(6))))


def _b64url(binary: Column) -> Column:
    text = F.base64(binary)
    for old, new in (("+", "-"), ("/", "_"), ("=", ""), ("\r", ""), ("\n", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _leaf(part_id: str, mime: Column, data: Column | None, extra: str = "", headers: Column | None = None,
          mime_ok: Column | None = None) -> Column:
    body = (F.concat(F.lit('{"size":'), F.coalesce(F.length(data), F.lit(0)).cast("string"), F.lit(',"data":'),
                     _jstr(data), F.lit("}")) if data is not None else F.lit('{"size":0}'))
    mt = F.concat(F.lit('"mimeType":'), _jstr(mime), F.lit(","))
    if mime_ok is not None:
        mt = F.when(mime_ok, mt).otherwise(F.lit(""))
    return F.concat(F.lit('{"partId":"' + part_id + '",'), mt, F.lit('"headers":'),
                    headers if headers is not None else F.lit("[]"), F.lit(',"body":'), body, F.lit(extra + "}"))


def _node(part_id: str, mime: str, children: list[Column], mime_ok: Column | None = None,
          headers: Column | None = None) -> Column:
    mt = F.lit('"mimeType":"' + mime + '",')
    if mime_ok is not None:
        mt = F.when(mime_ok, mt).otherwise(F.lit(""))
    return F.concat(F.lit('{"partId":"' + part_id + '",'), mt, F.lit('"headers":'),
                    headers if headers is not None else F.lit("[]"),
                    F.lit(',"body":{"size":0},"parts":['), F.concat_ws(",", *children), F.lit("]}"))


def raw_messages(mail: DataFrame) -> DataFrame:
    """(position, value) JSON text rows; position = doc_id. Worked out in stages
    (``once``), so each body is encoded a single time."""
    mail = once(mail)
    d = F.col("doc_id")
    m = lambda k: d % k
    bad = m(97)
    html_only = m(21) == 10
    blank_plain = m(29) == 5
    html = F.when(blank_plain & F.col("body_html").isNull(),
                  F.concat(F.lit("<p>"), F.col("body_text"), F.lit("</p>"))).otherwise(F.col("body_html"))
    plain_bytes = (F.when(blank_plain, F.encode(F.lit("   "), "UTF-8"))
                   .when(m(37) == 9, F.concat(F.encode("body_text", "UTF-8"), F.unhex(F.lit("FF"))))
                   .otherwise(F.encode("body_text", "UTF-8")))
    keep = [c for c in mail.columns if c != "body_html"]
    mail = once(mail.select(*keep, html.alias("_html"), _b64url(plain_bytes).alias("_enc"),
                            _headers_json(mail).alias("_headers")))
    html, enc, headers_json = F.col("_html"), F.col("_enc"), F.col("_headers")
    # junk characters inside the data: decoders skip them
    pdata = F.when(m(31) == 7, F.concat(F.substring(enc, 1, 4), F.lit("!!\n"), enc.substr(F.lit(5), F.length(enc)))) \
             .otherwise(enc)
    mail = once(mail.select(*keep, "_headers", html.isNotNull().alias("_has_html"), pdata.alias("_plain"),
                            _b64url(F.encode(html, "UTF-8")).alias("_html")))
    pdata, hdata, has_html = F.col("_plain"), F.col("_html"), F.col("_has_html")
    root_ok = bad != 33
    plain = lambda h=None, ok=None: _leaf("P", F.lit("text/plain"), pdata, headers=h, mime_ok=ok)
    hleaf = F.when(has_html, _leaf("H", F.lit("text/html"), hdata))
    alt_kids = [F.when(~html_only, plain()), hleaf]
    alt = _node("A", "multipart/alternative", alt_kids)
    pdf = _leaf("F", F.lit("application/pdf"), None, ',"filename":"a.pdf"')
    img = _leaf("I", F.lit("image/png"), F.lit("iVBORw0KGgo"))
    depth = F.greatest(m(4) + 1, F.when(has_html | html_only, F.lit(2)).otherwise(F.lit(1)))
    payload = (F.when(depth == 1, plain(headers_json, root_ok))
               .when(depth == 2, _node("", "multipart/alternative", alt_kids, root_ok, headers_json))
               .when(depth == 3, _node("", "multipart/mixed", [alt, pdf], root_ok, headers_json))
               .otherwise(_node("", "multipart/mixed", [_node("R", "multipart/related", [alt, img], bad != 66)],
                                root_ok, headers_json)))
    internal = F.when(m(43) == 17, F.lit("not-a-number")).otherwise(F.col("internal_date_ms").cast("string"))
    snippet = F.concat(F.lit("  "), F.substring("body_text", 1, 60), F.lit("  "))
    value = F.concat(
        F.lit("{"), F.when(bad != 11, F.concat(F.lit('"id":'), _jstr(F.col("message_id")), F.lit(","))).otherwise(""),
        F.lit('"threadId":'), _jstr(F.col("thread_id")), F.lit(',"labelIds":["INBOX"],"snippet":'), _jstr(snippet),
        F.lit(',"internalDate":'), _jstr(internal), F.lit(',"sizeEstimate":'), F.length("body_text").cast("string"),
        F.when(bad != 22, F.concat(F.lit(',"payload":'), payload)).otherwise(""), F.lit("}"))
    value = bind(value, lambda v: F.when(bad == 55, F.substring(v, 1, 40)).otherwise(v))
    return once(mail.select(d.alias("position"), value.alias("value")))


def _headers_json(mail: DataFrame) -> Column:
    d = F.col("doc_id")
    m = lambda k: d % k
    sent = F.timestamp_millis(F.col("internal_date_ms") - 300000)
    off = F.when(m(5) == 1, F.lit(-480)).when(m(5) == 2, F.lit(330)).when(m(5) == 4, F.lit(-300)).otherwise(F.lit(0))
    local = sent + F.make_interval(mins=off)
    off_s = F.concat(F.when(off < 0, F.lit("-")).otherwise(F.lit("+")),
                     F.lpad(F.floor(F.abs(off) / 60).cast("string"), 2, "0"),
                     F.lpad((F.abs(off) % 60).cast("string"), 2, "0"))
    date_v = F.concat(F.date_format(local, "EEE, d MMM yyyy HH:mm:ss "), off_s,
                      F.when(m(5) == 4, F.lit(" (EST)")).otherwise(F.lit("")))
    name = lambda canon: F.when(m(2) == 0, F.lit(canon)).otherwise(F.lit(canon.upper() if len(canon) < 5  # noqa
                                                                          else canon.lower()))
    pad = lambda c: F.when(m(6) == 2, F.concat(F.lit(" "), c, F.lit(" "))).otherwise(c)
    hdr = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    from_v = F.concat(F.lit('"'), F.col("from_name"), F.lit('" <'), F.col("from_email"), F.lit(">"))
    headers = F.array(
        hdr(name("From"), from_v), hdr(pad(name("To")), F.col("h_to")),
        hdr(pad(name("Subject")), pad(F.col("subject"))),
        F.when(m(10) == 3, hdr(F.lit("Subject"), F.lit("Duplicate subject"))),
        F.when(m(5) != 3, hdr(name("Date"), date_v)),
        hdr(F.lit("Message-ID"), F.concat(F.lit("<"), d.cast("string"), F.lit("@example.com>"))),
        F.when(m(8) == 3, hdr(F.lit("Cc"), F.lit("Ann Lee <ann@example.com>, bob@example.com"))),
        F.when(F.col("h_reply_to").isNotNull(), hdr(F.lit("Reply-To"), F.col("h_reply_to"))),
        F.when(F.col("h_list_unsubscribe").isNotNull(), hdr(name("List-Unsubscribe"), F.col("h_list_unsubscribe"))),
        F.when(F.col("h_precedence").isNotNull(), hdr(F.lit("Precedence"), F.col("h_precedence"))),
        F.when(F.col("h_auto_submitted").isNotNull(), hdr(F.lit("Auto-Submitted"), F.col("h_auto_submitted"))))
    hjson = F.to_json(F.filter(headers, lambda h: h.isNotNull() & h["value"].isNotNull()))
    # one header without its value (contract violation)
    return F.when(m(97) == 44, F.regexp_replace(hjson, r',"value":"<[0-9]+@example\.com>"', "")).otherwise(hjson)
