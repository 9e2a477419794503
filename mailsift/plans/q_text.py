"""Text-function queries (T1-T11, T13) over whole texts of the driver
tables and of the mail view."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import context as C
from mailsift.functions import patterns as P
from mailsift.functions import text as T
from mailsift.plans import sqlgen as S
from mailsift.plans.fixtures import table, with_mail
from mailsift.plans.registry import gated, messages, register, spread


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


@register("t01_html_to_text_markup", f"select page_id, {S.normalize_ws(S.strip_tags('html'))} as text from pages")
def t01_html_to_text_markup(spark, sf_dir):
    """T1 without the entity step (SQL-checkable)."""
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select("page_id", T.html_to_text("html", decode_entities=False).alias("text"))


_QUOTED = ["<p title=\"a > b\" data-u='c>d' hidden>", "<br alt=\"x>y\"/>it's <i class = '>'>5 = \"five\"</i>"]


@register("t01_quoted_attributes", "select page_id, " + S.normalize_ws(S.strip_tags(
    f"{S.lit(_QUOTED[0])} || html || {S.lit(_QUOTED[1])}")) + " as text from pages")
def t01_quoted_attributes(spark, sf_dir):
    """T1 with tags whose attribute values hold ``>``."""
    pages = spread(table(spark, sf_dir, "pages"))
    html = F.concat(F.lit(_QUOTED[0]), F.col("html"), F.lit(_QUOTED[1]))
    return pages.select("page_id", T.html_to_text(html, decode_entities=False).alias("text"))


# Oracle for the full T1: the driver's pages contain only these four named
# entities, with or without the closing semicolon (legacy names are decoded
# without it, e.g. a title cut after "&amp"); ``&amp`` is decoded last so
# nothing is decoded twice. The Spark side uses the standard library's
# complete decoder.
_ENT = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&quot;?', '\"', 'g'), '&middot;?', "
        "chr(183), 'g'), '&copy;?', chr(169), 'g'), '&amp;?', '&', 'g')")


@register("t01_html_to_text", f"select page_id, {S.normalize_ws(_ENT.format(S.strip_tags('html')))} as text from pages")
def t01_html_to_text(spark, sf_dir):
    """T1 in full: entities decoded (Arrow-batched, only rows with '&')."""
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select("page_id", T.html_to_text("html").alias("text"))


@register("t02_normalize_whitespace", f"select doc_id, {S.normalize_ws('text')} as text from documents")
def t02_normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_whitespace("text").alias("text"))


@register("t03_links", with_mail(f"select message_id, {S.join(S.links('body_text'))} as links, "
                                 f"len({S.links('body_text')}) as n_links from mail"))
def t03_links(spark, sf_dir):
    links = T.extract_links("body_text")
    return messages(spark, sf_dir).select("message_id", F.array_join(links, "|").alias("links"),
                                          F.size(links).alias("n_links"))


@register("t04_money", with_mail(f"select message_id, {S.join(S.money('body_text'))} as money from mail"))
def t04_money(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", F.array_join(T.extract_money("body_text"), "|").alias("money"))


@register("t05_time_phrases", f"select doc_id, {S.join(S.time_phrases('text'))} as time_phrases from documents")
def t05_time_phrases(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.extract_time_phrases("text"), "|")
                                       .alias("time_phrases"))


@register("t05_time_phrases_mail", with_mail(
    f"select message_id, {S.join(S.time_phrases('body_text'))} as time_phrases from mail"))
def t05_time_phrases_mail(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", F.array_join(T.extract_time_phrases("body_text"), "|")
                                          .alias("time_phrases"))


@register("t06_unsubscribe_flag", with_mail(
    f"select message_id, {S.find('body_text', P.UNSUBSCRIBE_RE)} as has_unsubscribe from mail"))
def t06_unsubscribe_flag(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", T.has_unsubscribe("body_text").alias("has_unsubscribe"))


@register("t07_body_cap", f"select doc_id, {S.cap(S.strip('text'), 12000, P.TRUNCATED_SUFFIX)} as body, "
                          f"length(text) > 12000 as truncated from documents")
def t07_body_cap(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.cap_body(T.py_strip("text"), 12000).alias("body"),
                                       (F.length("text") > 12000).alias("truncated"))


_PARTY_SQL = ("concat_ws(', ', case when coalesce(length(from_name), 0) > 0 then from_name || ' <' || from_email "
              "|| '>' else from_email end, case when contains(h_to, '@') then h_to end)")


@register("t08_party_line", with_mail(f"select message_id, {_PARTY_SQL} as parties from mail"))
def t08_party_line(spark, sf_dir):
    m = messages(spark, sf_dir)
    parties = F.concat(F.array(F.struct(F.col("from_name").alias("name"), F.col("from_email").alias("email"))),
                       F.transform("to", lambda a: F.struct(F.lit(None).cast("string").alias("name"),
                                                            a.alias("email"))))
    return m.select("message_id", T.party_line(parties).alias("parties"))


_THREAD_SQL = (
    "with ranked as (select conv_id, turn, 'From: ' || coalesce(role, '') || ' | Subject: ' || chr(10) || "
    f"{S.normalize_ws(S.strip("coalesce(text, '')"))} as chunk, "
    "row_number() over (partition by conv_id order by turn desc) as rn from conversations), "
    "agg as (select conv_id, string_agg(chunk, " + S.lit(P.THREAD_SEPARATOR) + " order by turn) as t "
    "from ranked where rn <= 5 group by conv_id) "
    f"select conv_id, {S.cap('t', 12000, P.LEGACY_TRUNCATED_SUFFIX)} as thread_text from agg")


@register("t09_thread_context", _THREAD_SQL)
def t09_thread_context(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("order_key"), F.col("role").alias("sender"),
        F.lit("").alias("subject"), F.col("text").alias("body_text"))
    return C.thread_context(conv, thread="conv_id")


def _t10_sql() -> str:
    b = S.cap(S.strip("coalesce(body_text, '')"), 12000, P.LEGACY_TRUNCATED_SUFFIX)
    sect = lambda title, arr: (f"case when len({arr}) > 0 then {S.lit(chr(10) * 2 + title + chr(10))} || "  # noqa
                               f"array_to_string({arr}, chr(10)) else '' end")
    frm = ("case when coalesce(length(from_name), 0) > 0 then from_name || ' <' || from_email || '>' "
           "else from_email end")
    doc = (f"'EMAIL_ID: ' || message_id || chr(10) || 'THREAD_ID: ' || coalesce(thread_id, '') || chr(10) || "
           f"'SUBJECT: ' || {S.strip('subject')} || chr(10) || 'FROM: ' || {frm} || chr(10) || "
           f"'TO: ' || case when contains(h_to, '@') then h_to else '' end || chr(10) || 'CC: ' || chr(10) || "
           f"chr(10) || 'BODY:' || chr(10) || b || {sect('LINKS_DETECTED:', S.links('b'))} || "
           f"{sect('MONEY_STRINGS_DETECTED:', S.money('b'))} || {sect('TIME_PHRASES_DETECTED:', S.time_phrases('b'))}"
           f" || case when {S.find('b', P.UNSUBSCRIBE_RE)} then {S.lit(chr(10) * 2 + 'UNSUBSCRIBE_SIGNAL_DETECTED: true')}"
           f" else '' end")
    return with_mail(f"select message_id, {S.strip(doc)} as context from (select *, {b} as b from mail)")


@register("t10_plain_context", _t10_sql())
def t10_plain_context(spark, sf_dir):
    m = messages(spark, sf_dir)
    party = lambda n, e: F.array(F.struct(F.col(n).alias("name"), F.col(e).alias("email")))
    m = m.select("*", party("from_name", "from_email").alias("from_parties"),
                 F.transform("to", lambda a: F.struct(F.lit(None).cast("string").alias("name"),
                                                      a.alias("email"))).alias("to_parties"),
                 F.array().cast("array<struct<name:string,email:string>>").alias("cc_parties"))
    return m.select("message_id", C.plain_context().alias("context"))


def _t11_sql() -> str:
    b = S.cap(S.strip("coalesce(body_text, '')"), 12000, P.TRUNCATED_SUFFIX)
    links = f"{S.links(f'coalesce(nullif(body_html, {chr(39) * 2}), b)')}[1:10]"
    base = ("'provider': 'gmail', 'messageId': message_id, 'threadId': thread_id, 'subject': subject, "
            "'from': {'name': from_name, 'email': from_email}, "
            "'to': case when contains(h_to, '@') then [h_to] else []::varchar[] end, 'cc': []::varchar[], "
            "'sentAt': null::varchar, 'snippet': '', 'bodyText': b")
    sig = (f"'timePhrases': {S.time_phrases('b')}, 'links': {links}, 'moneyStrings': {S.money('b')}[1:10], "
           f"'hasUnsubscribeSignal': {S.find('b', P.UNSUBSCRIBE_RE)}")
    hints = ", 'gateVerdict': 'ambiguous', 'gateScore': round(score_h / 100.0, 3), " \
            "'gateFiredSignals': string_split(fired_csv, ',')"
    return with_mail(
        f"select message_id, case when verdict = 'ambiguous' then to_json({{{base}, 'signals': {{{sig}{hints}}}}}) "
        f"else to_json({{{base}, 'signals': {{{sig}}}}}) end as context from (select *, {b} as b from gated "
        "where not skip_llm)", S.gate_ctes())


@register("t11_json_context", _t11_sql())
def t11_json_context(spark, sf_dir):
    """JSON context for every message the gate passes on (what a scorer
    receives)."""
    g = gated(spark, sf_dir).filter(~F.col("skip_llm"))
    return g.select("*", *C.context_signals()).select("message_id", C.json_context().alias("context"))


@register("t13_subject_topic", with_mail(f"select message_id, {S.subject_topic('subject')} as topic from mail"))
def t13_subject_topic(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", T.subject_topic("subject").alias("topic"))
