"""SQL (DuckDB dialect) twins of the column functions, used only to write the
oracle queries that check the Spark plans. The same fixed patterns from
``patterns.py`` are used, with RE2 flags."""

from __future__ import annotations

from mailsift.functions import patterns as P
from mailsift.functions.text import PY_SPACE

_SPACE_SQL = "||".join(f"chr({ord(c)})" for c in PY_SPACE)


def strip(e: str) -> str:
    return f"trim({e}, {_SPACE_SQL})"


def sc(e: str) -> str:
    """Python ``(x or "").strip()`` on a nullable string."""
    return strip(f"coalesce({e}, '')")


def lit(s: str) -> str:
    return P.sql_str(s)


def find(e: str, pattern: str, multiline: bool = False) -> str:
    return f"coalesce(regexp_matches({e}, {lit(P.sql_re(pattern, multiline))}), false)"


def first(e: str, pattern: str) -> str:
    return f"coalesce(regexp_extract({e}, {lit(P.sql_re(pattern))}, 0), '')"


def all_matches(e: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({e}, {lit(P.sql_re(pattern))}, 0), [])"


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def ci_distinct(lst: str) -> str:
    return (f"list_filter({lst}, lambda x, i: list_position(list_transform({lst}, lambda y: lower(y)), "
            f"lower(x)) = i)")


def join(lst: str, sep: str = "|") -> str:
    return f"array_to_string({lst}, {lit(sep)})"


def nonempty(e: str) -> str:
    return f"coalesce(length({e}) > 0, false)"


def gate_signal_sql() -> list[tuple[str, str, str]]:
    """(name, fired SQL, detail SQL) over the ``mail`` view columns."""
    text = "coalesce(body_text, '')"
    out = []
    lu = "(h_list_unsubscribe is not null)"
    out.append(("list_unsubscribe_header", lu, f"case when {lu} then substr(h_list_unsubscribe, 1, 100) else '' end"))
    prec = "lower(coalesce(h_precedence, ''))"
    out.append(("precedence_bulk", f"({prec} in ('bulk', 'list', 'junk'))", prec))
    auto = "lower(coalesce(h_auto_submitted, ''))"
    out.append(("auto_submitted", f"({auto} <> '' and {auto} <> 'no')", auto))
    for name, pat in (("noreply_sender", P.NOREPLY_RE), ("marketing_sender", P.MARKETING_SENDER_RE)):
        f = f"({nonempty('from_email')} and {find('from_email', pat)})"
        out.append((name, f, f"case when {f} then from_email else '' end"))
    f = f"({nonempty('from_name')} and {find('from_name', P.BULK_SENDER_NAME_RE)})"
    out.append(("bulk_sender_name", f, f"case when {f} then from_name else '' end"))
    rt = f"lower({strip("coalesce(h_reply_to, '')")})"
    fl = f"lower({strip("coalesce(from_email, '')")})"
    f = f"(length({rt}) > 0 and length({fl}) > 0 and {rt} <> {fl} and instr({rt}, {fl}) = 0)"
    out.append(("reply_to_mismatch", f, f"case when {f} then 'from=' || {fl} || ' reply-to=' || {rt} else '' end"))
    to_v = f"lower({strip("coalesce(h_to, '')")})"
    f = f"(length({to_v}) = 0 or contains({to_v}, 'undisclosed'))"
    out.append(("bcc_recipient", f, f"case when {f} then substr({to_v}, 1, 80) else '' end"))
    for name, pat, cap in (("unsubscribe_body", P.UNSUBSCRIBE_BODY_RE, None),
                           ("view_in_browser", P.VIEW_IN_BROWSER_RE, None),
                           ("footer_pattern", P.FOOTER_RE, 80)):
        f = find(text, pat)
        d = strip(first(text, pat))
        if cap:
            d = f"substr({d}, 1, {cap})"
        out.append((name, f, f"case when {f} then {d} else '' end"))
    out.append(("tracking_pixels", f"({nonempty('body_html')} and {find('body_html', P.TRACKING_PIXEL_RE)})", "''"))
    out.append(("utm_params", find(f"coalesce(body_html, '') || ' ' || {text}", P.UTM_RE), "''"))
    tl, hl = f"length({strip(text)})", f"length({strip("coalesce(body_html, '')")})"
    f = f"({nonempty('body_html')} and {hl} > 500 and ({tl} = 0 or {hl} > greatest({tl}, 1) * 5))"
    out.append(("high_html_ratio", f, f"case when {f} then 'text=' || {tl} || ' html=' || {hl} else '' end"))
    out.append(("personal_reply", f"(starts_with(lower(coalesce(subject, '')), 're:') and "
                                  f"{find(f'substr({text}, 1, 500)', P.PERSONAL_REPLY_RE, True)})", "''"))
    out.append(("direct_questions", find(f"substr({text}, 1, 1000)", P.QUESTION_RE), "''"))
    return out


def gate_ctes(source: str = "mail") -> str:
    """CTEs ``gsig`` (flags f_i, details d_i) and ``gate`` (score, verdict,
    fired names, evidence, sub-action) over ``source``."""
    sigs = gate_signal_sql()
    cols = ", ".join(f"{f} as f{i}, {d} as d{i}" for i, (_, f, d) in enumerate(sigs))
    score = " + ".join(f"(case when f{i} then {w} else 0 end)" for i, (_, w) in enumerate(P.SIGNALS))
    fired = "concat_ws(',', " + ", ".join(
        f"case when f{i} then '{n}' end" for i, (n, _) in enumerate(P.SIGNALS)) + ")"
    ev = "[" + ", ".join(f"case when f{i} and d{i} <> '' then '[{n}] ' || d{i} end"
                         for i, (n, _) in enumerate(P.SIGNALS)) + "]"
    news = " or ".join(f"contains(lower(coalesce(body_text, '')), {lit(t)})" for t in P.NEWSLETTER_TERMS)
    spam_key = (f"case when {news} then 'SPAM_NEWSLETTER' when {find('body_text', P.UNSUBSCRIBE_BODY_RE)} "
                f"then 'SPAM_UNSUBSCRIBE' else 'SPAM_MARKETING' end")
    return (f"gsig as (select *, {cols} from {source}), "
            f"gate as (select *, least(greatest({score}, 0), 100) as score_h, {fired} as fired_csv, "
            f"list_filter({ev}, lambda x: x is not null)[1:3] as gate_evidence, {spam_key} as spam_key from gsig), "
            f"gated as (select *, case when score_h >= 70 then 'spam' when score_h <= 20 then 'not_spam' "
            f"else 'ambiguous' end as verdict, score_h >= 70 as skip_llm, "
            f"case when score_h >= 70 then spam_key else 'SPAM_MARKETING' end as sub_action_key from gate)")


def normalize_ws(e: str) -> str:
    s = f"regexp_replace({e}, '\\r\\n|\\r', chr(10), 'g')"
    s = f"regexp_replace({s}, '[\\t\\x0B\\f]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    s = f"regexp_replace({s}, '[ ' || chr(160) || ']{{2,}}', ' ', 'g')"
    return strip(s)


#: The inside of a tag with quoted attribute values, in a SQL string.
_IN_TAG = r"""(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*""".replace("'", "''")


def strip_tags(e: str) -> str:
    s = f"regexp_replace({e}, '(?s)<!--.*?-->|<!(?i:doctype)[^>]*>', '', 'g')"
    for tag in ("script", "style", "noscript"):
        s = f"regexp_replace({s}, '(?is)<{tag}\\b{_IN_TAG}>.*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace({s}, '(?:<{_IN_TAG}>)+', chr(10), 'g')"


def cap(e: str, n: int, suffix: str) -> str:
    return f"case when length({e}) > {n} then substr({e}, 1, {n}) || {lit(suffix)} else {e} end"


def links(e: str) -> str:
    return ordered_distinct(all_matches(e, P.URL_RE))


def money(e: str) -> str:
    return ordered_distinct(f"list_transform({all_matches(e, P.MONEY_RE)}, lambda m: {strip('m')})")


def time_phrases(e: str, limit: int = P.TIME_PHRASE_LIMIT) -> str:
    found = f"list_transform({all_matches(e, P.TIME_PHRASE_RE)}, lambda m: {strip('m')})"
    return f"{ci_distinct(found)}[1:{limit}]"


def subject_topic(e: str) -> str:
    pat = lit(r"(?i)^(?:\s*(?:re|fwd|fw)\s*:\s*)+")
    return strip(f"regexp_replace({sc(e)}, {pat}, '')")


# ------------------------------------------------------------------ dates
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
           "october", "november", "december"]


def infer_ctes(src: str, text: str, base: str, p: str) -> tuple[str, str]:
    """CTE chain computing the deadline inference for every row of ``src``
    (``text`` = phrase column, ``base`` = naive UTC base timestamp, offset 0).
    Returns (ctes, name of the last CTE); the last CTE adds columns
    ``{p}_iso``, ``{p}_date_iso``, ``{p}_zone``, ``{p}_has_time``."""
    low = f"lower(coalesce({text}, ''))"
    zone = "case " + " ".join(f"when regexp_matches({low}, {lit(chr(92) + 'b' + a + chr(92) + 'b')}) then '{z}'"
                              for a, z in P.ZONE_WORDS) + " else 'UTC' end"
    c1 = f"{p}1 as (select *, {zone} as {p}_zone, {low} as {p}_low, {strip(low)} as {p}_lows from {src})"
    ls = f"{p}_lows"
    t12, t24 = lit(P.TIME_12H_RE), lit(P.TIME_24H_RE)
    h12r = f"try_cast(nullif(regexp_extract({ls}, {t12}, 1), '') as integer)"
    ap = f"regexp_extract({ls}, {t12}, 3)"
    c2 = (f"{p}2 as (select *, timezone({p}_zone, {base} AT TIME ZONE 'UTC') as {p}_bl, "
          f"regexp_matches({ls}, {t12}) as {p}_has12, "
          f"case when {ap} = 'am' then (case when {h12r} = 12 then 0 else {h12r} end) "
          f"else (case when {h12r} = 12 then 12 else {h12r} + 12 end) end as {p}_h12, "
          f"coalesce(try_cast(nullif(regexp_extract({ls}, {t12}, 2), '') as integer), 0) as {p}_m12, "
          f"regexp_extract({ls}, {t12}, 2) <> '' as {p}_m12g, "
          f"try_cast(nullif(regexp_extract({ls}, {t24}, 1), '') as integer) as {p}_h24, "
          f"try_cast(nullif(regexp_extract({ls}, {t24}, 2), '') as integer) as {p}_m24, "
          f"regexp_matches({ls}, {t24}) as {p}_any24, "
          f"case when contains({p}_low, 'noon') then 12 when contains({p}_low, 'midnight') then 0 "
          f"when contains({p}_low, 'eod') or contains({p}_low, 'end of day') then 17 end as {p}_fixed, "
          "case " + " ".join(f"when regexp_matches({ls}, {lit(chr(92) + 'b' + d + chr(92) + 'b')}) then {i}"
                             for i, d in enumerate(P.WEEKDAYS)) + f" end as {p}_target from {p}1)")
    ok24 = f"({p}_any24 and {p}_h24 between 0 and 23 and {p}_m24 between 0 and 59)"
    bad = f"({p}_fixed is null and {p}_has12 and ({p}_h12 > 23 or {p}_m12 > 59))"
    d0 = f"((({p}_target - (isodow({p}_bl) - 1)) % 7 + 7) % 7)"
    delta = (f"(case when {d0} = 0 then 7 else {d0} end + case when regexp_matches({ls}, {lit(chr(92) + 'bnext' + chr(92) + 'b')}) "
             f"then 7 else 0 end)")
    mon_re = lit(r"\b(" + "|".join(_MONTHS) + r")\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?\b")
    mon_idx = ("list_position([" + ", ".join(f"'{m}'" for m in _MONTHS) + f"], regexp_extract({ls}, {mon_re}, 1))")
    iso_m = f"nullif(regexp_extract({ls}, {lit(r'(\d{4})-(\d{2})-(\d{2})')}, 0), '')"
    mon_day = (f"try_cast(make_date(coalesce(try_cast(nullif(regexp_extract({ls}, {mon_re}, 3), '') as integer), "
               f"year({p}_bl)), {mon_idx}, try_cast(regexp_extract({ls}, {mon_re}, 2) as integer)) as date)")
    c3 = (f"{p}3 as (select *, case when contains({ls}, 'today') then {p}_bl::date "
          f"when contains({ls}, 'tomorrow') then {p}_bl::date + 1 "
          f"when {p}_target is not null then {p}_bl::date + cast({delta} as integer) end as {p}_rel, "
          f"coalesce(try_cast({iso_m} as date), case when {mon_idx} > 0 then {mon_day} end) as {p}_abs, "
          f"{bad} as {p}_bad, {ok24} as {p}_ok24, "
          f"case when {bad} then null else coalesce({p}_fixed, case when {p}_has12 then {p}_h12 end, "
          f"case when {ok24} then {p}_h24 end) end as {p}_hour, "
          f"case when {bad} then null when {p}_fixed is not null then 0 when {p}_has12 then {p}_m12 "
          f"when {ok24} then {p}_m24 end as {p}_minute, "
          f"coalesce(length({strip(text)}) = 0, true) as {p}_empty from {p}2)")
    a_hour = f"case when {p}_has12 then {p}_h12 when {p}_ok24 then {p}_h24 else hour({p}_bl) end"
    a_min = (f"case when {p}_has12 and {p}_m12g then {p}_m12 when {p}_has12 then minute({p}_bl) "
             f"when {p}_ok24 then {p}_m24 else minute({p}_bl) end")
    a_sec = f"(second({p}_bl) + (epoch_us({p}_bl) % 1000000) / 1000000.0)"
    c4 = (f"{p}4 as (select *, case when {p}_empty or {p}_bad then null when {p}_rel is not null then "
          f"make_timestamp(year({p}_rel), month({p}_rel), day({p}_rel), coalesce({p}_hour, 0), "
          f"coalesce({p}_minute, 0), 0) when {p}_abs is not null and {a_hour} between 0 and 23 then "
          f"make_timestamp(year({p}_abs), month({p}_abs), day({p}_abs), {a_hour}, {a_min}, {a_sec}) end "
          f"as {p}_wall from {p}3)")
    c5 = f"{p}5 as (select *, timezone('UTC', {p}_wall AT TIME ZONE {p}_zone) as {p}_inst from {p}4)"
    secs = f"cast(epoch({p}_wall) - epoch({p}_inst) as bigint)"
    frac = f"(epoch_us({p}_wall) % 1000000)"
    iso = (f"strftime({p}_wall, '%Y-%m-%dT%H:%M:%S') || case when {frac} <> 0 then '.' || lpad(cast({frac} as varchar), "
           f"6, '0') else '' end || case when {secs} < 0 then '-' else '+' end || "
           f"lpad(cast(abs({secs}) // 3600 as varchar), 2, '0') || ':' || "
           f"lpad(cast((abs({secs}) % 3600) // 60 as varchar), 2, '0')")
    c6 = (f"{p}6 as (select *, case when {p}_wall is not null then {iso} end as {p}_iso, "
          f"strftime({p}_wall, '%Y-%m-%d') as {p}_date_iso, "
          f"case when {p}_wall is not null then {p}_zone end as {p}_zone_name, "
          f"(({p}_hour is not null) or {p}_bad or {p}_any24) as {p}_has_time from {p}5)")
    return ", ".join([c1, c2, c3, c4, c5, c6]), f"{p}6"


# ------------------------------------------------------------ model ingest + repair
_SPEC = ('{"major_category":"VARCHAR","sub_action_key":"VARCHAR","explicit_task":"BOOLEAN","confidence":"DOUBLE",'
         '"suggested_reply_action":["VARCHAR"],"task_proposal":{"type":"VARCHAR","title":"VARCHAR",'
         '"description":"VARCHAR","priority":"VARCHAR","status":"VARCHAR","scheduled_for":"VARCHAR",'
         '"due_at":"VARCHAR","waiting_on":"VARCHAR"},"recommended_actions":[{"key":"VARCHAR","label":"VARCHAR",'
         '"kind":"VARCHAR","rank":"INTEGER"}],"urgency_signals":{"urgency":"VARCHAR","deadline_detected":"BOOLEAN",'
         '"deadline_text":"VARCHAR","reply_by":"VARCHAR","reason":"VARCHAR"},"extracted_summary":{"ask":"VARCHAR",'
         '"success_criteria":"VARCHAR","missing_info":["VARCHAR"]},"entities":{"people":[{"email":"VARCHAR",'
         '"role":"VARCHAR"}],"dates":[{"text":"VARCHAR","iso":"VARCHAR","type":"VARCHAR"}],'
         '"money":[{"text":"VARCHAR","amount":"DOUBLE","currency":"VARCHAR"}],'
         '"docs":[{"title":"VARCHAR","url":"VARCHAR","type":"VARCHAR"}],'
         '"meeting":{"topic":"VARCHAR","start_at":"VARCHAR","tz":"VARCHAR"}},"evidence":["VARCHAR"]}')
_FENCE = r"(?s)^```(?:json)?\s*\n?(.*?)\n?\s*```$"


def fence_strip(e: str) -> str:
    s = strip(f"coalesce({e}, '')")
    return f"case when regexp_matches({s}, {lit(_FENCE)}) then {strip(f'regexp_extract({s}, {lit(_FENCE)}, 1)')} else {s} end"


def nb(e: str) -> str:
    """Non-blank."""
    return f"coalesce(length({strip(e)}) > 0, false)"


def key_norm(e: str) -> str:
    s = f"regexp_replace({strip(e)}, '[^A-Za-z0-9]+', '_', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"coalesce(upper(nullif({s}, '')), 'OTHER')"


def evidence_clean(lst: str) -> str:
    a = f"list_filter(list_transform(coalesce({lst}, []), lambda e: {strip('e')}), lambda e: coalesce(length(e), 0) > 0)"
    a = f"list_transform({a}, lambda e: substr(regexp_replace(e, '\\s+', ' ', 'g'), 1, 240))"
    return f"{ci_distinct(a)}[1:3]"


def model_ctes(source: str = "mail", pre: str = "") -> str:
    """CTEs over ``mail``: model_output, gate (over ``source``, which
    ``pre`` may define), parse, contract, R1-R7."""
    from mailsift.plans.fixtures import MODEL_OUTPUT_SQL
    cats = ", ".join(f"'{c}'" for c in P.CATEGORIES)
    rules = [
        "case when not parse_ok then 'invalid_json' end",
        "case when parse_ok and major_category is null then 'major_category: missing' end",
        f"case when major_category is not null and major_category not in ({cats}) then 'major_category: not in domain' end",
        "case when parse_ok and sub_action_key is null then 'sub_action_key: missing' end",
        "case when parse_ok and explicit_task is null then 'explicit_task: missing' end",
        "case when parse_ok and confidence is null then 'confidence: missing' end",
        "case when confidence is not null and (confidence < 0 or confidence > 1) then 'confidence: out of range' end",
        "case when len(list_filter(recommended_actions, lambda a: a.key is null or a.label is null)) > 0 "
        "then 'recommended_actions: key/label missing' end",
        "case when len(list_filter(coalesce(e.people, []), lambda x: x.email is null or x.role is null)) > 0 "
        "then 'entities.people: email/role missing' end",
        "case when len(list_filter(coalesce(e.dates, []), lambda x: x.text is null)) > 0 "
        "then 'entities.dates: text missing' end",
    ]
    spam = "(major_category = 'spam')"
    urg0 = f"case when {spam} then 'low' else coalesce(nullif(u.urgency, ''), 'medium') end"
    urg = f"lower({strip(urg0)})"
    rb_ctes, rb_last = infer_ctes("rep1", "dl_text", "epoch_ms(internal_date_ms)", "rb")
    return ", ".join([c for c in [pre] if c] + [
        MODEL_OUTPUT_SQL,
        gate_ctes(source),
        f"mo as (select *, {fence_strip('raw_text')} as txt from model_output)",
        f"pj as (select *, case when json_valid(txt) and json_type(txt) = 'OBJECT' then from_json(txt, '{_SPEC}') end as p from mo)",
        "parsed as (select message_id, raw_text, input_tokens, output_tokens, response_id, p is not null as parse_ok, "
        "p.major_category as major_category, p.sub_action_key as sub_action_key, p.explicit_task as explicit_task, "
        "p.confidence as confidence, coalesce(p.suggested_reply_action, []) as suggested_reply_action, "
        "p.task_proposal as task_proposal, coalesce(p.recommended_actions, []) as recommended_actions, "
        "p.urgency_signals as u, p.extracted_summary as s, p.entities as e, coalesce(p.evidence, []) as evidence "
        "from pj)",
        "viol as (select *, list_filter([" + ", ".join(rules) + "], lambda x: x is not null) as violations from parsed)",
        "rest as (select * from gated where not skip_llm)",
        "joined as (select r.message_id as message_id, r.doc_id, r.thread_id, r.subject, r.from_email, r.internal_date_ms, "
        "r.verdict, r.score_h, r.fired_csv, v.* exclude (message_id) from rest r join viol v on r.message_id = v.message_id)",
        "valid as (select * from joined where len(violations) = 0)",
        f"rep1 as (select *, coalesce(least(greatest(confidence, 0.0), 1.0), 0.0) as conf_c, "
        f"{key_norm('sub_action_key')} as key_n, {spam} as is_spam, "
        f"case when {spam} then null else u.deadline_text end as dl_text, "
        f"case when {spam} then null else u.reply_by end as reply_by0, "
        f"{sc(f'case when {spam} then {lit(P.SPAM_REASON_MODEL)} else u.reason end')} as reason_c, "
        f"case when {urg} in ('low', 'medium', 'high', 'critical') then {urg} else 'medium' end as urgency_c, "
        f"case when {spam} then false else explicit_task end as explicit_c, "
        f"case when {spam} then [] else suggested_reply_action end as replies_c, "
        f"case when {spam} then null else task_proposal end as task0, "
        f"{evidence_clean('evidence')} as evidence_c from valid)",
        rb_ctes,
        f"repaired as (select *, case when {nb('dl_text')} and not {nb('reply_by0')} and rb_iso is not null "
        f"then rb_iso else reply_by0 end as reply_by_c from {rb_last})",
    ])
