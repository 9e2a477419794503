"""Text functions (column in, column out). All JVM-side except the HTML
entity decode, which is an Arrow-batched pandas UDF fed only rows that hold
an ``&``."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions import patterns as P

# Characters Python's str.strip() removes (str.isspace), as one trim set.
PY_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Whitespace trim with Python semantics (Spark ``trim`` only removes
    U+0020)."""
    return F.btrim(_c(x), F.lit(PY_SPACE))


def blank(x) -> Column:
    """Null or only whitespace."""
    return F.coalesce(F.length(py_strip(x)) == 0, F.lit(True))


def rx_find(x, pattern: str, multiline: bool = False) -> Column:
    """``re.search`` truth value; null input -> false."""
    return F.coalesce(_c(x).rlike(P.spark_re(pattern, multiline)), F.lit(False))


def rx_first(x, pattern: str, group: int = 0) -> Column:
    """First match (or group) or empty string."""
    return F.coalesce(F.regexp_extract(_c(x), P.spark_re(pattern), group), F.lit(""))


def rx_all(x, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(_c(x), F.lit(P.spark_re(pattern)), F.lit(0)),
                      F.array().cast("array<string>"))


def bind(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once: inside it the value is a
    lambda variable, not a copy of its expression per use or per element."""
    return F.transform(F.array(value), fn)[0]


# --------------------------------------------------------------------------- T2
# the steps and their order are fixed values
def normalize_whitespace(x) -> Column:
    s = F.regexp_replace(_c(x), r"\r\n|\r", "\n")
    s = F.regexp_replace(s, r"[\t\x0B\f]", " ")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    s = F.regexp_replace(s, "[ \u00a0]{2,}", " ")
    return py_strip(s)


# --------------------------------------------------------------------------- T1
@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: _html.unescape(v) if isinstance(v, str) else v)


#: The inside of a tag: a ``>`` within a quoted attribute value does not end it;
#: a quote that no value opens with, or that never closes, is a character.
_IN_TAG = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+"""


def strip_tags(x) -> Column:
    """Markup removal: comments/doctype, script/style/noscript with content
    (to the end of the text if never closed), then each run of tags becomes
    one newline (text nodes joined by LF).

    Linear in the text whatever it holds: a region that never ends is taken in
    one match; a tag is only looked for before the last ``>``, where each
    ``<`` has its end; repeated groups are possessive, so they loop instead of
    recursing."""
    s = F.regexp_replace(_c(x), r"(?s)<!--.*?(?:-->|\z)", "")
    s = F.regexp_replace(s, r"(?is)<(script|style|noscript)\b" + _IN_TAG + r"(?:>.*?(?:</\1\s*+>|\z)|\z)", "")
    back = F.reverse(s)
    head = F.reverse(F.regexp_replace(back, r"\A[^>]*+", ""))
    tail = F.reverse(F.regexp_extract(back, r"\A[^>]*+", 0))
    head = F.regexp_replace(head, r"(?i)<!doctype[^>]*+>", "")
    return F.concat(F.regexp_replace(head, f"(?:<{_IN_TAG}>)++", "\n"), tail)


def html_to_text(x, decode_entities: bool = True) -> Column:
    s = strip_tags(x)
    if decode_entities:
        # Only rows with '&' cross into Python; the rest travel as nulls.
        dec = _unescape(F.when(F.instr(s, "&") > 0, s))
        s = F.coalesce(dec, s)
    return normalize_whitespace(s)


# ------------------------------------------------------------------- T3 - T6
def extract_links(x) -> Column:
    return F.array_distinct(rx_all(x, P.URL_RE))


def extract_money(x) -> Column:
    return F.array_distinct(F.transform(rx_all(x, P.MONEY_RE), lambda m: py_strip(m)))


def ci_distinct(arr: Column, limit: int) -> Column:
    """Ordered distinct that compares lowercased values, keeping the first
    spelling; the first ``limit`` of them. Linear: distinct values come from a
    hash set, and only ``limit`` of them look up their place."""
    def first_spellings(a):
        return bind(F.transform(a, lambda v: F.lower(v)), lambda low: F.transform(
            F.slice(F.array_distinct(low), 1, limit), lambda d: F.element_at(a, F.array_position(low, d).cast("int"))))
    return bind(arr, first_spellings)


def extract_time_phrases(x, limit: int = P.TIME_PHRASE_LIMIT) -> Column:
    return ci_distinct(F.transform(rx_all(x, P.TIME_PHRASE_RE), lambda m: py_strip(m)), limit)


def has_unsubscribe(x) -> Column:
    return rx_find(x, P.UNSUBSCRIBE_RE)


# --------------------------------------------------------------------------- T7
def cap_body(x, max_chars: int = 12000, suffix: str = P.TRUNCATED_SUFFIX) -> Column:
    s = F.coalesce(_c(x), F.lit(""))
    return F.when(F.length(s) > max_chars, F.concat(F.substring(s, 1, max_chars), F.lit(suffix))).otherwise(s)


# --------------------------------------------------------------------------- T8
def party_line(parties) -> Column:
    """``Name <addr>`` or bare address, comma-joined (parties: array of
    struct<name,email>)."""
    return F.coalesce(F.array_join(F.transform(_c(parties), lambda p: F.when(
        F.coalesce(F.length(p["name"]), F.lit(0)) > 0,
        F.concat(p["name"], F.lit(" <"), p["email"], F.lit(">"))).otherwise(p["email"])), ", "), F.lit(""))


# -------------------------------------------------------------------------- T12
def normalize_key(x) -> Column:
    s = F.regexp_replace(py_strip(x), r"[^A-Za-z0-9]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.upper(F.nullif(s, F.lit(""))), F.lit("OTHER"))


# -------------------------------------------------------------------------- T13
def subject_topic(x) -> Column:
    s = F.regexp_replace(py_strip(F.coalesce(_c(x), F.lit(""))), r"(?i)^(?:\s*+(?:re|fwd|fw)\s*+:\s*+)++", "")
    return py_strip(s)


# -------------------------------------------------------------------------- T14
def clean_evidence(arr, limit: int = P.EVIDENCE_LIMIT, chars: int = P.EVIDENCE_CHARS) -> Column:
    a = F.coalesce(_c(arr), F.array().cast("array<string>"))
    a = F.filter(F.transform(a, lambda e: py_strip(e)), lambda e: F.coalesce(F.length(e), F.lit(0)) > 0)
    a = F.transform(a, lambda e: F.substring(F.regexp_replace(e, r"\s+", " "), 1, chars))
    return ci_distinct(a, limit)


# -------------------------------------------------------------------------- T15
def strip_fence(x) -> Column:
    """The trimmed inside of a text that opens with a fence (and the word json)
    and ends with one, else the trimmed text. Tested at the ends and cut by
    position: linear."""
    fence, word = F.lit("```"), "json"  # fixed values

    def inside(s):
        part = F.substring(s, F.lit(4), F.length(s) - 6)
        return F.when((F.length(s) >= 6) & s.startswith(fence) & s.endswith(fence), py_strip(
            F.when(part.startswith(word), F.substring(part, F.lit(len(word) + 1), F.length(part))).otherwise(part))).otherwise(s)
    return bind(py_strip(F.coalesce(_c(x), F.lit(""))), inside)


# --------------------------------------------------------------------------- P10
def collapse_snippet(x, n: int = P.SNIPPET_CHARS) -> Column:
    s = py_strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def once(df):
    """Every row as it is, its columns worked out here: ``inline`` keeps later
    filters and projections from copying their expressions."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def keep_rows(df, cond: str):
    """Row filter on a computed flag that stays above the projection
    computing it.

    A plain ``filter`` on an aliased column is rewritten by predicate
    pushdown into a copy of the alias' whole expression tree below the
    projection (the JSON parse or the regex signals would run twice, and the
    plan text grows with every nested alias). Routing each row through a
    0-or-1 element array and ``inline`` keeps one evaluation."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.inline(F.filter(F.array(row), lambda r: F.coalesce(r[cond], F.lit(False)))))
