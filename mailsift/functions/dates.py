"""Deadline and date inference (R8-R11) as staged Column expressions.

Wall-clock arithmetic runs on local time: ``from_utc_timestamp`` gives the
wall clock in the zone, days are added to the local date, and
``to_utc_timestamp`` maps the new wall clock back with the zone's own DST
rules (12:00 local stays 12:00 across a change). Requires the session time
zone to be UTC (set by ``get_spark``).

The inference is split into stages over one struct so that each stage reads
the previous stage's fields instead of re-inlining its expressions:
``infer_columns`` for a scalar column and ``infer_array`` inside
``transform`` for arrays of date texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions.text import py_strip

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
          r"|nov(?:ember)?|dec(?:ember)?)")
_ZONE_RE = r"\b(" + "|".join(a for a, _ in P.ZONE_WORDS) + r")\b"
_DAY_RE = r"\b(" + "|".join(P.WEEKDAYS) + r")\b"
_MON_RE = r"\b" + _MONTH + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?\b(?:,?\s+(\d{4})\b)?"
_DAY_MON_RE = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?" + _MONTH + r"\b\.?(?:,?\s+(\d{4})\b)?"
_ORDINAL_RE = r"\b(\d{1,2})(?:st|nd|rd|th)\b"
_MONTH_ALONE_RE = r"\b" + _MONTH + r"\b\.?(?:,?\s+(\d{4})\b)?"
_SLASH_RE = r"\b(\d{1,2})/(\d{1,2})(?:/(\d{4}|\d{2}))?\b"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def offset_zone_id(offset_min) -> Column:
    """Fixed-offset zone id like ``+05:30`` from offset minutes."""
    o = F.coalesce(_c(offset_min), F.lit(0))
    a = F.abs(o)
    return F.concat(F.when(o < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.floor(a / 60).cast("string"), 2, "0"),
                    F.lit(":"), F.lpad((a % 60).cast("string"), 2, "0"))


def _first_in_table(lower: Column, pattern: str, table: list[tuple[str, object]]) -> Column:
    """Value of the first table entry (in table order) whose word is found;
    null when none is. A ``when`` chain over ``array_contains``: no nested
    lambda and no ``element_at`` with a null index, both of which misbehave
    inside ``transform`` (used for date arrays)."""
    found = F.regexp_extract_all(lower, F.lit(pattern), F.lit(1))
    out = None
    for word, value in table:
        c = F.array_contains(found, F.lit(word))
        out = F.when(c, F.lit(value)) if out is None else out.when(c, F.lit(value))
    return out


def zone_stage(text, base_ts, base_offset_min) -> Column:
    """Zone by first zone word in table order, else by the base offset
    table, else the base offset with no name."""
    t = _c(text)
    lower = F.lower(F.coalesce(t, F.lit("")))
    off = F.coalesce(_c(base_offset_min), F.lit(0))
    by_word = _first_in_table(lower, _ZONE_RE, P.ZONE_WORDS)
    by_off = None
    for hours, iana in P.OFFSET_ZONES:
        c = off == hours * 60
        by_off = F.when(c, F.lit(iana)) if by_off is None else by_off.when(c, F.lit(iana))
    name = F.coalesce(by_word, by_off)
    return F.struct(t.alias("text"), lower.alias("lower"), _c(base_ts).alias("base_ts"),
                    F.coalesce(name, offset_zone_id(off)).alias("zone"), name.alias("zone_name"))


def _clock(lower: Column) -> list[Column]:
    h12 = F.regexp_extract(lower, P.TIME_12H_RE, 1).try_cast("int")
    m12s = F.regexp_extract(lower, P.TIME_12H_RE, 2)
    ap = F.regexp_extract(lower, P.TIME_12H_RE, 3)
    h24 = F.regexp_extract(lower, P.TIME_24H_RE, 1).try_cast("int")
    m24 = F.regexp_extract(lower, P.TIME_24H_RE, 2).try_cast("int")
    return [lower.rlike(P.TIME_12H_RE).alias("has12"),
            F.when(ap == "am", F.when(h12 == 12, F.lit(0)).otherwise(h12))
             .otherwise(F.when(h12 == 12, h12).otherwise(h12 + 12)).alias("h12"),
            F.coalesce(m12s.try_cast("int"), F.lit(0)).alias("m12"),
            (m12s != "").alias("m12_given"),
            (lower.rlike(P.TIME_24H_RE) & h24.between(0, 23) & m24.between(0, 59)).alias("ok24"),
            h24.alias("h24"), m24.alias("m24"), lower.rlike(P.TIME_24H_RE).alias("any24"),
            F.when(lower.contains("noon"), F.lit(12)).when(lower.contains("midnight"), F.lit(0))
             .when(lower.contains("eod") | lower.contains("end of day"), F.lit(17)).alias("fixed")]


def clock_stage(x: Column) -> Column:
    """Time pieces and the base wall clock."""
    lower = x["lower"]
    base_local = F.from_utc_timestamp(x["base_ts"], x["zone"])
    return F.struct(x["text"].alias("text"), py_strip(lower).alias("lower"), x["zone"].alias("zone"),
                    x["zone_name"].alias("zone_name"), base_local.alias("base_local"), *_clock(lower))


def time_fields(x: Column) -> tuple[Column, Column, Column]:
    """R10 from clock pieces: (hour, minute, bad_time). noon / midnight /
    eod as substrings, then a 12-hour form, then an in-range 24-hour form;
    an out-of-range 12-hour value gives null and ``bad_time``."""
    hour = F.coalesce(x["fixed"], F.when(x["has12"], x["h12"]), F.when(x["ok24"], x["h24"]))
    minute = F.when(x["fixed"].isNotNull(), F.lit(0)).when(x["has12"], x["m12"]).when(x["ok24"], x["m24"])
    bad = x["fixed"].isNull() & x["has12"] & ((x["h12"] > 23) | (x["m12"] > 59))
    return F.when(~bad, hour), F.when(~bad, minute), bad


def time_of_day(text) -> tuple[Column, Column, Column]:
    """R10 on a text column."""
    x = F.struct(*_clock(F.lower(F.coalesce(_c(text), F.lit("")))))
    return time_fields(x)


def day_stage(x: Column) -> Column:
    """R9 day (today / tomorrow / Monday-first weekday scan, +7 for next) and
    the R11 absolute date forms."""
    lower, bl = x["lower"], x["base_local"]
    bdate = F.to_date(bl)
    target = _first_in_table(lower, _DAY_RE, [(d, i) for i, d in enumerate(P.WEEKDAYS)])
    delta = F.pmod(target - F.pmod(F.dayofweek(bl) + 5, 7), 7)
    delta = F.when(delta == 0, F.lit(7)).otherwise(delta) + F.when(lower.rlike(r"\bnext\b"), F.lit(7)).otherwise(0)
    rel_day = (F.when(lower.contains("today"), bdate).when(lower.contains("tomorrow"), F.date_add(bdate, 1))
               .when(target.isNotNull(), F.date_add(bdate, delta)))
    iso_m = F.regexp_extract(lower, r"(\d{4})-(\d{2})-(\d{2})", 0)
    def written(pattern, month, day):
        """Date of a form whose groups are the month, the day and, last, the year."""
        m = F.substring(F.regexp_extract(lower, pattern, month), 1, 3)
        index = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in _MONTHS]), m), F.lit(0)),
                           m.try_cast("int"))
        year = F.nullif(F.regexp_extract(lower, pattern, 3), F.lit("")).try_cast("int")
        year = F.when(year < 100, year + 2000).otherwise(F.coalesce(year, F.year(bl)))
        return F.try_make_timestamp(year, index.cast("int"), F.regexp_extract(lower, pattern, day).try_cast("int"),
                                    F.lit(0), F.lit(0), F.lit(0)).cast("date")

    abs_day = F.coalesce(F.try_to_date(F.nullif(iso_m, F.lit("")), "yyyy-MM-dd"), written(_MON_RE, 1, 2),
                         written(_DAY_MON_RE, 2, 1), written(_SLASH_RE, 1, 2))
    # single fields, only where none of the forms above is written: the day of the
    # base month, a month (and year) with the base day or the month's last, a time
    ordinal = F.nullif(F.regexp_extract(lower, _ORDINAL_RE, 1), F.lit(""))
    month = F.array_position(F.array(*[F.lit(n) for n in _MONTHS]), F.substring(F.regexp_extract(lower, _MONTH_ALONE_RE, 1), 1, 3))
    year = F.coalesce(F.nullif(F.regexp_extract(lower, _MONTH_ALONE_RE, 2), F.lit("")).try_cast("int"), F.year(bl))
    last = F.last_day(F.make_date(year, F.greatest(month, F.lit(1)).cast("int"), F.lit(1)))
    single = (F.when(ordinal.isNotNull(), F.try_make_timestamp(F.year(bl), F.month(bl), ordinal.try_cast("int"),
                                                                F.lit(0), F.lit(0), F.lit(0)).cast("date"))
              .when(month > 0, F.date_sub(last, F.greatest(F.dayofmonth(last) - F.dayofmonth(bl), F.lit(0))))
              .when(x["has12"] | x["ok24"], bdate))
    named = lower.rlike("|".join([r"\d{4}-\d{2}-\d{2}", _MON_RE, _DAY_MON_RE, _SLASH_RE]))
    abs_day = F.when(named, abs_day).otherwise(single)
    hour, minute, bad = time_fields(x)
    return F.struct(x["text"].alias("text"), x["zone"].alias("zone"), x["zone_name"].alias("zone_name"),
                    bl.alias("base_local"), rel_day.alias("rel_day"), abs_day.alias("abs_day"),
                    hour.alias("hour"), minute.alias("minute"), bad.alias("bad"),
                    (hour.isNotNull() | bad | x["any24"]).alias("has_time"),
                    x["has12"].alias("has12"), x["h12"].alias("h12"), x["m12"].alias("m12"),
                    x["m12_given"].alias("m12_given"), x["ok24"].alias("ok24"), x["h24"].alias("h24"),
                    x["m24"].alias("m24"))


def wall_stage(x: Column) -> Column:
    """Local wall clock of the result: relative day + time (midnight when no
    time), else the absolute date with only the parsed fields set (the rest,
    seconds included, from the base wall clock)."""
    bl = x["base_local"]
    empty = F.coalesce(F.length(py_strip(x["text"])) == 0, F.lit(True))
    rel = F.make_timestamp(F.year(x["rel_day"]), F.month(x["rel_day"]), F.dayofmonth(x["rel_day"]),
                           F.coalesce(x["hour"], F.lit(0)), F.coalesce(x["minute"], F.lit(0)), F.lit(0))
    a_hour = F.when(x["has12"], x["h12"]).when(x["ok24"], x["h24"]).otherwise(F.hour(bl))
    a_min = (F.when(x["has12"] & x["m12_given"], x["m12"]).when(x["has12"], F.minute(bl))
             .when(x["ok24"], x["m24"]).otherwise(F.minute(bl)))
    b_sec = (F.second(bl) + (F.unix_micros(bl) % 1_000_000) / F.lit(1e6)).cast("decimal(8,6)")
    ab = F.try_make_timestamp(F.year(x["abs_day"]), F.month(x["abs_day"]), F.dayofmonth(x["abs_day"]),
                              a_hour, a_min, b_sec)
    wall = F.when(empty | x["bad"], F.lit(None)).when(x["rel_day"].isNotNull(), rel).otherwise(ab)
    return F.struct(wall.alias("wall"), F.to_utc_timestamp(wall, x["zone"]).alias("ts"),
                    x["zone_name"].alias("zone_name"), x["has_time"].alias("has_time"),
                    F.coalesce(x["bad"] & ~empty, F.lit(False)).alias("bad_time"), empty.alias("empty"))


def out_stage(x: Column) -> Column:
    """Final fields: instant, aware isoformat, local date, zone name, flags."""
    wall, ts = x["wall"], x["ts"]
    secs = F.unix_seconds(wall) - F.unix_seconds(ts)
    frac = F.unix_micros(wall) % 1_000_000
    off = F.concat(F.when(secs < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.lpad(F.floor(F.abs(secs) / 3600).cast("string"), 2, "0"), F.lit(":"),
                   F.lpad(F.floor((F.abs(secs) % 3600) / 60).cast("string"), 2, "0"))
    iso = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"),
                   F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(F.lit("")),
                   off)
    return F.struct(ts.alias("ts"), F.when(wall.isNotNull(), iso).alias("iso"),
                    F.date_format(wall, "yyyy-MM-dd").alias("date_iso"),
                    F.when(wall.isNotNull(), x["zone_name"]).alias("zone_name"),
                    x["has_time"].alias("has_time"), x["bad_time"].alias("bad_time"),
                    (~x["empty"] & ~x["bad_time"] & wall.isNull()).alias("unparsed"))


STAGES = [clock_stage, day_stage, wall_stage, out_stage]


def infer_columns(df, text, base_ts, base_offset_min, name: str = "_dt"):
    """Scalar form: adds struct column ``name`` with fields ts, iso,
    date_iso, zone_name, has_time, bad_time, unparsed.

    The stages run inside ``transform`` over a one-element array: a lambda
    evaluates each stage once, whereas stacked projections would be
    collapsed by the optimizer and re-inline every stage's fields at each
    use (the plan then grows with every stage)."""
    arr = infer_array(F.array(_c(text)), _c(base_ts), _c(base_offset_min))
    return df.withColumn(name, F.try_element_at(arr, F.lit(1)))


def infer_array(texts: Column, base_ts: Column, base_offset_min: Column) -> Column:
    """Array form: one result struct per text, via chained ``transform``."""
    arr = F.transform(texts, lambda t: zone_stage(t, base_ts, base_offset_min))
    for st in STAGES:
        arr = F.transform(arr, st)
    return arr


def iso_with_offset(ts, offset_min) -> Column:
    """``isoformat()`` of an instant shown in the sender's own offset (as the
    parsed Date header keeps it): wall clock in that offset, fraction only
    when non-zero, then ``+HH:MM``."""
    t = _c(ts)
    o = F.coalesce(_c(offset_min), F.lit(0))
    local = t + F.make_interval(mins=o)
    frac = F.unix_micros(t) % 1_000_000
    return F.when(t.isNotNull(), F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(F.lit("")),
        offset_zone_id(o)))
