"""Raw provider messages: source (S1), input contract (S2) and normalize
(P1-P11).

The message JSON is kept as one VARIANT column. The recursive MIME tree is
flattened inside each row, at any depth, into an array of parts in depth-first
pre-order, so normalizing a message never shuffles: the whole step is a single
map-only stage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.config import DEFAULT_CONFIG, TriageConfig
from mailsift.functions import patterns as P
from mailsift.functions.text import bind, html_to_text, keep_rows, once, py_strip
from mailsift.sources.arrays import array_elements

HEADER_TYPE = "array<struct<name:string,value:string>>"


# ------------------------------------------------------------------------- S1
def read_messages(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """(position, value) text rows; ``position`` is the dense 0-based place
    in source order (file path, then place in the file), the same on every
    run and retry.

    ``jsonl``: one message per line; files split across tasks, so this is
    the form to use at scale. ``array``: every file is one JSON array, also read
    in splits (``sources.arrays``). ``auto``: per file, a JSON array, a single
    object or JSON lines; each file is read whole, so one must fit one task."""
    if fmt == "jsonl":
        lines = placed_lines(source_lines(spark.read.text(path)))
        return with_positions(lines).select("position", "value")
    if fmt == "array":
        return with_positions(array_elements(spark, path)).select("position", "value")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.input_file_name().alias("_file"), py_strip(F.col("value")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(py_strip(x)) > 0)
    # JSON lines when the first non-blank line is an object on its own or each opens
    # one, so a malformed line costs no other; else the file is one pretty-printed object
    first = F.schema_of_variant(F.try_parse_json(F.try_element_at(lines, F.lit(1)))).startswith("OBJECT")
    is_lines = F.coalesce(first, F.lit(False)) | F.forall(lines, lambda x: py_strip(x).startswith("{"))
    array = F.transform(F.coalesce(F.try_variant_get(F.try_parse_json("t"), "$", "array<variant>"),
                                   F.array().cast("array<variant>")), lambda v: F.to_json(v))
    files = files.select("_file", F.when(F.col("t").startswith("["), array).when(is_lines, lines)
                         .otherwise(F.array("t")).alias("_values"))
    base = _before(files.select("_file", F.size("_values").alias("_n")), ["_file"], "_n")
    return files.join(base.select("_file", "_base"), "_file").select(
        "_file", "_base", F.posexplode("_values").alias("i", "value")).select(
        F.concat_ws("#", "_file", F.col("i").cast("string")).alias("source_ref"),
        (F.col("_base") + F.col("i")).alias("position"), "value")


def source_lines(lines: DataFrame) -> DataFrame:
    """The non-blank lines of a text source (batch or stream) with their file and
    the first byte of their split."""
    lines = lines.select("value", F.col("_metadata.file_path").alias("source_file"),
                         F.col("_metadata.file_block_start").alias("source_at"))
    return lines.filter(F.length(py_strip(F.col("value"))) > 0)


def placed_lines(lines: DataFrame) -> DataFrame:
    """``source_lines`` of a batch with a row number that grows within a split."""
    return lines.withColumn("source_row", F.monotonically_increasing_id())


def with_positions(placed: DataFrame) -> DataFrame:
    """``position``: dense and 0-based by file and place; ``source_ref``: file and
    line. Rows of a split are numbered one after another; splits, as many as
    there are tasks, by prefix sums, which are broadcast: the rows stay where they
    are. ``placed`` is read twice: of a written table that is two narrow columns,
    of a text source all of it."""
    splits = placed.groupBy("source_file", "source_at").agg(F.min("source_row").alias("_low"), F.count(F.lit(1)).alias("_n"))
    base = _before(splits, ["source_file", "source_at"], "_n")
    first = Window.partitionBy("source_file")
    base = base.select("source_file", "source_at", (F.col("_base") - F.col("_low")).alias("_add"),
                       F.min("_base").over(first).alias("_file_base"))
    rows = placed.join(F.broadcast(base), ["source_file", "source_at"]).withColumn("position", F.col("source_row") + F.col("_add"))
    ref = F.concat_ws("#", "source_file", (F.col("position") - F.col("_file_base")).cast("string"))
    return rows.withColumn("source_ref", ref).drop("_add", "_file_base", "source_file", "source_at", "source_row")


def _before(parts: DataFrame, order: list[str], count: str) -> DataFrame:
    """``parts`` with ``_base``, the sum of ``count`` over the parts before (one
    row per file or split: a window over that few rows in one task)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_base", F.coalesce(F.sum(count).over(w), F.lit(0)))


def parse_raw(df: DataFrame, text: str = "value") -> DataFrame:
    """S1 parse: ``raw`` VARIANT, or null with the text kept as ``corrupt``. A
    filter on them reads the parsed columns (``once``)."""
    parsed = once(df.withColumn("raw", F.try_parse_json(F.col(text))))
    return parsed.withColumn("corrupt", F.when(F.col("raw").isNull(), F.col(text)))


# ------------------------------------------------------------------- P1, P2
def header_map(headers) -> Column:
    """Keys trimmed and lowercased, empty keys dropped, first occurrence
    wins, values trimmed."""
    h = F.col(headers) if isinstance(headers, str) else headers
    kv = F.filter(F.transform(F.coalesce(h, F.array().cast(HEADER_TYPE)), lambda x: F.struct(
        F.lower(py_strip(F.coalesce(x["name"], F.lit("")))).alias("key"),
        py_strip(F.coalesce(x["value"], F.lit(""))).alias("value"))), lambda x: F.length(x["key"]) > 0)

    def firsts(a):
        """The first entry of each key, in order: entries sorted by key and place,
        those that open a run of equal keys sorted back by place."""
        opens = F.filter(a, lambda x, i: (i == 0) | (a[F.greatest(i - 1, F.lit(0))]["key"] != x["key"]))
        return F.transform(F.array_sort(F.transform(opens, lambda x: F.struct(x["i"].alias("i"), x["key"].alias("key"),
                                                                              x["value"].alias("value")))),
                           lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    placed = F.transform(kv, lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["value"].alias("value")))
    return F.map_from_entries(bind(F.array_sort(placed), firsts))


def header_lookup(headers, name: str) -> Column:
    """Case-insensitive single header value, not trimmed; null if
    absent."""
    h = F.col(headers) if isinstance(headers, str) else headers
    hit = F.filter(F.coalesce(h, F.array().cast(HEADER_TYPE)),
                   lambda x: F.lower(F.coalesce(x["name"], F.lit(""))) == name.lower())
    return F.try_element_at(hit, F.lit(1))["value"]


# ------------------------------------------------------------------------- P3
def b64url_text(data) -> Column:
    """base64url -> UTF-8 text. Characters outside the alphabet are
    dropped, padding restored, bad bytes become U+FFFD, any failure gives
    ''."""
    d = F.coalesce(F.col(data) if isinstance(data, str) else data, F.lit(""))

    def padded(x):
        std = F.replace(F.replace(x, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
        return F.rpad(std, (F.ceil(F.length(x) / 4) * 4).cast("int"), "=")

    def decoded(p):
        return F.try_to_binary(p, F.lit("base64"))

    def known_clean(x):
        """The bytes if encoding them again gives the same text, so that nothing
        was dropped; else null."""
        return bind(padded(x), lambda p: bind(decoded(p), lambda b: F.when(
            ~x.contains("+") & ~x.contains("/") & (F.base64(b) == p), b)))
    got = bind(d, lambda x: F.coalesce(known_clean(x), bind(F.regexp_replace(x, r"[^\w-]", ""), lambda c: decoded(padded(c)))))
    return F.coalesce(F.make_valid_utf8(got.cast("string")), F.lit(""))


# ------------------------------------------------------------------------- P4
LEVELS_AT_ONCE = 32
_NODES = "array<struct<path:array<int>,node:variant>>"


def _children(frontier: Column) -> Column:
    return F.flatten(F.transform(frontier, lambda x: F.transform(
        F.coalesce(F.try_variant_get(x["node"], "$.parts", "array<variant>"), F.array().cast("array<variant>")),
        lambda c, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), c.alias("node")))))


def parts_levels(raw: Column) -> Column:
    """A bound on the depth of a message's MIME tree, from the parsed message
    written out again, where a key has one spelling: each level below the root
    needs a ``"parts"`` key."""
    return F.coalesce(F.regexp_count(F.to_json(raw), F.lit(r'"parts"')), F.lit(0))


def part_nodes(raw: Column, levels: Column) -> Column:
    """(path, node) in depth-first pre-order including the root, at any
    depth.

    A (frontier, collected) state is folded once per possible level of the
    row's own tree, some levels at a time until the frontier is empty (a wide tree
    has many possible levels and few real ones); the collected nodes are sorted by index path, which is
    exactly pre-order."""
    root = F.try_variant_get(raw, "$.payload", "variant")
    level0 = F.when(root.isNotNull(), F.array(F.struct(F.array().cast("array<int>").alias("path"),
                                                       root.alias("node")))).otherwise(F.array().cast(_NODES))
    state = f"struct<f:{_NODES},acc:{_NODES}>"

    def steps(n):
        return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def level(s, _):
        return F.struct(_children(s["f"]).alias("f"), F.concat(s["acc"], s["f"]).alias("acc")).cast(state)

    def some_levels(s, _):
        return F.when(F.size(s["f"]) == 0, s).otherwise(
            F.aggregate(steps(F.least(levels, F.lit(LEVELS_AT_ONCE))), s, level)).cast(state)
    nodes = F.aggregate(
        steps(F.ceil(levels / LEVELS_AT_ONCE).cast("int")),
        F.struct(level0.alias("f"), F.array().cast(_NODES).alias("acc")).cast(state), some_levels,
        lambda s: F.concat(s["acc"], s["f"]))
    return F.array_sort(nodes, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))


def flatten_parts(raw: Column, levels: Column) -> Column:
    """The parts of ``part_nodes`` with their typed fields."""
    return part_fields(part_nodes(raw, levels))


def part_fields(nodes: Column) -> Column:
    return F.transform(nodes, lambda x: F.struct(
        x["path"].alias("path"),
        F.try_variant_get(x["node"], "$.mimeType", "string").alias("mime_type"),
        F.try_variant_get(x["node"], "$.body.data", "string").alias("data"),
        F.try_variant_get(x["node"], "$.body.attachmentId", "string").alias("attachment_id"),
        F.try_variant_get(x["node"], "$.filename", "string").alias("filename")))


# ------------------------------------------------------------------------- P5
def part_texts(parts) -> tuple[Column, Column]:
    """Decoded texts of the text/plain and text/html parts that carry data,
    in pre-order."""
    p = F.col(parts) if isinstance(parts, str) else parts

    def texts(mt):
        sel = F.filter(p, lambda x: (F.lower(F.coalesce(x["mime_type"], F.lit(""))) == mt)
                       & (F.coalesce(F.length(x["data"]), F.lit(0)) > 0))
        return F.transform(sel, lambda x: b64url_text(x["data"]))
    return texts("text/plain"), texts("text/html")


def best_bodies(plain, html) -> tuple[Column, Column]:
    """P5: (body_text, body_html) from decoded part texts. Plain parts with
    data joined by a blank line (blank ones skipped); only when no plain
    part has data, the text is derived from the joined HTML. HTML is kept
    whenever present."""
    plain = F.col(plain) if isinstance(plain, str) else plain
    html = F.col(html) if isinstance(html, str) else html
    nonblank = lambda a: F.filter(a, lambda t: F.length(py_strip(t)) > 0)
    html_joined = F.when(F.size(html) > 0, F.array_join(nonblank(html), "\n\n"))
    text = (F.when(F.size(plain) > 0, F.array_join(nonblank(plain), "\n\n"))
            .when(F.size(html) > 0, html_to_text(html_joined)).otherwise(F.lit("")))
    return py_strip(text), html_joined


# ------------------------------------------------------------------------- P6
def mailboxes(text: str) -> list[tuple[str, str]]:
    """(name, address) of an address list, one character at a time: quoted strings
    with escapes, nested comments, groups (their label goes) and angle addresses,
    in which only quotes count. A comment stands for a missing name, or follows a
    name in brackets."""
    out: list[tuple[str, str]] = []
    words, notes, address = [], [], None  # of the mailbox in hand
    i, n = 0, len(text)

    def end() -> None:
        nonlocal words, notes, address
        phrase, note = " ".join("".join(words).split()), " ".join(" ".join(notes).split())
        if address is not None:
            out.append((f"{phrase} ({note})" if note and phrase else phrase or note, address.strip()))
        elif phrase:
            out.append((note, phrase))
        words, notes, address = [], [], None

    def quoted() -> str:
        nonlocal i
        got = []
        i += 1
        while i < n and text[i] != '"':
            i += text[i] == "\\" and i + 1 < n
            got.append(text[i])
            i += 1
        i += 1
        return "".join(got)

    def comment() -> str:
        nonlocal i
        got, depth = [], 0
        while i < n:
            c = text[i]
            depth += (c == "(") - (c == ")")
            if c == "\\" and i + 1 < n:
                i += 1
                got.append(text[i])
            elif c not in "()":
                got.append(c)
            i += 1
            if depth == 0:
                break
        return "".join(got)

    while i < n:
        c = text[i]
        if c == '"':
            inside = quoted()
            words.append(f'"{inside}"' if text[i:i + 1] == "@" else inside)
            continue
        if c == "(":
            notes.append(comment())
            words.append(" ")
            continue
        if c == "<" and address is None:
            got = []
            i += 1
            while i < n and text[i] != ">":
                if text[i] == '"':
                    got.append('"' + quoted() + '"')
                    continue
                got.append(text[i])
                i += 1
            address = "".join(got)
        elif c in ",;":
            end()
        elif c == ":" and address is None:
            words, notes = [], []  # the label of a group
        elif c == "\\" and i + 1 < n:
            i += 1
            words.append(text[i])
        elif address is None:
            words.append(c)
        i += 1
    end()
    return out


MAILBOXES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType())]))


@F.pandas_udf(MAILBOXES)
def _mailboxes(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"name": name, "email": email} for name, email in mailboxes(v)] if isinstance(v, str) else None)


def parse_addresses(value) -> Column:
    """Address list -> array<struct<name,email>>. Lists of ``Name <addr>``,
    ``"Name" <addr>``, bare addresses and one group label are cut by patterns; only
    a value with a comment or an escape, or with several labels, goes to the full
    grammar (``mailboxes``, in Arrow batches; the others travel as nulls)."""
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    hard = v.rlike(r"[(\\\\]|:[^;]*+;.") | (F.length(v) - F.length(F.replace(v, F.lit(":"))) > 1)
    toks = F.regexp_extract_all(v, F.lit(r'(?:"[^"]*+"|[^",]++|")++'), F.lit(0))

    def one(t):
        s = py_strip(t)
        angle = s.contains("<")
        name = py_strip(F.regexp_replace(py_strip(F.regexp_extract(s, r"^(.*?)<", 1)), r'^"|"$', ""))
        bare = py_strip(F.regexp_replace(F.regexp_replace(s, r'^[^:@"<]*:\s*', ""), ";", ""))
        email = F.when(angle, py_strip(F.regexp_extract(s, r"^[^<]*+<([^>]*+)>", 1))).otherwise(bare)
        return F.struct(F.when(angle, name).otherwise(F.lit("")).alias("name"), email.alias("email"))
    return F.coalesce(_mailboxes(F.when(hard, v)), F.transform(toks, one))


def address_list(value) -> Column:
    return F.filter(F.transform(parse_addresses(value), lambda a: a["email"]), lambda e: F.length(e) > 0)


# ------------------------------------------------------------------------- P7
def parse_date(value) -> tuple[Column, Column]:
    """(sent instant, sender offset minutes). Leading weekday and
    trailing comment dropped; day or month first, ISO or two-digit years;
    numeric offset, named zone or none (UTC); unparseable -> null."""
    v = py_strip(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(v, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[A-Za-z]*+,?\s++", ""),
                         r"\s*+\([^)]*+\)\s*+$", "")
    zone = r"(?:\s++|(?<=\d))([+-]\d{2}:?\d{2}|" + "|".join(P.DATE_ZONES) + r")$"
    off_s = F.regexp_replace(F.upper(F.regexp_extract(s, "(?i)" + zone, 1)), ":", "")
    main = F.regexp_replace(F.regexp_replace(s, "(?i)" + zone, ""), r"[,\s]++", " ")
    main = F.regexp_replace(main, r"(?<=\d)T(?=\d)", " ")
    # two-digit years: 69-99 are 19xx, the others 20xx
    main = F.regexp_replace(main, r"^(\d{1,2}[ -][A-Za-z]{3}[ -])(?=(?:69|[7-9]\d) )", "$119")
    main = F.regexp_replace(main, r"^(\d{1,2}[ -][A-Za-z]{3}[ -])(?=\d\d )", "$120")
    day = F.initcap(F.regexp_replace(main, "-(?=[A-Za-z])|(?<=[A-Za-z])-", " "))
    forms = [f"{d} {t}" for d in ("d MMM yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMMM yyyy")
             for t in ("HH:mm:ss", "HH:mm")]
    local = F.coalesce(*[F.try_to_timestamp(day, F.lit(f)) for f in forms],
                       *[F.try_to_timestamp(main, F.lit(f)) for f in (
                           "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSS", "M/d/yyyy HH:mm:ss",
                           "M/d/yyyy HH:mm")])
    sign = F.when(F.substring(off_s, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    off = (F.when(off_s.rlike("^[+-]"), sign * (F.substring(off_s, 2, 2).try_cast("int") * 60
                                                + F.substring(off_s, 4, 2).try_cast("int")))
           .otherwise(F.coalesce(*[F.when(off_s == z, F.lit(m)) for z, m in P.DATE_ZONES.items()], F.lit(0))))
    sent = local - F.make_interval(mins=off)
    return F.when(local.isNotNull(), sent), F.when(local.isNotNull(), off)


# ------------------------------------------------------------------------- P8
def internal_date(value) -> Column:
    """Epoch-ms string -> timestamp, else null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.timestamp_millis(v.try_cast("bigint"))


# ------------------------------------------------------------------------- S2
def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DOUBLE, BOOLEAN, ...: the type of a
    variant ('MISSING' where there is none, 'VOID' for a JSON null)."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0), F.lit("MISSING"))


def _typed(v: Column, want: str, path, required: bool) -> Column:
    """The violation of one value, or null: ``path`` as text or column."""
    p = F.lit(path) if isinstance(path, str) else path
    k = kind_of(v)
    absent = k.isin("MISSING", "VOID")
    return (F.when(absent, F.concat(p, F.lit(": missing")) if required else F.lit(None).cast("string"))
            .when(k != want, F.concat(p, F.lit(f": not {_NAMES[want]}"))))


_NAMES = {"STRING": "a string", "OBJECT": "an object", "ARRAY": "an array"}


def contract_violations(raw: Column, nodes: Column) -> Column:
    """Every missing or wrongly typed path, not just the first: the
    message, each part of its tree (``path``, ``node``) and all their headers."""
    obj = F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))
    get = lambda path: F.try_variant_get(raw, path, "variant")
    top = F.array(
        F.when(raw.isNull(), F.lit("json: malformed")), F.when(raw.isNotNull() & ~obj, F.lit("json: not an object")),
        F.when(obj, _typed(get("$.id"), "STRING", "id", True)),
        F.when(obj, _typed(get("$.payload"), "OBJECT", "payload", True)),
        *[F.when(obj, _typed(get(f"$.{c}"), "STRING", c, False)) for c in ("threadId", "snippet")])

    def node_rules(x):
        at = F.concat(F.lit("payload"), F.array_join(F.transform(x["path"], lambda i: F.format_string(".parts[%d]", i)), ""))
        node = x["node"]
        sub = lambda path: F.try_variant_get(node, path, "variant")
        headers = F.coalesce(F.try_variant_get(node, "$.headers", "array<variant>"), F.array().cast("array<variant>"))

        def header_rules(h, i):
            here = F.concat(at, F.format_string(".headers[%d]", i))
            return F.when(kind_of(h) != "OBJECT", F.array(F.concat(here, F.lit(": not an object")))).otherwise(F.array(*[
                _typed(F.try_variant_get(h, f"$.{c}", "variant"), "STRING", F.concat(here, F.lit(f".{c}")), True)
                for c in ("name", "value")]))
        rules = F.array(
            _typed(sub("$.mimeType"), "STRING", F.concat(at, F.lit(".mimeType")), True),
            _typed(sub("$.headers"), "ARRAY", F.concat(at, F.lit(".headers")), False),
            _typed(sub("$.parts"), "ARRAY", F.concat(at, F.lit(".parts")), False),
            _typed(sub("$.body"), "OBJECT", F.concat(at, F.lit(".body")), False),
            _typed(sub("$.body.data"), "STRING", F.concat(at, F.lit(".body.data")), False),
            _typed(sub("$.filename"), "STRING", F.concat(at, F.lit(".filename")), False))
        wrong = F.when(kind_of(node) != "OBJECT", F.array(F.concat(at, F.lit(": not an object"))))
        return F.coalesce(wrong, F.concat(rules, F.flatten(F.transform(headers, header_rules))))
    return F.filter(F.concat(top, F.flatten(F.transform(nodes, node_rules))), lambda x: x.isNotNull())


def with_contract(df: DataFrame) -> DataFrame:
    """S2 columns of parsed rows: ``headers_list``, ``parts``, ``violations``."""
    headers = F.try_variant_get(F.col("raw"), "$.payload.headers", HEADER_TYPE)
    nodes = part_nodes(F.col("raw"), parts_levels(F.col("raw")))
    x = df.select("*", headers.alias("headers_list"), nodes.alias("_nodes"))
    return x.select("*", part_fields(F.col("_nodes")).alias("parts"),
                    contract_violations(F.col("raw"), F.col("_nodes")).alias("violations")).drop("_nodes")


def validate_raw(df: DataFrame, cfg: TriageConfig = DEFAULT_CONFIG, text: str = "value"):
    """(valid rows with ``headers`` and ``parts``, quarantine rows with
    ``violations``). A bad message is set aside; the rest go on."""
    x = with_contract(df).withColumn("_ok", F.size("violations") == 0).withColumn("_bad", F.size("violations") > 0)
    good = keep_rows(x, "_ok").drop("_ok", "_bad", "violations")
    bad = keep_rows(x, "_bad").drop("_ok", "_bad", "parts", "headers_list")
    return good, bad


def checked_messages(raw_rows: DataFrame, cfg: TriageConfig = DEFAULT_CONFIG) -> DataFrame:
    """S2 + P11 of raw rows in one pass: the normalized columns, ``raw_json``,
    ``corrupt`` and ``violations`` of every row, good or bad. Write it once, then
    ``split_checked``: the text is parsed, flattened and decoded a single time."""
    x = raw_rows if "raw" in raw_rows.columns else parse_raw(raw_rows)
    place = [c for c in ("position", "source_file", "source_at", "source_row", "source_ref") if c in x.columns]
    if "position" not in place:
        x = x.withColumn("position", F.lit(None).cast("bigint"))
    more = [c for c in place if c != "position"]
    rows = normalize(with_contract(x), cfg, extra=["corrupt", "violations", *more])
    rows = rows.withColumn("raw_json", F.to_json("raw")).drop("raw", "parts")
    return rows if "position" in place else rows.drop("position")


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalized messages, quarantine rows) of a written checked table."""
    good = checked.filter(F.size("violations") == 0).drop("violations", "corrupt")
    place = [c for c in ("position", "source_ref") if c in checked.columns]
    return good, checked.filter(F.size("violations") > 0).select(*place, "message_id", "corrupt", "raw_json", "violations")


# ------------------------------------------------------------------------ P11
def normalize(valid: DataFrame, cfg: TriageConfig = DEFAULT_CONFIG, extra: list[str] | None = None) -> DataFrame:
    """The normalized message row (13 fields plus the header map and
    the sender offset), from rows that passed S2; ``extra`` columns go along."""
    r = F.col("raw")
    plain_t, html_t = part_texts("parts")
    # one projection decodes every text part once; the next reads them
    x = valid.select("*", header_map("headers_list").alias("headers"), plain_t.alias("_plain"),
                     html_t.alias("_html"))
    frm = F.try_element_at(parse_addresses(F.coalesce(F.col("headers")["from"], F.lit(""))), F.lit(1))
    sent, off = parse_date(F.col("headers")["date"])
    text, html = best_bodies("_plain", "_html")
    return x.select(
        "position",
        F.coalesce(F.try_variant_get(r, "$.provider", "string"), F.lit(cfg.provider)).alias("provider"),
        F.try_variant_get(r, "$.id", "string").alias("message_id"),
        F.try_variant_get(r, "$.threadId", "string").alias("thread_id"),
        py_strip(F.coalesce(F.col("headers")["subject"], F.lit(""))).alias("subject"),
        F.coalesce(frm["name"], F.lit("")).alias("from_name"),
        F.coalesce(frm["email"], F.lit("")).alias("from_email"),
        "headers",
        address_list(F.coalesce(F.col("headers")["to"], F.lit(""))).alias("to"),
        address_list(F.coalesce(F.col("headers")["cc"], F.lit(""))).alias("cc"),
        sent.alias("sent_at"), off.alias("sent_offset_min"),
        internal_date(F.try_variant_get(r, "$.internalDate", "string")).alias("internal_date"),
        py_strip(F.coalesce(F.try_variant_get(r, "$.snippet", "string"), F.lit(""))).alias("snippet"),
        text.alias("body_text"), html.alias("body_html"),
        F.try_variant_get(r, "$.labelIds", "array<string>").alias("label_ids"),
        "parts", "raw", *(extra or []))
