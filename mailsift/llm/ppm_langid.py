"""Language identification by prediction by partial matching.

Per language, a variable-order byte context tree (orders 0 to 3) holds symbol
counts. A text's score is its exact code length under the frozen counts: a
symbol seen in its context costs -log2(count / (total + distinct)); otherwise
an escape, -log2(distinct / (total + distinct)), is paid and the next shorter
context codes it without the symbols already ruled out, down to a uniform
order. A context that a language never saw passes to its shorter one for free.

Since counts are frozen, the cost of each symbol at each context is worked out
once, for all languages together; scoring a text is then one table look-up a
byte. Trees are learnt from a bounded sample of labelled documents: about
``sample_docs`` of each language, chosen by a hash of id and text; every document
is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray     # byte -> symbol class (1..K-1; 0 stands for the start of a text)
    node: np.ndarray       # three classes -> deepest context node
    cost: np.ndarray       # (node, class) -> bits in each language
    classes: int


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the byte strings of length 4, three zero bytes before each text."""
    for b in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            found = []
            for text in texts:
                x = np.frombuffer(b"\0\0\0" + text, dtype=np.uint8).astype(np.uint32)
                found.append(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:])
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()),
                                              "gram": gram.astype(np.int64), "n": n.astype(np.int64)})


def _costs(count: list[np.ndarray], parent: list[np.ndarray]) -> np.ndarray:
    """Bits of each symbol at each node of one language. count[k]: (nodes of
    order k, classes); parent[k]: their nodes of order k-1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        own, passed = [], []  # cost at a node; cost above a node after an escape from it
        for k, c in enumerate(count):
            n, q = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            if k == 0:
                up = np.broadcast_to(np.log2(np.maximum(1, 256 - q)), c.shape)
            else:
                p = count[k - 1][parent[k]]
                gone = np.where(c > 0, p, 0).sum(axis=1, keepdims=True)
                more = (p > 0).sum(axis=1, keepdims=True) - q
                total = p.sum(axis=1, keepdims=True) - gone + more
                escape = np.where(more > 0, -np.log2(np.maximum(more, 1) / np.maximum(total, 1)), 0.0)
                up = np.where(p > 0, -np.log2(p / np.maximum(total, 1)), escape + passed[-1][parent[k]])
            here = np.where(c > 0, -np.log2(c / (n + q)), -np.log2(q / (n + q)) + up)
            if k:
                here = np.where(n > 0, here, own[-1][parent[k]])
            else:
                here = np.where(n > 0, here, 8.0)
            own.append(here)
            passed.append(up)
    return np.concatenate(own)


def build(rows: list[tuple[str, int, int]], max_nodes: int) -> Model:
    """The frozen trees of all languages from their gram counts. Of the longest
    contexts, the ``max_nodes`` with the largest share of a language's bytes, summed
    over languages, are kept; a text in another one is coded from order 2."""
    langs = sorted({r[0] for r in rows})
    at = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([at[r[0]] for r in rows])
    gram = np.array([r[1] for r in rows], dtype=np.int64)
    n = np.array([r[2] for r in rows], dtype=np.float64)
    seen = np.setdiff1d(gram & 255, [0])  # a zero byte counts as the start of a text
    symbol = np.zeros(256, dtype=np.int64)
    symbol[:] = len(seen) + 1  # one class for all bytes never seen
    symbol[seen] = np.arange(1, len(seen) + 1)
    symbol[0] = 0
    classes = len(seen) + 2
    part = [gram >> s & 255 for s in (24, 16, 8)]
    part = [np.where(p == 0, 0, symbol[p]) for p in part]
    last = symbol[gram & 255]
    context = [np.zeros_like(gram), part[2], part[1] * classes + part[2],
               (part[0] * classes + part[1]) * classes + part[2]]
    nodes, count, parent = [], [[] for _ in langs], []
    for k in range(ORDER + 1):
        keys, inverse = np.unique(context[k], return_inverse=True)
        if k == ORDER and len(keys) > max_nodes:
            weight = np.bincount(inverse, weights=n / np.bincount(lang, weights=n)[lang])
            keys = np.sort(keys[np.argsort(-weight, kind="stable")[:max_nodes]])
        place = np.searchsorted(keys, context[k]).clip(max=len(keys) - 1)
        kept = keys[place] == context[k]
        for i in range(len(langs)):
            c = np.zeros((len(keys), classes))
            m = kept & (lang == i)
            np.add.at(c, (place[m], last[m]), n[m])
            count[i].append(c)
        parent.append(np.searchsorted(nodes[-1], keys % classes ** (k - 1)) if k else np.zeros(1, dtype=np.int64))
        nodes.append(keys)
    cost = np.stack([_costs(c, parent) for c in count], axis=-1).astype(np.float32)
    base = np.cumsum([0] + [len(x) for x in nodes])
    node = np.zeros(classes ** ORDER, dtype=np.int32)
    every = np.arange(classes ** ORDER)
    for k in range(1, ORDER + 1):
        own = every % classes ** k
        place = np.searchsorted(nodes[k], own).clip(max=len(nodes[k]) - 1)
        hit = nodes[k][place] == own
        node[hit] = base[k] + place[hit]
    return Model(langs, symbol, node, cost.reshape(-1, len(langs)), classes)


def learn(docs: DataFrame, sample_docs: int = 1500, max_nodes: int = 24_000) -> Model | None:
    """Trees from ``docs`` (doc_id, text, lang): about ``sample_docs`` documents
    of each language, drawn by a hash of id and text, so that neither a null nor a
    repeated id brings more; rows that agree in both count once. Only the sample's
    gram counts, whose number is bounded by it, reach the driver.

    ``max_nodes`` bounds the contexts of order 3 of all languages together, and
    with it the model (a cost for each context, byte class and language): languages
    share it by the share of their own bytes. Shorter contexts are all kept."""
    labelled = docs.filter("text is not null and lang is not null")
    # one row per language, as many as the model itself holds
    shares = {r["lang"]: min(1.0, sample_docs / r["n"])
              for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return None
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    row = F.xxhash64(F.col("doc_id").cast("string"), F.lit("\n"), "text")
    place = F.pmod(row, F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = (labelled.select("lang", row.alias("row"), place.alias("place"), share.alias("share"), F.col("text").cast("binary").alias("text"))
              .filter("place < share").dropDuplicates(["lang", "row"]).select("lang", "text"))
    counts = chosen.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pydict()
    rows = list(zip(table["lang"], table["gram"], table["n"], strict=True))
    return build(rows, max_nodes) if rows else None


def code_lengths(model: Model, text: bytes, step: int = 1 << 18) -> np.ndarray:
    """Bits of the whole text in each language."""
    bits = np.zeros(len(model.langs))
    k = model.classes
    before = np.zeros(ORDER, dtype=np.int64)
    for lo in range(0, len(text), step):
        s = np.concatenate([before, model.symbol[np.frombuffer(text, np.uint8, min(step, len(text) - lo), lo)]])
        before = s[-ORDER:]
        at = model.node[(s[:-3] * k + s[1:-2]) * k + s[2:-1]].astype(np.int64) * k + s[3:]
        bits += model.cost[at].sum(axis=0, dtype=np.float64)
    return bits


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns, lang_pred and score: the language of the
    shortest code, and its posterior under equal priors. Null texts and texts
    without any letter are 'und' with score 0, as is everything without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_nodes

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        letter = regex.compile(r"\p{L}").search
        model = shared.value

        def one(text):
            if model is None or text is None or not letter(text):
                return UNKNOWN, 0.0
            bits = code_lengths(model, text.encode())
            best = int(bits.argmin())
            return model.langs[best], float(1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum())

        for texts in parts:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_language", predict(F.col(text_col))).select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")), "_language.lang_pred", "_language.score")


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trees learnt from the rows that are
    not held out, every row scored.

    Defined cases: a null language is not learnt from; a null id is not held
    out; repeated rows and ties are scored row by row (equal codes: the language
    first in order); without labelled rows all are 'und'; an empty table gives
    no rows; other columns are ignored."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = learn(own.filter(~held_out()))
    return with_language(own.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
