"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before it wrote, applies one operator with its
production parameters to all of it, and lets the operator's decisions take
effect. All stages but the last return the columns of documents; rows keep the
values they came with, except that the substring stage renews text and n_chars
of the documents it cuts. Each stage states what it does with null, empty, tied
and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import written
from mailsift.llm.curve_packing import pack_along_curve
from mailsift.llm.fm_substrings import remove_repeated_passages
from mailsift.llm.ppm_langid import UNKNOWN, held_out, learn, with_language
from mailsift.llm.queries import BYTE_BPE
from mailsift.llm.simhash_covering import group_firsts, text_hash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which no language can be told go: null and empty texts and
    those without any letter. All others stay row by row, repeated rows and null
    ids too; without any labelled row no language can be told, and all go."""
    model = learn(docs.select("doc_id", "text", "lang").filter(~held_out()))
    return with_language(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id,
    of equal ids the smallest hash of the text; a document without an id only if
    no other of its group has one. Rows that agree in id and text count once.
    Texts without words (null, empty, blank) are one group."""
    def key(hashed):
        return [F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_null"), hashed.alias("_text")]

    stay = group_firsts(docs, shingle=4, radius=4).select(*key(F.col("text_hash")))
    rows = docs.select(*COLUMNS, *key(text_hash("text")))
    return (rows.join(stay, ["_k", "_null", "_text"], "left_semi").dropDuplicates(["_k", "_null", "_text"])
            .select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand at two places or more go from
    all of them. The rest of a text stays as it is, line ends and blanks included;
    a document of which no word is left goes, an uncut one stays as it came, also
    if null or empty. Rows are judged one by one, repeated ones repeat each other."""
    done = remove_repeated_passages(docs, length=35, carry=("text", "lang", "source", "n_chars"))
    cut, left = F.col("n_removed") > 0, F.col("left").cast("string")
    return done.filter((F.col("n_removed") < F.col("n_words")) | ~cut).select(
        "doc_id", F.when(cut, left).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(cut, F.length(left).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids, near documents beside each other. Every row
    has its ids and an end id; null and empty texts the end id alone."""
    return pack_along_curve(docs, BYTE_BPE, end_id=1, length=2048).select(
        "doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup),
          ("substring_dedup", substring_dedup), ("packing", packing)]

ORACLE_SQL = None  # none of the stages can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
