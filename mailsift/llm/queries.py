"""The registered queries of the operators: each applies one operator, with
production parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_scan import search
from .curve_packing import pack_along_curve
from .embedding_dups import near_duplicate_vectors
from .fm_substrings import remove_repeated_passages
from .forced_bpe import encode_decode
from .license_templates import scan_licenses
from .oracles import ORACLES  # noqa: F401  (read by the entry)
from .phrase_mining import mine_collocations
from .piece_codec import encode_with_offsets
from .ppm_langid import predict_languages
from .prefix_trie import conversation_trie
from .simhash_covering import simhash_groups
from .suffix_dedup import remove_repeated_strings
from .token_files import read_token_files, write_token_files

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_token_files(_read(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("token_bytes").alias("ids_crc32"))


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_read(spark, sf_dir, "documents"))
    base, more = F.col("base_spans.label"), F.col("spans.label")
    return found.select(
        "doc_id", "n_words", F.size("base_spans").cast("long").alias("n_base"),
        F.array_min("base_spans.first_word").alias("first_word"), F.array_max("base_spans.first_word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(F.lit(0.0)).alias("score"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_along_curve(_read(spark, sf_dir, "documents"), BYTE_BPE, end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op5_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_strings(_read(spark, sf_dir, "documents"), length=200)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op7_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(_read(spark, sf_dir, "documents"), WORD_BPE)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(_read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_read(spark, sf_dir, "documents"))


def op10_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_passages(_read(spark, sf_dir, "documents"), length=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_splitter_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"))


def op12_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_with_offsets(_read(spark, sf_dir, "documents"), PIECE_BPE)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(_read(spark, sf_dir, "documents"), threshold=30, longest=4, top=2000)


QUERIES = {f.__name__: f for f in (
    op1_adaptive_scan, op2_token_files, op3_license_templates, op4_curve_packing, op5_embedding_dups,
    op6_suffix_dedup, op7_forced_bpe, op8_simhash_covering, op9_ppm_langid, op10_fm_substrings,
    op11_splitter_trie, op12_piece_offsets, op13_phrase_mining)}
