"""The queries pN_... of the llm problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.encode import count_tokens, decode_ids, encode_texts
from darkslide.llm.mojibake import restore_garbled
from darkslide.llm.packing import fill_containers
from darkslide.llm.pairs import judged_pairs, surprising_pairs
from darkslide.llm.terms import mark_terms
from darkslide.session import table

KEYWORD_COLUMNS = ["iptc_keywords", "xmp_subject"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = mark_terms(table(spark, folder, "photo_record"), "rec_id", ["iptc_keywords"])
    return marked.select(F.col("gram")[0].alias("term"), "occurrences", "records", "mark")


def p2_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of up to three keywords in a row."""
    marked = mark_terms(table(spark, folder, "photo_record"), "rec_id", ["iptc_keywords"], max_n=3)
    return marked.select(F.array_join("gram", " | ").alias("gram"), F.size("gram").alias("n"), "occurrences", "records", "mark")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return judged_pairs(table(spark, folder, "photo_record"), "rec_id", KEYWORD_COLUMNS).select("term_a", "term_b", "together")


def p4_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of terms in a common record, with its ratio to chance: together against expected, and how unlikely that is."""
    return surprising_pairs(table(spark, folder, "photo_record"), "rec_id", KEYWORD_COLUMNS, min_together=1, min_ratio=0)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded and decoded again: the texts themselves, null ones empty."""
    return decode_ids(p8_ids(spark, folder), "doc_id")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    return fill_containers(sizes, "doc_id", "tokens").withColumnRenamed("size", "tokens")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return restore_garbled(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "restored_md5")


QUERIES = {f.__name__: f for f in (p2_found, p2_ngrams, p4_found, p4_surprise, p8_ids, p8_texts, p9_containers, p10_found)}
