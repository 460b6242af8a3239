"""The corpus pipeline: five stages, each on all that the one before it kept. A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Nulls: a document without text, or without a letter, goes in the first stage; a null id is an id that nobody shares, above all others. Rows that repeat id and text are one group of near-duplicates, so
one of them stays. Very long texts are read whole, in pieces. Empty tables give empty tables. Columns besides doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, free_name, passing, table
from auditlake.llm.decontaminate import contamination
from auditlake.llm.language_id import UNKNOWN, predict, train
from auditlake.llm.line_dedup import dedup_lines
from auditlake.llm.mixing import domain, mixed
from auditlake.llm.near_dedup import deduplicated

#: Documents whose likeliest language is less likely than this are rejected.
LEAST_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), and those whose language is not clear, go. Equal texts get equal decisions; with nothing to learn from, all go."""
    lang, score = free_name(docs, "_lang", "_score")
    known = predict(docs.withColumn("text", F.col("text").cast("string")), train(docs), "text", lang, score)
    return known.where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the last one only; no document goes, so one may be left with an empty text. Rows that repeat an id are one document."""
    return dedup_lines(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, 0.8) stays: the one with the smallest id. Documents without words stay."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go: all rows of such an id and text. With an empty benchmark all stay."""
    name, own, row = free_name(docs, "_hit", "_own", "_row")
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0).select(F.col("doc_id").alias(name), F.col("row").alias(row)).distinct()
    docs_ = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs_.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(own) == F.col(row)), "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its words and its rate (columns n_words and rate, or near these names where docs has them); those of rate 0 go. Without labels every rate is 1."""
    out, _ = mixed(docs, table(spark, sf_dir, "labels").select("doc_id", domain().alias("domain")))
    n_words, posterior, rate = out.columns[-3:]
    return out.where(F.col(rate) > 0).drop(posterior)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Not to be said in SQL: the first and the last stage are learned models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage keeps. What a stage wrote for itself goes once its result is written, and that result once the next one is."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
