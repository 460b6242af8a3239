"""Scores (SCO-*): rank-decayed sums. Ranks are within a document, whose findings are few; ties have equal weights, so their order does not matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import risk_penalty

DIMENSIONS = {"section_score": "chapter_required", "keyword_score": "keyword_required", "forbidden_score": "forbidden"}


def decayed(found: DataFrame, *keys: str) -> DataFrame:
    """SCO-1 before rounding: sum of weight / sqrt(rank by weight) for each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("weight").desc()))
    return found.withColumn("_d", F.col("weight") / F.sqrt(rank)).groupBy(*keys).agg(F.sum("_d").alias("deduction"))


def rule_scores(docs: DataFrame, found: DataFrame) -> DataFrame:
    """SCO-1 for each document: section_score, keyword_score, forbidden_score, total_score (all four types): max(5, 100 - sum), 100 without findings; 1 decimal."""
    by_type = decayed(found, "doc_id", "rule_type")
    whole = decayed(found, "doc_id").withColumnRenamed("deduction", "_all")
    score = lambda d: F.bround(F.greatest(F.lit(5.0), 100 - F.coalesce(d, F.lit(0.0))), 1)
    wide = by_type.groupBy("doc_id").agg(*(F.max(F.when(F.col("rule_type") == t, F.col("deduction"))).alias(name) for name, t in DIMENSIONS.items()))
    own = docs.select("doc_id").join(wide, "doc_id", "left").join(whole, "doc_id", "left")
    return own.select("doc_id", *(score(F.col(c)).alias(c) for c in DIMENSIONS), score(F.col("_all")).alias("total_score"))


def total_scores(docs: DataFrame, rule_found: DataFrame, model_found: DataFrame) -> DataFrame:
    """SCO-2: rule penalty by rank (risk, then weight), model penalty plain; 0.6/0.4 if the model found anything, else rules alone; 0..100, 1 decimal."""
    order = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(order, F.col("weight").desc()))
    rules = rule_found.withColumn("_p", risk_penalty("risk_level", "weight") / F.sqrt(rank)).groupBy("doc_id").agg(F.sum("_p").alias("rule_penalty"))
    model = model_found.groupBy("doc_id").agg(F.sum(risk_penalty("risk_level", "weight")).alias("llm_penalty"))
    own = docs.select("doc_id").join(rules, "doc_id", "left").join(model, "doc_id", "left")
    r, m = F.coalesce("rule_penalty", F.lit(0.0)), F.coalesce("llm_penalty", F.lit(0.0))
    both = F.when(F.col("llm_penalty").isNotNull(), r * 0.6 + m * 0.4).otherwise(r)
    cut = lambda x: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - x)), 1)
    return own.select("doc_id", cut(both).alias("total_score"), F.bround(r, 1).alias("rule_penalty"), F.bround(m, 1).alias("llm_penalty"), cut(r).alias("rule_raw_score"), F.when(F.col("llm_penalty").isNotNull(), cut(m)).otherwise(100.0).alias("llm_raw_score"))


def model_scores(docs: DataFrame, model_found: DataFrame) -> DataFrame:
    """SCO-3"""
    own = model_found.groupBy("doc_id").agg(F.sum("weight").alias("_w"))
    return docs.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.greatest(F.lit(0.0), 100 - F.coalesce("_w", F.lit(0.0))).alias("llm_score"))
