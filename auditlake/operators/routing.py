"""Depth of review by budget and method (ROU-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: limits, methods and tasks
GREEN_MAX, YELLOW_MAX = 1_000_000.0, 5_000_000.0
RED_METHODS, YELLOW_METHODS = ["单一来源", "竞争性谈判"], ["邀请招标", "竞争性磋商"]
RED_TASKS = ["AI-BRAND", "AI-AUTH", "AI-LAB", "AI-PATENT", "AI-COMBINE", "AI-STD", "AI-SCORE-VAGUE", "AI-PRICE-WEIGHT", "AI-SCORE-SUBJ", "AI-QUAL-LEVEL", "AI-QUAL-RESTRICT", "AI-QUAL-CERT", "AI-REJECT", "AI-COMPLAINT", "AI-SME", "AI-CREDIT", "AI-GREEN"]
YELLOW_TASKS = ["AI-BRAND", "AI-AUTH", "AI-COMBINE", "AI-QUAL-RESTRICT", "AI-REJECT", "AI-COMPLAINT"]


def light(budget: Column | str, method: Column | str, green_max: float = GREEN_MAX, yellow_max: float = YELLOW_MAX, red: list[str] | None = None, yellow: list[str] | None = None) -> Column:
    b, m = (F.col(x) if isinstance(x, str) else x for x in (budget, method))
    m = F.coalesce(m, F.lit(""))
    b = F.coalesce(b, F.lit(0.0))
    return F.when(m.isin(red or RED_METHODS) | (b > yellow_max), "red").when(m.isin(yellow or YELLOW_METHODS) | (b > green_max), "yellow").otherwise("green")


def routed(docs: DataFrame, **limits) -> DataFrame:
    """docs(budget, method, ...) with traffic_light, skip_llm, llm_tasks. A missing budget is no risk."""
    tasks = F.when(F.col("traffic_light") == "red", F.array(*map(F.lit, RED_TASKS))).when(F.col("traffic_light") == "yellow", F.array(*map(F.lit, YELLOW_TASKS))).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("traffic_light", light("budget", "method", **limits)).withColumn("skip_llm", F.col("traffic_light") == "green").withColumn("llm_tasks", tasks)


def routed_with_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Limits of a platform: overrides(platform, green_max, yellow_max); platforms without a row have the usual ones."""
    own = docs.join(F.broadcast(overrides), "platform", "left")
    b, m = F.coalesce("budget", F.lit(0.0)), F.coalesce("method", F.lit(""))
    return own.withColumn("traffic_light", F.when(m.isin(RED_METHODS) | (b > F.coalesce("yellow_max", F.lit(YELLOW_MAX))), "red").when(m.isin(YELLOW_METHODS) | (b > F.coalesce("green_max", F.lit(GREEN_MAX))), "yellow").otherwise("green")).drop("green_max", "yellow_max")
