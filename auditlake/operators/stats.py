"""Statistics (AGG-1..8, AGG-13..17, SRT-*): one pass each, partial aggregates, explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import cost, risk_of_score
from auditlake.operators.state import by_prefix

# fixed values: prices per 1000 tokens by the beginning of a model's name, in order; limits of plans
PRICES = [("qwen-turbo", 0.0008, 0.002), ("qwen-plus", 0.002, 0.006), ("qwen-max", 0.004, 0.012), ("qwen2.5", 0.0, 0.0), ("deepseek-chat", 0.001, 0.002), ("deepseek-reasoner", 0.004, 0.016), ("glm-4-plus", 0.005, 0.005), ("glm-4-air", 0.001, 0.001), ("ernie-4.0", 0.012, 0.012), ("ernie-speed", 0.0, 0.0), ("yi-lightning", 0.0, 0.0), ("mock", 0.0, 0.0)]
# end of the fixed values


def priced(usage: DataFrame, prices: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """FN-11 / JOI-10: usage(model, prompt_tokens, completion_tokens) with cost: own prices where price_in or price_out is over 0, else those of the first prefix of the model's name, else 0."""
    table = usage.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(PRICES if prices is None else prices)], "_ord int, _prefix string, _in double, _out double")
    own = by_prefix(usage, "model", table, "_prefix", F.col("_ord"), ["_in", "_out"])
    p_in, p_out = F.coalesce("_in", F.lit(0.0)), F.coalesce("_out", F.lit(0.0))
    if "price_in" in usage.columns:
        given = (F.coalesce("price_in", F.lit(0.0)) > 0) | (F.coalesce("price_out", F.lit(0.0)) > 0)
        p_in, p_out = F.when(given, F.coalesce("price_in", F.lit(0.0))).otherwise(p_in), F.when(given, F.coalesce("price_out", F.lit(0.0))).otherwise(p_out)
    return own.withColumn("cost", cost("prompt_tokens", "completion_tokens", p_in, p_out)).drop("_in", "_out")


def usage_totals(usage: DataFrame, *keys: str) -> DataFrame:
    """AGG-1: usage(model, tokens, cost, duration, success) in all, or by keys."""
    n = F.count("*")
    aggs = [n.alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("duration").alias("duration"), (F.count_if("success") / n * 100).alias("success_rate"), (F.sum("tokens") / n).alias("avg_tokens"), (F.sum("duration") / n).alias("avg_duration")]
    return usage.groupBy(*keys).agg(*aggs) if keys else usage.agg(*aggs)


def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """SRT-1/3/6, AGG-1's recent: the last n rows by the columns, the last column a unique id."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def last_n_by(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """STR-3: what a ring buffer of n rows per key holds."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def violations_of(reports: DataFrame, *keep: str) -> DataFrame:
    """The rule violations of stored reports (report_data, VARIANT or JSON text), a row each: kept columns, rule_id, section, risk_level, description; null what an entry lacks. Of a VARIANT only these paths
    are read. Reports that do not parse, or whose list is no list, have none."""
    data = F.col("report_data")
    data = data if reports.schema["report_data"].dataType.simpleString() == "variant" else F.try_parse_json(data)
    entries = F.try_variant_get(data, "$.rule_violations", "array<variant>")
    each = reports.select(*keep, F.explode(entries).alias("_v"))
    return each.select(*keep, *(F.try_variant_get("_v", f"$.{c}", "string").alias(c) for c in ("rule_id", "section", "risk_level", "description")))


def rule_effectiveness(reports: DataFrame) -> DataFrame:
    """AGG-2: reports(report_id, report_data) -> hits by rule id, most first; hit_rate = hits / reports and may exceed 1. Reports that do not parse count as reports."""
    hits = violations_of(reports).groupBy(F.coalesce("rule_id", F.lit("unknown")).alias("rule_id")).agg(F.count("*").alias("hit_count"))
    total = reports.agg(F.count("*").alias("total_reports"))
    return hits.crossJoin(F.broadcast(total)).withColumn("hit_rate", F.bround(F.col("hit_count") / F.greatest("total_reports", F.lit(1)), 3)).orderBy(F.col("hit_count").desc(), "rule_id")


def rule_counts(rules: DataFrame, *by: str) -> DataFrame:
    """AGG-3: counts by each of the columns, in one pass: (dimension, value, n)."""
    flat = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by)))
    return rules.select(flat.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def risk_distribution(rules: DataFrame) -> DataFrame:
    """AGG-4: a heavy chapter rule counts as high."""
    severity = F.coalesce("severity", F.lit("medium"))
    high = (severity == "high") | ((F.col("type") == "chapter_required") & (F.col("weight") >= 20))
    return rules.agg(F.count_if(high).alias("high"), F.count_if(~high & (severity != "low")).alias("medium"), F.count_if(severity == "low").alias("low"))


def member_dashboard(reports: DataFrame, now: Column, user: str = "user_id", score: str = "score", at: str = "created_at", passing: float = 85.0) -> DataFrame:
    """AGG-5: one row per user: reports in all and in the month of `now`, passed and failed ones, pass rate, distribution of levels (a pass is in none)."""
    month = F.col(at) >= F.date_trunc("month", now)
    level = risk_of_score(score)
    own = reports.groupBy(user).agg(F.count("*").alias("total_reports"), F.count_if(month).alias("month_reports"), F.count_if(month & (F.col(score) >= passing)).alias("passed"), *(F.count_if(month & (level == x)).alias(x) for x in ("critical", "high", "medium", "low")))
    rate = F.when(F.col("month_reports") > 0, F.bround(F.col("passed") / F.col("month_reports") * 100, 1)).otherwise(0.0)
    return own.withColumn("failed", F.col("month_reports") - F.col("passed")).withColumn("pass_rate", rate)


def recent_with_files(reports: DataFrame, files: DataFrame, n: int = 5) -> DataFrame:
    """JOI-1: the last n reports of each user with their file's name and level."""
    own = last_n_by(reports, n, ["checked_by"], ["created_at", "report_id"])
    return own.join(files.select("file_id", "filename"), "file_id").withColumn("risk_level", risk_of_score("total_score"))


def monthly_trend(events: DataFrame, now: Column, at: str = "created_at", months: int = 6) -> DataFrame:
    """AGG-6: (month, n) of the last months, none left out."""
    first = F.date_trunc("month", now)
    frame = events.sparkSession.range(1).select(F.explode(F.sequence(F.add_months(first, 1 - months), first.cast("date"), F.expr("interval 1 month"))).alias("month"))
    n = events.groupBy(F.date_trunc("month", F.col(at)).cast("date").alias("month")).agg(F.count("*").alias("n"))
    return frame.join(n, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("month")


def billing_status(usage: DataFrame, max_tokens: float, max_cost: float, alert_pct: float = 80.0) -> DataFrame:
    """AGG-8: used, percent of the limits, alerts."""
    own = usage.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    pct = lambda c, lim: (F.col(c) / lim * 100) if lim > 0 else F.lit(0.0)
    alert = lambda c, kind: F.when(F.col(c) >= alert_pct, F.struct(F.lit(kind).alias("type"), F.when(F.col(c) >= 100, "critical").otherwise("warning").alias("severity")))
    own = own.withColumn("token_pct", pct("tokens", max_tokens)).withColumn("cost_pct", pct("cost", max_cost))
    return own.withColumn("alerts", F.filter(F.array(alert("token_pct", "token_usage"), alert("cost_pct", "cost")), lambda x: x.isNotNull()))


def risk_heatmap(found: DataFrame, row: str = "section", column: str = "risk_level", levels: tuple[str, ...] = ("critical", "high", "medium", "low")) -> DataFrame:
    """AGG-13: counts by section and risk, largest total first. found: findings, or violations_of stored reports."""
    out = found.groupBy(row).agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == x).alias(x) for x in levels))
    return out.orderBy(F.col("total").desc(), row)


def platform_summary(found: DataFrame, model_found: DataFrame) -> DataFrame:
    """AGG-14: found(doc_id, risk_level, platform_codes): per document and platform distinct codes, findings, high ones; each high finding of the model counts for every platform hit."""
    each = found.select("doc_id", "risk_level", F.explode("platform_codes").alias("p"))
    own = each.groupBy("doc_id", F.col("p.platform").alias("platform")).agg(F.sort_array(F.collect_set("p.code")).alias("codes"), F.count("*").alias("violations"), F.count_if(F.col("risk_level") == "high").alias("high"))
    extra = model_found.where("risk_level = 'high'").groupBy("doc_id").agg(F.count("*").alias("_h"))
    return own.join(extra, "doc_id", "left").withColumn("high", F.col("high") + F.coalesce("_h", F.lit(0))).drop("_h")


def top_findings(rule_found: DataFrame, model_found: DataFrame, n: int = 5) -> DataFrame:
    """AGG-15: per document the n gravest of both lists, by risk, then weight."""
    own = rule_found.select("doc_id", F.lit("rule").alias("source"), F.col("rule_id").alias("name"), "risk_level", "weight").unionByName(model_found.select("doc_id", F.lit("llm").alias("source"), F.col("type").alias("name"), "risk_level", "weight"))
    order = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy(order, F.col("weight").desc(), "source", "name")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def history(reports: DataFrame, part_of_id: str = "", after: str | None = None, before: str | None = None) -> DataFrame:
    """AGG-16: ids that contain a text, created between two times, both excluded."""
    own = reports.where(F.col("report_id").cast("string").contains(part_of_id))
    own = own if after is None else own.where(F.col("created_at") > F.lit(after).cast("timestamp"))
    return own if before is None else own.where(F.col("created_at") < F.lit(before).cast("timestamp"))


def diagnostics(sections: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-17: per document lengths of sections, and findings by type."""
    a = sections.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section_type", F.length("content"))))).alias("section_lengths"))
    b = found.groupBy("doc_id", "rule_type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_type", "n")))).alias("findings_by_type"))
    return a.join(b, "doc_id", "full_outer")
