"""Bias patterns (BIA-*): sections ⋈ patterns by field; first keyword or pattern in order wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.scan import scanning

# fixed values: words of section names by field; patterns of the dedicated checks (pattern, confidence) in order
FIELDS = {"qualification_requirements": ["资格", "资质"], "technical_params": ["技术", "参数", "规格", "需求"], "evaluation_criteria": ["评审", "评分", "评标"]}
DEDICATED = {
    "brand_lock_series": ("critical", "R107", [("(?:须|必须|应|应当|需要|要求).{0,10}(?:同一品牌|同品牌)", 0.85), ("(?:同一品牌|同品牌)", 0.70), (r"品牌(?:\s*)一致", 0.80), ("(?:须|必须).{0,10}配套品牌", 0.75)]),
    "manufacturer_authorization": ("high", "R101", [("(?:厂家授权|原厂授权|制造商授权)", 0.80), ("(?:厂家盖章|原厂公章|厂商授权书)", 0.75), ("原厂售后服务承诺", 0.85)]),
    "detection_report_lock": ("high", "R109", [("(?:CMA|CNAS|检测报告|检测证明|检验报告|型式检验)", 0.75)]),
    "parameter_exclusivity": ("high", "AI-BIAS-004", [("(?:参数|指标|规格).{0,15}(?:唯一|仅|只能|限定|指定|特定|不少于|不低于|不高于)", 0.75), ("(?:仅|只能|限定|指定|特定).{0,10}(?:参数|指标|规格|配置)", 0.80), (r"(?:(?:\d+(?:\.\d+)?)\s*(?:W|mm|cm|m|kg|g|L|ml|℃|°C|dB|Hz|kHz|MHz|GHz|V|A|Ω|W|lux|lm|m/s|km/h|rpm)|(?:功率|尺寸|重量|容量|频率|电压|电流)).{0,10}(?:参数|指标|规格)", 0.65)]),
    "standard_not_exists": ("high", "AI-BIAS-010", [(r"GB[/T]?\s*\d+(?:\.\d+)?[-—]\d{4}", 0.85), ("(?:废止|失效|过期).{0,10}(?:标准|规范)", 0.80), ("(?:标准|规范).{0,10}(?:废止|失效|过期)", 0.80)]),
}
GENERIC_CONFIDENCE = 0.7
# end of the fixed values

RX = "pattern_seq int, pattern_id string, severity string, rule_id string, fields array<string>, ord int, rx string, keyword string, confidence double, generic boolean"


def with_fields(sections: DataFrame, fields: dict[str, list[str]] | None = None, *more: str) -> DataFrame:
    """BIA-1: a row per field of a section, by words of its name; `general` if none fits. more: columns to keep."""
    fields = FIELDS if fields is None else fields
    name = F.col("section_type")
    found = F.filter(F.array(*(F.when(name.rlike("|".join(w)), F.lit(f)) for f, w in fields.items())), lambda x: x.isNotNull())
    return sections.select("doc_id", "section_type", "content", *more).where("content <> ''").withColumn("field", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))))


def patterns_of(spark: SparkSession, patterns: list[dict], dedicated: dict | None = None) -> DataFrame:
    """One row per pattern and keyword: RX. patterns: dicts as in a pack, with `pattern_id`, `keywords`, `check_fields`, `severity`, `rule_id`. A `*` in a keyword stands for any
    characters that are no space; a keyword is a pattern otherwise. Patterns with a dedicated check use its list instead, case-sensitive like the rest."""
    dedicated = DEDICATED if dedicated is None else dedicated
    rows = []
    for k, p in enumerate(patterns):
        if p["pattern_id"] in dedicated:
            severity, rule_id, own = dedicated[p["pattern_id"]]
            rows += [(k, p["pattern_id"], severity, rule_id, p["check_fields"], i, "(?dU)" + rx, None, c, False) for i, (rx, c) in enumerate(own)]
        else:
            rows += [(k, p["pattern_id"], p.get("severity", "medium"), p.get("rule_id"), p["check_fields"], i, "(?dU)" + w.replace("*", r"\S*"), w, GENERIC_CONFIDENCE, True) for i, w in enumerate(p.get("keywords", []))]
    return spark.createDataFrame(rows, RX)


def findings(sections: DataFrame, rx: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """BIA-2..8: (doc_id, section_type, field, pattern_id, severity, rule_id, matched_text, confidence): one per section, field and pattern. A section meets the patterns of
    which it has a literal."""
    own = rx.collect()  # a pack
    seen = scanning(rx.sparkSession, [], [(k, r.rx) for k, r in enumerate(own)])
    fits = (F.array_contains("fields", F.col("field")) | F.array_contains("fields", "general")) & F.expr("content rlike rx")
    if seen is None:
        hit = with_fields(sections, fields).join(F.broadcast(rx), fits)
    else:
        numbered = rx.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(own)], f"_k int, {RX}")
        hit = with_fields(sections.withColumn("_seen", seen(F.col("content"))["maybe"]), fields, "_seen").withColumn("_k", F.explode("_seen")).join(F.broadcast(numbered), "_k").where(fits)
    hit = hit.select("doc_id", "section_type", "field", "pattern_seq", "pattern_id", "severity", "rule_id", "ord", F.when(F.col("generic"), F.col("keyword")).otherwise(F.regexp_substr("content", F.col("rx"))).alias("matched_text"), "confidence")
    first = hit.groupBy("doc_id", "section_type", "field", "pattern_seq").agg(F.min_by(F.struct("pattern_id", "severity", "rule_id", "matched_text", "confidence"), "ord").alias("f"))
    return first.select("doc_id", "section_type", "field", "pattern_seq", "f.*")


def scores(docs: DataFrame, found: DataFrame) -> DataFrame:
    """BIA-9"""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}_count")
    own = docs.select("doc_id").join(found.groupBy("doc_id").agg(n("critical"), n("high"), n("medium")), "doc_id", "left").na.fill(0)
    return own.withColumn("risk_score", F.least(F.lit(100.0), F.col("critical_count") * 25.0 + F.col("high_count") * 12.0 + F.col("medium_count") * 5.0))
