"""Rule packs: JSON files -> rules, platform mappings, bias patterns, affinities, prompts (SRC-8..16). Paths are parameters; nothing is global."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULES = "rule_seq int, rule_id string, type string, target string, weight double, description string, law_ref string, suggestion string, category string, keyword string, target_section string, pattern string, severity string, exclude_contexts array<string>"
_FIELDS = "id string, type string, target string, weight double, description string, law_ref string, suggestion string, category string, keyword string, target_section string, pattern string, severity string, exclude_contexts array<string>"
_PATTERN = "id string, pattern string, weight double, message string, suggestion string, severity string, law_ref string, exclude_contexts array<string>"
TYPES = ["chapter_required", "keyword_required", "forbidden", "format_required"]


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """rule_seq in file order: rule ids are not unique. Packs are a few hundred rows."""
    return df.withColumn("rule_seq", F.row_number().over(Window.orderBy(*order)) - 1)


def _as_rules(df: DataFrame, source: int) -> DataFrame:
    return df.select(F.lit(source).alias("_source"), F.col("_at"), F.col("r.id").alias("rule_id"), *(F.col(f"r.{c}") for c in ("type", "target")), F.coalesce("r.weight", F.lit(10.0)).alias("weight"), *(F.col(f"r.{c}") for c in ("description", "law_ref", "suggestion", "category", "keyword", "target_section", "pattern")), F.coalesce("r.severity", F.lit("medium")).alias("severity"), "r.exclude_contexts")


def read_rules(spark: SparkSession, base: str, forbidden: str | None = None, industries: list[str] | None = None) -> DataFrame:
    """SRC-8/9/10: base rules, then forbidden patterns (severity from their category, else medium), then industry packs in the order given. An industry whose rules
    are there already by their prefix (`IND-XXX-`) is skipped."""
    parts = [_as_rules(_json(spark, base, f"rules array<struct<{_FIELDS.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>").select(F.posexplode("rules").alias("_at", "r")), 0)]
    if forbidden:
        item = _PATTERN.replace(" string", ":string").replace(" double", ":double").replace(" array", ":array")
        cats = _json(spark, forbidden, f"patterns map<string, struct<severity:string, regex_list:array<struct<{item}>>>>")
        each = cats.select(F.posexplode(F.map_entries("patterns")).alias("_cat", "c")).select("_cat", F.col("c.value.severity").alias("_severity"), F.posexplode("c.value.regex_list").alias("_in", "p"))
        parts.append(
            each.select(
                F.lit(1).alias("_source"), (F.col("_cat") * 10_000 + F.col("_in")).alias("_at"), F.col("p.id").alias("rule_id"), F.lit("forbidden").alias("type"), F.col("p.pattern").alias("target"), F.coalesce("p.weight", F.lit(10.0)).alias("weight"),
                F.col("p.message").alias("description"), "p.law_ref", "p.suggestion", F.lit("base").alias("category"), F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("string").alias("target_section"), "p.pattern", F.coalesce("p.severity", "_severity", F.lit("medium")).alias("severity"), "p.exclude_contexts",
            )
        )
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    for k, path in enumerate(industries or []):
        more = _as_rules(_json(spark, path, f"rules array<struct<{_FIELDS.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>").select(F.posexplode("rules").alias("_at", "r")), 2 + k)
        prefix = F.regexp_extract("rule_id", r"^(IND-[A-Z0-9]+-)", 1)
        there = own.select(prefix.alias("_prefix")).where("_prefix <> ''").distinct()
        own = own.unionByName(more.withColumn("_prefix", prefix).join(F.broadcast(there), "_prefix", "left_anti").drop("_prefix"))
    return _numbered(own, "_source", "_at").select(*(c.split()[0] for c in RULES.split(", ")))


def rules_from(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A pack that is given as rows; keys as in RULES without rule_seq."""
    names = [c.split()[0] for c in RULES.split(", ")]
    return spark.createDataFrame([tuple({"rule_seq": k, "weight": 10.0, "severity": "medium", **r}.get(n) for n in names) for k, r in enumerate(rules)], RULES)


def checked(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RUL-11: (rules, rejected with a reason). A forbidden rule needs a pattern that compiles and does not match the empty string; types are checked too. Patterns are compiled
    by the JVM's own pattern class, which will run them, where the rows are."""
    rx = F.concat(F.lit("(?iudU)"), F.coalesce("pattern", quoted("target"), F.lit("")))
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), rx)
    wrong = F.when(compiled.isNull(), "does not compile").when(F.rlike(F.lit(""), rx), "matches the empty string")
    reason = F.when(F.col("type") == "forbidden", wrong).when(~F.coalesce(F.col("type").isin(TYPES), F.lit(False)), "unknown type")
    own = rules.withColumn("reason", reason)
    return own.where("reason IS NULL").drop("reason"), own.where("reason IS NOT NULL")


def quoted(c: Column | str) -> Column:
    """A text as a pattern of itself."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"([\\.\[\]{}()*+?^$|\-#&~\s])", r"\\$1")


def read_platform_map(spark: SparkSession, path: str) -> DataFrame:
    """Enabled mappings: (rule_id, platform, platform_code, description, rule_type, target)."""
    item = "rule_id:string, platform:string, platform_code:string, description:string, rule_type:string, target:string, enabled:boolean"
    return _json(spark, path, f"mappings array<struct<{item}>>").select(F.inline("mappings")).where(F.coalesce("enabled", F.lit(True)))


def read_bias_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_seq, pattern_id, description, severity, keywords, check_fields, check_logic, suggestion, rule_id), in file order."""
    item = "description:string, severity:string, keywords:array<string>, check_fields:array<string>, check_logic:string, suggestion:string, rule_id:string"
    return _json(spark, path, f"patterns map<string, struct<{item}>>").select(F.posexplode(F.map_entries("patterns")).alias("pattern_seq", "e")).select("pattern_seq", F.col("e.key").alias("pattern_id"), "e.value.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: (industry, description): description of each industry's pack; lists are joined by 、"""
    whole = spark.read.text(path, wholetext=True)
    industries = F.from_json(F.get_json_object("value", "$.industries"), "map<string, string>")
    return whole.select(F.explode(industries).alias("industry", "_v")).select("industry", F.coalesce(F.get_json_object("_v", "$.description"), F.get_json_object("_v", "$.name"), "_v").alias("description")).orderBy("industry")


def industry_descriptions(manifest: DataFrame, industries: list[str]) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("industry", "description")))
    return manifest.where(F.col("industry").isin(industries)).agg(F.array_join(F.transform(own, lambda x: x["description"]), "、").alias("descriptions"))


def read_platform_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-13: one row per file: (platform, config as JSON text)."""
    return spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json\z", 1).alias("platform"), F.col("value").alias("config"))


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-14: (name, version, content, variables), the latest version of each name; `x_v3.txt` is version 3 of x, `x.txt` version 1."""
    raw = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt\z", 1).alias("file"), F.col("value").alias("content"))
    parts = raw.select(F.regexp_replace("file", r"_v[0-9]+\z", "").alias("name"), F.coalesce(F.regexp_extract("file", r"_v([0-9]+)\z", 1).try_cast("int"), F.lit(1)).alias("version"), "content")
    latest = parts.groupBy("name").agg(F.max("version").alias("version"), F.max_by("content", "version").alias("content"))
    return latest.withColumn("variables", F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1)))))


def rendered(template: Column | str, values: dict[str, Column | str]) -> Column:
    """SRC-15: each {name} replaced literally."""
    out = F.col(template) if isinstance(template, str) else template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v if isinstance(v, Column) else F.lit(v))
    return out


def read_rule_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: platform rules from CSV (with a header) or JSON lines/arrays; names of columns in lower case with _, "true"/"false" as boolean for enabled and mandatory."""
    df = spark.read.csv(path, header=True) if path.lower().endswith(".csv") else spark.read.json(path, multiLine=True)
    df = df.toDF(*("_".join(c.strip().lower().split()) for c in df.columns))
    for c in ("enabled", "mandatory"):
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "yes"), F.lit(True)))
    return df


def from_api_answer(spark: SparkSession, answers: DataFrame, schema: str) -> DataFrame:
    """SRC-17, the part after the network: answers(body string) of a JSON list, or of an object with `rules` or `data`, as rows. Bodies that do not parse give none."""
    body = F.coalesce(F.get_json_object("body", "$.rules"), F.get_json_object("body", "$.data"), F.col("body"))
    return answers.select(F.from_json(body, f"array<struct<{schema}>>").alias("_rows")).select(F.inline("_rows"))


def read_affinity(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(affinity(a, b, w), groups(ord, id, priority, sections_high, sections_medium, sections_low, token_limit_override))"""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json(F.coalesce(F.get_json_object("value", "$.pairwise"), F.get_json_object("value", "$.pairwise_affinity")), "map<string, map<string, double>>")).alias("a", "_m")).select("a", F.explode("_m").alias("b", "w"))
    item = "id:string, priority:int, sections_high:array<string>, sections_medium:array<string>, sections_low:array<string>, token_limit_override:int"
    groups = whole.select(F.posexplode(F.from_json(F.coalesce(F.get_json_object("value", "$.groups"), F.get_json_object("value", "$.affinity_groups")), f"array<struct<{item}>>")).alias("ord", "g")).select("ord", "g.*")
    return pairs, groups


def dumps(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False)
