"""The operators on the tables of the test data, each with the same result in SQL.

The data has no text of the kind the operators' own packs are for, so a small neutral pack plays their part; rules are rows, hence data, in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import text as fn
from auditlake.operators import bias, chunk, fuse, graph, label, mine, routing, rules, scores, state, stats, sync
from auditlake.session import written
from auditlake.sources import packs

SECTIONS = ["notice", "scope", "qualification", "evaluation", "instructions"]
SYNONYMS = {"notice": ["announcement", "notice"], "evaluation": ["scoring"]}
FORMATS = {"page numbers": "heth", "seal": "thwh"}
RULES = [
    {"rule_id": "SEC-1", "type": "chapter_required", "target": "announcement", "weight": 25.0}, {"rule_id": "SEC-2", "type": "chapter_required", "target": "scope", "weight": 20.0}, {"rule_id": "SEC-3", "type": "chapter_required", "target": "qualification", "weight": 15.0},
    {"rule_id": "SEC-4", "type": "chapter_required", "target": "scoring", "weight": 15.0}, {"rule_id": "SEC-5", "type": "chapter_required", "target": "instructions", "weight": 10.0},
    {"rule_id": "KEY-1", "type": "keyword_required", "target": "k", "keyword": "the", "target_section": "announcement", "weight": 15.0}, {"rule_id": "KEY-2", "type": "keyword_required", "target": "k", "keyword": "und", "target_section": "scope", "weight": 8.0},
    {"rule_id": "KEY-3", "type": "keyword_required", "target": "k", "keyword": "que", "weight": 20.0}, {"rule_id": "KEY-4", "type": "keyword_required", "target": "k", "keyword": "ing", "target_section": "scoring", "weight": 5.0},
    {"rule_id": "FORB-1", "type": "forbidden", "target": "t", "pattern": "idiot|moron|stupid", "severity": "critical", "weight": 25.0}, {"rule_id": "FORB-2", "type": "forbidden", "target": "t", "pattern": "trash|scum|clown", "severity": "high", "weight": 20.0},
    {"rule_id": "FORB-3", "type": "forbidden", "target": "t", "pattern": "licensed under the [a-z]+", "severity": "medium", "weight": 10.0}, {"rule_id": "FORB-4", "type": "forbidden", "target": "t", "pattern": "[0-9]{3,}", "severity": "high", "weight": 12.0},
    {"rule_id": "FORB-5", "type": "forbidden", "target": "t", "pattern": "[a-z0-9]+@[a-z]+", "severity": "low", "weight": 5.0}, {"rule_id": "FORB-1", "type": "forbidden", "target": "t", "pattern": "worthless", "severity": "medium", "weight": 8.0, "exclude_contexts": ["the "]},
    {"rule_id": "FMT-1", "type": "format_required", "target": "page numbers", "weight": 3.0}, {"rule_id": "FMT-2", "type": "format_required", "target": "seal", "weight": 2.0}, {"rule_id": "FMT-3", "type": "format_required", "target": "and", "weight": 2.0},
]
MAPPINGS = [("FORB-1", "alpha", "A1"), ("FORB-1", "alpha", "A1"), ("FORB-1", "beta", "B7"), ("KEY-3", "alpha", "A9"), ("SEC-1", "gamma", "")]
BIAS_FIELDS = {"qualification_requirements": ["qualif"], "technical_params": ["scope"], "evaluation_criteria": ["evalu"]}
BIAS = [
    {"pattern_id": "same_word", "check_fields": ["qualification_requirements", "technical_params"]}, {"pattern_id": "loose", "check_fields": ["evaluation_criteria", "qualification_requirements"], "severity": "medium", "rule_id": "FORB-4", "keywords": ["th*ing", "und", "que"]},
    {"pattern_id": "any", "check_fields": ["general"], "severity": "high", "rule_id": "FORB-1", "keywords": ["pathetic", "disgusting"]},
]
BIAS_DEDICATED = {"same_word": ("critical", "B-1", [("pathetic|loser", 0.85), ("the[a-z]{4} of", 0.7)])}
REVIEWER = [(["idiot", "moron"], "exclusivity", "high", 20.0, 0.92), (["trash", "und "], "bias", "medium", 10.0, 0.78), (["licensed", "que "], "ambiguity", "low", 5.0, 0.72)]
KNOWN = [("idiot", "R-1"), ("moron", "R-1"), ("trash", "R-2"), ("Licensed", "R-3"), ("und", "R-4")]
CANDIDATES = [("two_words", "R-9", "scum.*clown|clown.*scum", "high"), ("number", "R-1", "[0-9]{4}", "medium"), ("licence", "R-7", "licensed under|worthless", "medium"), ("endings", "R-8", "the[a-z]+ion|und[a-z]+lich", "low"), ("abuse", "R-9", "idiot|moron|trash", "high")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pack(spark: SparkSession) -> DataFrame:
    return packs.rules_from(spark, RULES)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id")


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Three lines make a block; block k is of type k mod 5; blocks of a type are one section."""
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kind = F.get(F.array(*map(F.lit, SECTIONS)), (F.floor(F.col("line_no") / 3) % 5).cast("int"))
    rows = lines.groupBy("doc_id", kind.alias("section_type")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return rows.select("doc_id", "section_type", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("content"), F.get("_l", F.lit(0))["line_no"].alias("ord"))


def literal(x: object) -> str:
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return "NULL" if x is None else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def values(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({names}))"


_CANON = {n: k for k, ns in SYNONYMS.items() for n in ns}
_R = values([(k, r["rule_id"], r["type"], r["target"], _CANON.get(r["target"], r["target"]), r["weight"], r.get("keyword"), _CANON.get(r.get("target_section"), r.get("target_section")), r.get("pattern"), r.get("severity", "medium"), (r.get("exclude_contexts") or [None])[0], FORMATS.get(r["target"], r["target"])) for k, r in enumerate(RULES)], "rule_seq, rule_id, type, target, canonical, weight, keyword, section, pattern, severity, excluded, word")
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
_SECTIONS = f"{_LINES}, sections AS (SELECT doc_id, {SECTIONS}[(line_no // 3) % 5 + 1] AS section_type, string_agg(line, chr(10) ORDER BY line_no) AS content, min(line_no) AS ord FROM lines GROUP BY ALL), rules AS {_R}"
_HITS = f"""{_SECTIONS},
hit AS (SELECT s.*, r.*, regexp_extract_all(content, '(?i)' || pattern) AS m, string_split_regex(content, '(?i)' || pattern) AS g FROM sections s JOIN rules r ON r.type = 'forbidden' AND regexp_matches(content, '(?i)' || pattern)),
each AS (SELECT *, m[k] AS matched, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM (SELECT *, unnest(generate_series(1, len(m))) AS k FROM hit)),
forb AS (SELECT *, replace(substr(content, greatest(start - 20, 0) + 1, start + length(matched) + 20 - greatest(start - 20, 0)), chr(10), ' ') AS around, CAST(length(content[1:start]) - length(replace(content[1:start], chr(10), '')) + 1 AS INTEGER) AS line_no
  FROM each WHERE excluded IS NULL OR NOT contains(substr(content, greatest(start - 10, 0) + 1, start + length(matched) + 10 - greatest(start - 10, 0)), excluded))"""
_WHOLE = "whole AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY ord) AS content FROM sections GROUP BY doc_id)"
_FOUND = f"""{_HITS}, {_WHOLE},
found AS (
  SELECT d.doc_id, rule_seq, rule_id, 'chapter_required' AS rule_type, 'high' AS risk_level, weight, NULL AS location, NULL AS text FROM documents d, rules r WHERE r.type = 'chapter_required' AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = d.doc_id AND s.section_type = r.canonical)
  UNION ALL SELECT d.doc_id, rule_seq, rule_id, 'keyword_required', CASE WHEN weight >= 15 THEN 'high' ELSE 'medium' END, weight, section, NULL FROM documents d CROSS JOIN rules r LEFT JOIN sections s ON s.doc_id = d.doc_id AND s.section_type = r.section LEFT JOIN whole w ON w.doc_id = d.doc_id
    WHERE r.type = 'keyword_required' AND NOT contains(coalesce(CASE WHEN r.section IS NULL THEN w.content ELSE s.content END, ''), keyword)
  UNION ALL SELECT doc_id, rule_seq, rule_id, 'forbidden', severity, weight, section_type, trim(around) FROM forb
  UNION ALL SELECT w.doc_id, rule_seq, rule_id, 'format_required', 'low', weight, NULL, NULL FROM whole w, rules r WHERE r.type = 'format_required' AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = w.doc_id AND contains(s.content, word)))"""


def found(spark: SparkSession, d: str) -> DataFrame:
    return rules.run(docs(spark, d), sections(spark, d), pack(spark), synonyms=SYNONYMS, format_words=FORMATS)


@query(f"WITH {_HITS} SELECT doc_id, rule_seq, rule_id, count(*) AS hits FROM forb GROUP BY ALL")
def forbidden_hits(spark: SparkSession, d: str) -> DataFrame:
    return rules.forbidden_matches(sections(spark, d), pack(spark)).groupBy("doc_id", "rule_seq", "rule_id").agg(F.count("*").alias("hits"))


_SCORE = "round(greatest(5.0, 100 - coalesce(sum(w / sqrt(rn)), 0)), 6)"


@query(f"WITH {_HITS}, ranked AS (SELECT doc_id, weight AS w, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC) AS rn FROM forb) SELECT d.doc_id, {_SCORE} AS score, count(w) AS violations FROM documents d LEFT JOIN ranked USING (doc_id) GROUP BY d.doc_id")
def forbidden_score(spark: SparkSession, d: str) -> DataFrame:
    hits = rules.forbidden_matches(sections(spark, d), pack(spark))
    own = scores.decayed(hits, "doc_id").join(hits.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    return docs(spark, d).join(own, "doc_id", "left").select("doc_id", F.round(F.greatest(F.lit(5.0), 100 - F.coalesce("deduction", F.lit(0.0))), 6).alias("score"), F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


@query(f"WITH {_HITS} SELECT doc_id, section_type, rule_seq, start, matched, line_no, trim(around) AS text FROM forb")
def forbidden_context(spark: SparkSession, d: str) -> DataFrame:
    return rules.forbidden_matches(sections(spark, d), pack(spark)).select("doc_id", "section_type", "rule_seq", "start", "matched", "line_no", "text")


@query(f"WITH {_FOUND} SELECT doc_id, rule_id, weight FROM found WHERE rule_type = 'chapter_required'")
def chapter_missing(spark: SparkSession, d: str) -> DataFrame:
    return rules.missing_chapters(docs(spark, d), sections(spark, d), pack(spark), SYNONYMS).select("doc_id", "rule_id", "weight")


@query(f"WITH {_FOUND} SELECT doc_id, rule_id, risk_level, coalesce('应在《' || location || '》中', '全文') AS location FROM found WHERE rule_type = 'keyword_required'")
def keyword_missing(spark: SparkSession, d: str) -> DataFrame:
    return rules.missing_keywords(docs(spark, d), sections(spark, d), pack(spark), synonyms=SYNONYMS).select("doc_id", "rule_id", "risk_level", "location")


@query(f"WITH {_FOUND} SELECT doc_id, rule_id FROM found WHERE rule_type = 'format_required'")
def format_missing(spark: SparkSession, d: str) -> DataFrame:
    return rules.missing_formats(docs(spark, d), sections(spark, d), pack(spark), FORMATS).select("doc_id", "rule_id")


@query(
    f"""WITH {_FOUND}, ranked AS (SELECT doc_id, weight AS w, rule_type, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC) AS rn FROM found)
SELECT d.doc_id, count(*) FILTER (rule_type = 'chapter_required') AS chapters, count(*) FILTER (rule_type = 'keyword_required') AS keywords, count(*) FILTER (rule_type = 'forbidden') AS forbidden, count(*) FILTER (rule_type = 'format_required') AS formats, {_SCORE} AS score
FROM documents d LEFT JOIN ranked USING (doc_id) GROUP BY d.doc_id"""
)
def rule_run(spark: SparkSession, d: str) -> DataFrame:
    got = found(spark, d)
    n = lambda x, a: F.count_if(F.col("rule_type") == x).alias(a)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("weight").desc()))
    own = got.select("doc_id", "rule_type", (F.col("weight") / F.sqrt(rank)).alias("p")).groupBy("doc_id").agg(n("chapter_required", "chapters"), n("keyword_required", "keywords"), n("forbidden", "forbidden"), n("format_required", "formats"), F.sum("p").alias("p"))
    return docs(spark, d).join(own, "doc_id", "left").na.fill(0).select("doc_id", "chapters", "keywords", "forbidden", "formats", F.round(F.greatest(F.lit(5.0), 100 - F.col("p")), 6).alias("score"))


@query(f"WITH {_FOUND}, m AS (SELECT rule_id, string_agg(DISTINCT platform || ':' || code, ',' ORDER BY platform || ':' || code) AS codes FROM {values(MAPPINGS, 'rule_id, platform, code')} GROUP BY rule_id) SELECT doc_id, rule_seq, coalesce(codes, '') AS codes, count(*) AS n FROM found LEFT JOIN m USING (rule_id) GROUP BY ALL")
def platform_codes(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([(*x, "") for x in MAPPINGS], "rule_id string, platform string, platform_code string, description string")
    own = rules.platform_codes(found(spark, d), m)
    return own.groupBy("doc_id", "rule_seq", F.array_join(F.transform("platform_codes", lambda p: F.concat(p["platform"], F.lit(":"), p["code"])), ",").alias("codes")).agg(F.count("*").alias("n"))


_BRX = []
for _k, _p in enumerate(BIAS):
    _sev, _rid, _own = BIAS_DEDICATED.get(_p["pattern_id"], (_p.get("severity"), _p.get("rule_id"), [(w.replace("*", r"\S*"), 0.7) for w in _p.get("keywords", [])]))
    _BRX += [(_k, _p["pattern_id"], _sev, _rid, ",".join(_p["check_fields"]), _i, _rx, _p["keywords"][_i] if "keywords" in _p else None, _c) for _i, (_rx, _c) in enumerate(_own)]
_BIAS = f"""{_SECTIONS}, rx AS {values(_BRX, "pattern_seq, pattern_id, severity, rule_id, fields, ord, rx, keyword, confidence")},
named AS (SELECT *, CASE section_type WHEN 'qualification' THEN 'qualification_requirements' WHEN 'scope' THEN 'technical_params' WHEN 'evaluation' THEN 'evaluation_criteria' ELSE 'general' END AS field FROM sections WHERE content <> ''),
bias AS (SELECT doc_id, section_type, field, pattern_id, severity, rule_id, coalesce(keyword, regexp_extract(content, rx)) AS matched_text, CAST(confidence AS DOUBLE) AS confidence FROM named, rx WHERE (contains(fields, field) OR contains(fields, 'general')) AND regexp_matches(content, rx)
  QUALIFY row_number() OVER (PARTITION BY doc_id, section_type, pattern_seq ORDER BY rx.ord) = 1)"""


def biased(spark: SparkSession, d: str) -> DataFrame:
    return bias.findings(sections(spark, d), bias.patterns_of(spark, BIAS, BIAS_DEDICATED), BIAS_FIELDS)


@query(f"WITH {_BIAS} SELECT * FROM bias")
def bias_findings(spark: SparkSession, d: str) -> DataFrame:
    return biased(spark, d).drop("pattern_seq")


@query(f"WITH {_BIAS} SELECT d.doc_id, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count, least(100.0, sum(CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 12.0 WHEN 'medium' THEN 5.0 ELSE 0.0 END))::DOUBLE AS risk_score FROM documents d LEFT JOIN bias USING (doc_id) GROUP BY d.doc_id")
def bias_score(spark: SparkSession, d: str) -> DataFrame:
    return bias.scores(docs(spark, d), biased(spark, d))


_METHOD = "CASE o_orderpriority WHEN '1-URGENT' THEN '单一来源' WHEN '2-HIGH' THEN '邀请招标' ELSE '公开招标' END"


@query(f"WITH o AS (SELECT o_orderkey, o_totalprice * 25 AS budget, {_METHOD} AS method FROM orders) SELECT o_orderkey, CASE WHEN method = '单一来源' OR budget > 5000000 THEN 'red' WHEN method = '邀请招标' OR budget > 1000000 THEN 'yellow' ELSE 'green' END AS traffic_light, CAST(CASE WHEN method = '单一来源' OR budget > 5000000 THEN 17 WHEN method = '邀请招标' OR budget > 1000000 THEN 6 ELSE 0 END AS INTEGER) AS tasks FROM o")
def route_light(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 25).alias("budget"), F.expr(_METHOD).alias("method"))
    return routing.routed(own).select("o_orderkey", "traffic_light", F.size("llm_tasks").alias("tasks"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT)::DOUBLE * CASE WHEN o_orderkey % 3 = 0 THEN 10000 ELSE 1 END AS budget FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0")
def budget_extract(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("long").cast("string")
    unit = F.when(F.col("o_orderkey") % 3 == 0, "万元").otherwise("元")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("本项目无金额")).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("采购预算："), n, unit)).otherwise(F.concat(n, unit, F.lit(" 最高限价")))
    return t(spark, d, "orders").select("o_orderkey", fn.budget(text).alias("budget"))


_MODEL = f"""{_SECTIONS}, model AS (SELECT doc_id, section_type AS section, seq, type, risk_level, weight, confidence, keyword, trim(replace(substr(content, greatest(instr(content, keyword) - 16, 0) + 1, instr(content, keyword) + 29 - greatest(instr(content, keyword) - 16, 0)), chr(10), chr(10)), ' ' || chr(10)) AS text
  FROM (SELECT *, CASE WHEN contains(content, k1) THEN k1 WHEN contains(content, k2) THEN k2 END AS keyword FROM sections, {values([(k, w[0], w[1], *r) for k, (w, *r) in enumerate(REVIEWER)], "seq, k1, k2, type, risk_level, weight, confidence")}) WHERE keyword IS NOT NULL)"""


def modelled(spark: SparkSession, d: str) -> DataFrame:
    return fuse.reviewed(sections(spark, d), REVIEWER)


@query(f"WITH {_MODEL} SELECT doc_id, section, type, keyword, text FROM model")
def model_mock(spark: SparkSession, d: str) -> DataFrame:
    return modelled(spark, d).select("doc_id", "section", "type", "keyword", "text")


_MODEL_ONLY = _MODEL.removeprefix(_SECTIONS + ", ")
_KEPT = "kept AS (SELECT * FROM model m WHERE NOT EXISTS (SELECT 1 FROM found r WHERE r.rule_type = 'forbidden' AND r.doc_id = m.doc_id AND r.location = m.section AND r.risk_level = m.risk_level AND m.text <> '' AND contains(r.text, m.text)))"


def short_model(spark: SparkSession, d: str) -> DataFrame:
    return short(modelled(spark, d))


def short(model: DataFrame) -> DataFrame:
    """The model's findings as if it had quoted the keyword alone."""
    return model.withColumn("text", F.col("keyword")).withColumn("risk_level", F.when(F.col("risk_level") == "high", "critical").otherwise(F.col("risk_level")))


_SHORT = "model AS (SELECT * REPLACE (keyword AS text, CASE WHEN risk_level = 'high' THEN 'critical' ELSE risk_level END AS risk_level) FROM model0)"
_FUSED = f"{_FOUND}, {_MODEL_ONLY.replace('model AS', 'model0 AS', 1)}, {_SHORT}, {_KEPT}"


@query(f"WITH {_FUSED} SELECT doc_id, section, type, text FROM kept")
def fuse_dedup(spark: SparkSession, d: str) -> DataFrame:
    return fuse.deduplicated(found(spark, d), short_model(spark, d)).select("doc_id", "section", "type", "text")


_PENALTY = "CASE risk_level WHEN 'high' THEN CASE WHEN weight >= 20 THEN 15.0 WHEN weight >= 10 THEN 10.0 ELSE 8.0 END WHEN 'medium' THEN CASE WHEN weight >= 15 THEN 7.0 WHEN weight >= 5 THEN 5.0 ELSE 3.0 END ELSE CASE WHEN weight >= 10 THEN 2.0 ELSE 1.0 END END"
_ORDER = "CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query(
    f"""WITH {_FUSED}, rp AS (SELECT doc_id, sum(p / sqrt(rn)) AS p FROM (SELECT doc_id, {_PENALTY} AS p, row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}, weight DESC) AS rn FROM found) GROUP BY doc_id),
mp AS (SELECT doc_id, sum({_PENALTY}) AS m FROM model GROUP BY doc_id)
SELECT d.doc_id, round_even(coalesce(p, 0), 1) AS rule_penalty, round_even(coalesce(m, 0)::DOUBLE, 1) AS llm_penalty, round_even(greatest(0.0, least(100.0, 100 - CASE WHEN m IS NULL THEN coalesce(p, 0) ELSE coalesce(p, 0) * 0.6 + m * 0.4 END))::DOUBLE, 1) AS total FROM documents d LEFT JOIN rp USING (doc_id) LEFT JOIN mp USING (doc_id)"""
)
def fuse_score(spark: SparkSession, d: str) -> DataFrame:
    return scores.total_scores(docs(spark, d), found(spark, d), short_model(spark, d)).select("doc_id", "rule_penalty", "llm_penalty", F.col("total_score").alias("total"))


_BIAS_ONLY = _BIAS.removeprefix(_SECTIONS + ", ")


@query(
    f"""WITH {_FUSED}, {_BIAS_ONLY}, items AS (
  SELECT doc_id, CASE WHEN rule_type = 'forbidden' AND EXISTS (SELECT 1 FROM bias b WHERE b.doc_id = f.doc_id AND b.rule_id = f.rule_id) THEN 'confirmed' WHEN rule_type = 'forbidden' OR risk_level = 'high' THEN 'high_risk' WHEN risk_level = 'medium' THEN 'needs_review' ELSE 'advisory' END AS category FROM found f
  UNION ALL SELECT doc_id, CASE WHEN severity IN ('critical', 'high') THEN 'high_risk' ELSE 'needs_review' END FROM bias b WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = b.doc_id AND f.rule_id = b.rule_id)
  UNION ALL SELECT doc_id, CASE WHEN risk_level = 'high' THEN 'high_risk' ELSE 'needs_review' END FROM model0),
n AS (SELECT d.doc_id, count(*) FILTER (category = 'confirmed') AS c, count(*) FILTER (category = 'high_risk') AS h, count(*) FILTER (category = 'needs_review') AS r, count(*) FILTER (category = 'advisory') AS a FROM documents d LEFT JOIN items USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, c AS confirmed_count, h AS high_risk_count, r AS needs_review_count, a AS advisory_count, CASE WHEN c >= 2 THEN 'critical' WHEN c > 0 OR h > 0 THEN 'high' WHEN r > 0 THEN 'medium' ELSE 'low' END AS risk_level, c = 0 AND h = 0 AS final_passed, CASE WHEN c = 0 AND h = 0 AND r = 0 THEN 'auto_passed' WHEN c > 0 THEN 'auto_failed' ELSE 'needs_review' END AS review_status FROM n"""
)
def risk_merge(spark: SparkSession, d: str) -> DataFrame:
    own = written(sections(spark, d), "sections")
    found_ = rules.run(docs(spark, d), own, pack(spark), synonyms=SYNONYMS, format_words=FORMATS)
    biased_ = bias.findings(own, bias.patterns_of(spark, BIAS, BIAS_DEDICATED), BIAS_FIELDS)
    return fuse.verdicts_of(docs(spark, d), fuse.gathered(found_, biased_, fuse.reviewed(own, REVIEWER))).select("doc_id", "confirmed_count", "high_risk_count", "needs_review_count", "advisory_count", "risk_level", "final_passed", "review_status")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role, text[1:40] ORDER BY length(text) % 7 DESC, turn) = 1")
def llm_dedup(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("type"), F.lit("").alias("section"), "text", (F.length("text") % 7).alias("confidence"))
    return fuse.best_of_similar(own).select(F.col("doc_id").alias("conv_id"), F.col("seq").alias("turn"), F.col("type").alias("role"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e, n = t(spark, d, "events"), F.col("event_id")
    item = F.concat(F.lit('[{"type":"'), F.when(n % 4 == 0, "nonsense").otherwise("bias"), F.lit('","text":"'), F.col("event_type"), F.lit('","confidence":'), F.when(n % 3 == 0, "1.7").otherwise("0.25"), F.lit(',"risk_level":"'), F.when(n % 2 == 0, "high").otherwise("xx"), F.lit('"}]'))
    body = F.when(n % 5 == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(n % 5 == 1, F.concat(F.lit("so: "), item, F.lit(" done"))).when(n % 5 == 2, F.lit("nothing")).otherwise(item)
    return e.select(n.alias("doc_id"), F.lit(0).alias("chunk_no"), body.alias("response"))


@query("SELECT event_id AS doc_id, event_type AS text, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'medium' END AS risk_level FROM events WHERE event_id % 5 <> 2 AND event_id % 4 <> 0")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    return fuse.parsed(_answers(spark, d))[0].select("doc_id", "text", "confidence", "risk_level")


@query("SELECT CASE WHEN event_id % 5 = 2 THEN 'no JSON array' ELSE 'type' END AS reason, count(*) AS n FROM events WHERE event_id % 5 = 2 OR event_id % 4 = 0 GROUP BY 1")
def model_rejected(spark: SparkSession, d: str) -> DataFrame:
    return fuse.parsed(_answers(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


_NORM = r"translate(regexp_replace({}, '\s+', '', 'g'), '（）【】：，。；！？—–', '()[]:,.;!?--')"


def _line_list(x) -> object:
    return F.filter(F.split(x, "\n"), lambda s: F.length(s) >= 10)


_WORDS = ", ".join(f"'{w}'" for w in label.TEMPLATE_WORDS)
_SCORE = f"""CASE WHEN regexp_matches(line, '招标投标法|政府采购法|实施条例|财政部|87号令|94号令|38号文') THEN 3 ELSE 0 END + 2 * least(5, len(list_filter([{_WORDS}], lambda w: contains(line, w)))) + CASE WHEN length(line) >= 40 THEN 2 ELSE 0 END
+ CASE WHEN regexp_matches(line, '(第[一二三四五六七八九十\\p{{Nd}}]+[章节条]|^\\p{{Nd}}+[.、])') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(line, '(注[：:]|说明[：:]|注意[：:]|提示[：:])') THEN 1 ELSE 0 END"""


@query(f"WITH {_LINES}, k AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents), n AS (SELECT lang, source, count(DISTINCT doc_id) AS docs FROM k GROUP BY ALL), s AS (SELECT lang, source, {_NORM.format('line')} AS norm, count(DISTINCT doc_id) AS has, count(*) AS frequency, max({_SCORE}) AS score FROM lines JOIN k USING (doc_id) WHERE length(line) >= 10 GROUP BY ALL) SELECT lang, source, sha256(norm)[1:16] AS hash_id, frequency, CAST(length(norm) AS INTEGER) AS length FROM s JOIN n USING (lang, source) WHERE (docs > 1 AND has = docs) OR (docs = 1 AND score >= 5)")
def fingerprint_build_all(spark: SparkSession, d: str) -> DataFrame:
    """Groups by columns and groups of one template, where fingerprint_build has documents of one length."""
    own = t(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return label.fingerprints(own, ["lang", "source"], split=_line_list).select("lang", "source", "hash_id", "frequency", "length")


_BY_LENGTH = "WITH {lines}, k AS (SELECT doc_id, coalesce(lang, '') AS lang, n_chars FROM documents), n AS (SELECT lang, n_chars, count(DISTINCT doc_id) AS docs FROM k GROUP BY ALL), s AS (SELECT lang, n_chars, {norm} AS norm, count(DISTINCT doc_id) AS has, count(*) AS frequency, max({score}) AS score FROM lines JOIN k USING (doc_id) WHERE length(line) >= 10 GROUP BY ALL) SELECT lang, n_chars, sha256(norm)[1:16] AS hash_id, frequency, CAST(length(norm) AS INTEGER) AS length FROM s JOIN n USING (lang, n_chars) WHERE (docs > 1 AND has = docs) OR (docs = 1 AND score >= 5)"


@query(_BY_LENGTH.format(lines=_LINES, norm=_NORM.format("line"), score=_SCORE))
def fingerprint_build(spark: SparkSession, d: str) -> DataFrame:
    """Groups of texts of one language and length, so that copies are groups."""
    own = t(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "n_chars", "text")
    return label.fingerprints(own, ["lang", "n_chars"], split=_line_list).select("lang", "n_chars", "hash_id", "frequency", "length")


def _prints(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("text")).where("length(text) >= 10").distinct()
    return own.withColumn("hash_id", fn.text_hash("text"))


def _own_lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where("length(text) >= 10")


_PRINTS = f"prints AS (SELECT DISTINCT line AS text, sha256({_NORM.format('line')})[1:16] AS h FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(line) >= 10)"


@query(f"WITH {_LINES}, {_PRINTS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, sha256({_NORM.format('line')})[1:16] AS fingerprint_id FROM lines WHERE length(line) >= 10 AND sha256({_NORM.format('line')})[1:16] IN (SELECT h FROM prints)")
def fixed_exact(spark: SparkSession, d: str) -> DataFrame:
    return label.exact(_own_lines(spark, d), _prints(spark, d)).where("fingerprint_id IS NOT NULL").select("doc_id", "line_no", "fingerprint_id")


_GRAMS = "list_distinct(list_transform(generate_series(1, length({0}) - 2), lambda i: {0}[i:i + 2]))"


@query(
    f"""WITH {_LINES}, {_PRINTS}, a AS (SELECT text, n, {_GRAMS.format("n")} AS g FROM (SELECT DISTINCT line AS text, {_NORM.format("line")} AS n FROM lines WHERE length(line) >= 10) WHERE length(n) > 2),
b AS (SELECT n, {_GRAMS.format("n")} AS g FROM (SELECT DISTINCT {_NORM.format("text")} AS n FROM prints) WHERE length(n) > 2)
SELECT text, round(max(s), 9) AS score FROM (SELECT text, len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) AS s FROM a, b WHERE abs(length(a.n) - length(b.n)) <= greatest(length(a.n) * 0.3, 10)) WHERE s >= 0.85 GROUP BY text"""
)
def fixed_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    own = _own_lines(spark, d).select("text").distinct().withColumn("sid", F.col("text"))
    return label.fuzzy(own, _prints(spark, d)).select(F.col("sid").alias("text"), F.round("score", 9).alias("score"))


def _signs(signs: list[tuple[str, int]]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(text, {literal(p)}) THEN {w} ELSE 0 END" for p, w in signs)


_SPANS = f"""{_SECTIONS}, raw AS (SELECT doc_id, section_type, unnest(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 3)) AS text, generate_subscripts(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 3), 1) - 1 AS span_no FROM sections),
summed AS (SELECT *, {_signs(label.FIXED_SIGNS)} AS f0, {_signs(label.VARIABLE_SIGNS)} AS v FROM raw),
scored AS (SELECT *, f0 + CASE WHEN length(text) > 80 AND f0 >= 3 THEN 2 ELSE 0 END + CASE WHEN length(text) < 10 AND v = 0 THEN 1 ELSE 0 END AS f FROM summed),
labelled AS (SELECT *, CASE WHEN v >= 4 THEN 'VARIABLE' WHEN f >= 5 AND v <= 1 THEN 'FIXED' WHEN f >= 3 AND v = 0 THEN 'FIXED' WHEN v >= 2 AND f <= 2 THEN 'VARIABLE' ELSE 'UNCERTAIN' END AS label0, CASE WHEN v >= 4 THEN least(0.9, 0.6 + v * 0.08) WHEN f >= 5 AND v <= 1 THEN least(0.9, 0.6 + f * 0.06) WHEN (f >= 3 AND v = 0) OR (v >= 2 AND f <= 2) THEN 0.65 ELSE 0.5 END AS conf0 FROM scored),
spans AS (SELECT *, CASE WHEN b THEN 'FIXED' ELSE label0 END AS label, round(CASE WHEN b THEN 0.55 ELSE conf0 END, 6)::DOUBLE AS confidence FROM (SELECT *, coalesce(label0 = 'UNCERTAIN' AND length(text) <= 15 AND lag(label0) OVER w = 'FIXED' AND lead(label0) OVER w = 'FIXED', false) AS b FROM labelled WINDOW w AS (PARTITION BY doc_id, section_type ORDER BY span_no)))"""


@query(f"WITH {_SPANS} SELECT doc_id, section_type, CAST(span_no AS INTEGER) AS span_no, label, confidence FROM spans")
def label_spans(spark: SparkSession, d: str) -> DataFrame:
    return label.marked(sections(spark, d)).select("doc_id", "section_type", "span_no", "label", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_SPANS} SELECT doc_id, count(*) AS total_spans, round_even(sum(CASE WHEN label = 'FIXED' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1), 3) AS fixed_ratio, round_even(sum(CASE WHEN label = 'VARIABLE' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1), 3) AS variable_ratio FROM spans GROUP BY doc_id")
def label_ratios(spark: SparkSession, d: str) -> DataFrame:
    return label.ratios(label.marked(sections(spark, d))).select("doc_id", "total_spans", "fixed_ratio", "variable_ratio")


@query(
    f"""WITH {_LINES}, n AS MATERIALIZED (SELECT doc_id, line_no, line, {_NORM.format('line')} AS norm FROM lines)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, sha256(norm)[1:16] AS hash, CAST(CASE WHEN length(norm) > 2 THEN len({_GRAMS.format('norm')}) ELSE 0 END AS INTEGER) AS grams, CAST(length(line) * 2 AS BIGINT) AS tokens FROM n"""
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return own.select("doc_id", "line_no", fn.text_hash("line").alias("hash"), F.size(fn.grams(fn.normalized("line"))).alias("grams"), fn.tokens_estimate("line").alias("tokens"))


_BLOCKS = f"""{_SECTIONS}, whole AS (SELECT doc_id, section_type, ord, '=== ' || section_type || ' ===' || chr(10) || content || chr(10) || chr(10) AS w FROM sections),
blocks AS (SELECT doc_id, ord, i, CASE WHEN big THEN section_type || '(' || (i + 1) || ')' ELSE section_type END AS name, CASE WHEN big THEN '=== ' || section_type || '(' || (i + 1) || ') ===' || chr(10) || w[i * 1000 + 1:i * 1000 + 1000] || chr(10) || chr(10) ELSE w END AS b FROM (SELECT *, length(w) * 2 > 2000 AS big, unnest(generate_series(0, CASE WHEN length(w) * 2 > 2000 THEN (length(w) - 1) // 1000 ELSE 0 END)) AS i FROM whole)),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) AS k, length(b) * 2 AS n FROM blocks)"""


@query(
    f"""WITH RECURSIVE {_BLOCKS}, fold AS (SELECT doc_id, k, name, b, n AS size, 0 AS chunk_no FROM seq WHERE k = 1
UNION ALL SELECT s.doc_id, s.k, s.name, s.b, CASE WHEN f.size + s.n > 2000 THEN s.n ELSE f.size + s.n END, f.chunk_no + CASE WHEN f.size + s.n > 2000 THEN 1 ELSE 0 END FROM fold f JOIN seq s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
SELECT doc_id, chunk_no, string_agg(name, ' + ' ORDER BY k) AS section_names, sha256(string_agg(b, '' ORDER BY k)) AS prompt_sha256 FROM fold GROUP BY doc_id, chunk_no"""
)
def pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.packed(sections(spark, d), 2000).select("doc_id", "chunk_no", "section_names", F.sha2("prompt", 256).alias("prompt_sha256"))


_TAIL = "CASE WHEN length(p) <= 150 THEN p WHEN instr(right(p, 150), chr(10)) - 1 > 0 AND instr(right(p, 150), chr(10)) - 1 < 75 THEN right(p, 150)[instr(right(p, 150), chr(10)) + 1:] ELSE right(p, 150) END"


@query(f"WITH c AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, coalesce({_TAIL}, '') AS overlap FROM c")
def overlap_tail(spark: SparkSession, d: str) -> DataFrame:
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t(spark, d, "conversations").withColumn("p", prev).select("conv_id", "turn", chunk.overlap_tail("p", 2000).alias("overlap"))


_GREEDY = f"""{_SECTIONS}, own AS (SELECT doc_id, section_type AS name, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos, count(*) OVER (PARTITION BY doc_id) AS many,
  2 * (length(content) + length(section_type) + 11) AS n, section_type = 'scope' OR CAST(('0x' || substr(md5(section_type), 1, 8)) AS BIGINT) % 1000 / 1000.0 <= 0.5 AS seed FROM sections),
aff(a, b, w) AS (VALUES ('notice', 'scope', 0.9), ('evaluation', 'qualification', 0.85), ('scope', 'instructions', 0.3)),
pair AS (SELECT s.doc_id, s.pos AS seed_pos, c.name, c.pos, c.n, coalesce(max(w), 0) AS w FROM own s JOIN own c ON s.doc_id = c.doc_id AND s.name <> c.name
  LEFT JOIN aff ON (aff.a = s.name AND aff.b = c.name) OR (aff.b = s.name AND aff.a = c.name) WHERE s.seed AND s.many > 3 GROUP BY ALL),
step AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seed_pos, opens DESC, w DESC, pos) AS k
  FROM (SELECT doc_id, seed_pos, name, pos, n, w, FALSE AS opens FROM pair UNION ALL SELECT doc_id, pos, name, pos, n, 1, TRUE FROM own WHERE seed AND many > 3)),
fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS chunks, CAST(-1 AS BIGINT) AS c, FALSE AS live, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS budget FROM (SELECT DISTINCT doc_id FROM step)
UNION ALL SELECT doc_id, k, CASE WHEN joins THEN list_append(names, name) ELSE names END, CASE WHEN joins THEN list_append(chunks, c + CAST(opens AS BIGINT)) ELSE chunks END, c + CAST(opens AND joins AS BIGINT),
  CASE WHEN opens THEN joins ELSE live END, CASE WHEN NOT joins THEN total WHEN opens THEN n ELSE total + n END, CASE WHEN opens AND joins THEN 3000 WHEN joins AND total + n > budget THEN CAST(floor(budget * 1.5) AS BIGINT) ELSE budget END
  FROM (SELECT s.doc_id, s.k, s.name, s.n, s.opens, f.names, f.chunks, f.c, f.live, f.total, f.budget,
    NOT list_contains(f.names, s.name) AND (s.opens OR (f.live AND (f.total + s.n <= f.budget OR (s.w >= 0.8 AND f.total + s.n <= floor(f.budget * 1.5))))) AS joins FROM fold f JOIN step s ON s.doc_id = f.doc_id AND s.k = f.k + 1)),
done AS (SELECT doc_id, unnest(names) AS name, unnest(chunks) AS c, generate_subscripts(names, 1) AS nth FROM (SELECT doc_id, max_by(names, k) AS names, max_by(chunks, k) AS chunks FROM fold GROUP BY doc_id)),
rest AS (SELECT o.doc_id, o.name, (SELECT max(c) + 1 FROM done d WHERE d.doc_id = o.doc_id) AS c, o.pos AS nth FROM own o ANTI JOIN done d ON d.doc_id = o.doc_id AND d.name = o.name WHERE o.doc_id IN (SELECT doc_id FROM done)),
few AS (SELECT doc_id, name, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM own WHERE seed AND many <= 3),
pack AS (SELECT doc_id, name, k, n AS total, CAST(0 AS BIGINT) AS c FROM few WHERE k = 1
UNION ALL SELECT s.doc_id, s.name, s.k, CASE WHEN f.total + s.n > 3000 THEN s.n ELSE f.total + s.n END, f.c + CAST(f.total + s.n > 3000 AS BIGINT) FROM pack f JOIN few s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
SELECT doc_id, CAST(c AS INTEGER) AS chunk_no, string_agg(name, ' + ' ORDER BY nth) AS section_names FROM (SELECT * FROM done UNION ALL SELECT * FROM rest UNION ALL SELECT doc_id, name, c, k FROM pack) GROUP BY doc_id, c"""


@query(f"WITH RECURSIVE {_GREEDY}")
def affinity_cluster(spark: SparkSession, d: str) -> DataFrame:
    """CHK-4: the steps of the greedy choice one after another, in SQL by recursion"""
    own = sections(spark, d)
    seeds = chunk.selected(own, own.where("section_type = 'scope'"), 0.5).select("doc_id", "section_type", F.col("ord").alias("rank"))
    got = chunk.clustered(own, seeds, {("notice", "scope"): 0.9, ("evaluation", "qualification"): 0.85, ("scope", "instructions"): 0.3}, 3000, degrade=3)
    return got.select("doc_id", "chunk_no", F.array_join("sections", " + ").alias("section_names"))


_USAGE = "(SELECT event_id, ts, user_id, event_type AS model, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, value AS duration, event_type <> 'error' AS success FROM events)"


def usage(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("success"), (F.col("value") / 1000).alias("cost"))


@query(f"SELECT model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(duration), 4) AS duration, round(count(*) FILTER (success) / count(*) * 100, 6) AS success_rate, round(avg(tokens), 6) AS avg_tokens FROM {_USAGE} GROUP BY model")
def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    return stats.usage_totals(usage(spark, d), "model").select("model", "calls", "tokens", F.round("duration", 4).alias("duration"), F.round("success_rate", 6).alias("success_rate"), F.round("avg_tokens", 6).alias("avg_tokens"))


@query(f"SELECT user_id, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(count(*) FILTER (success) / count(*) * 100, 6) AS success_rate FROM {_USAGE} GROUP BY user_id")
def usage_by_user(spark: SparkSession, d: str) -> DataFrame:
    return stats.usage_totals(usage(spark, d), "user_id").select("user_id", "calls", "tokens", F.round("success_rate", 6).alias("success_rate"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def usage_recent(spark: SparkSession, d: str) -> DataFrame:
    return stats.newest(t(spark, d, "events"), 25, "ts", "event_id").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    return stats.last_n_by(t(spark, d, "events"), 3, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 1000 * CASE l_returnflag WHEN 'A' THEN 0.002 WHEN 'N' THEN 0.001 ELSE 0.0 END + l_tax / 1000 * CASE l_returnflag WHEN 'A' THEN 0.006 WHEN 'N' THEN 0.002 ELSE 0.0 END, 12) AS cost FROM lineitem")
def priced_usage(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("l_returnflag") == "A", "qwen-plus-latest").when(F.col("l_returnflag") == "N", "deepseek-chat").otherwise("other")
    own = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", model.alias("model"), F.col("l_quantity").alias("prompt_tokens"), F.col("l_tax").alias("completion_tokens"))
    return stats.priced(own).select("l_orderkey", "l_linenumber", F.round("cost", 12).alias("cost"))


@query(f"SELECT CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / 400000 * 100, 6) AS token_pct, CASE WHEN sum(tokens) / 400000 * 100 >= 100 THEN 'critical' WHEN sum(tokens) / 400000 * 100 >= 80 THEN 'warning' END AS severity FROM {_USAGE}")
def billing_status(spark: SparkSession, d: str) -> DataFrame:
    got = stats.billing_status(usage(spark, d), 400_000, 0)
    return got.select("tokens", F.round("token_pct", 6).alias("token_pct"), F.get(F.filter("alerts", lambda a: a["type"] == "token_usage"), F.lit(0))["severity"].alias("severity"))


@query("WITH h AS (SELECT l_shipmode_id AS rule_id, count(*) AS hit_count FROM (SELECT l_returnflag || '-' || l_linestatus AS l_shipmode_id FROM lineitem) GROUP BY 1) SELECT rule_id, hit_count, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS total_reports, round(hit_count / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 3) AS hit_rate FROM h")
def rule_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("rule_id"), F.lit("x").alias("description"))
    reports = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("report_id")).agg(F.to_json(F.struct(F.collect_list(item).alias("rule_violations"))).alias("report_data"))
    return stats.rule_effectiveness(reports)


@query("SELECT 'p_brand' AS dimension, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2")
def rule_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.rule_counts(t(spark, d, "part"), "p_brand", "p_type", "p_size")


_SEV = "CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


@query(f"WITH r AS (SELECT {_SEV} AS severity, CASE WHEN p_partkey % 4 = 0 THEN 'chapter_required' ELSE 'forbidden' END AS type, p_size AS weight FROM part) SELECT count(*) FILTER (severity = 'high' OR (type = 'chapter_required' AND weight >= 20)) AS high, count(*) FILTER (NOT (severity = 'high' OR (type = 'chapter_required' AND weight >= 20)) AND severity <> 'low') AS medium, count(*) FILTER (severity = 'low') AS low FROM r")
def risk_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.risk_distribution(t(spark, d, "part").select(F.expr(_SEV).alias("severity"), F.when(F.col("p_partkey") % 4 == 0, "chapter_required").otherwise("forbidden").alias("type"), F.col("p_size").alias("weight")))


@query("WITH n AS (SELECT max(o_orderdate) AS m FROM orders), r AS (SELECT o_custkey AS user_id, o_totalprice / 4000 AS score, o_orderdate >= date_trunc('year', m) AS mon FROM orders, n) SELECT user_id, count(*) AS total_reports, count(*) FILTER (mon) AS month_reports, count(*) FILTER (mon AND score >= 85) AS passed, count(*) FILTER (mon AND score < 40) AS critical, count(*) FILTER (mon AND score >= 40 AND score < 60) AS high, count(*) FILTER (mon AND score >= 60 AND score < 85) AS medium FROM r GROUP BY user_id")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    # the month is the last year here, as the data has few orders a month: its first day stands for the month's
    last = F.broadcast(o.agg(F.date_trunc("year", F.max("o_orderdate")).alias("_y")))
    own = o.crossJoin(last).select(F.col("o_custkey").alias("user_id"), (F.col("o_totalprice") / 4000).alias("score"), F.when(F.col("o_orderdate") >= F.col("_y"), F.lit("2020-01-15")).otherwise(F.lit("2019-01-15")).cast("timestamp").alias("created_at"))
    return stats.member_dashboard(own, F.lit("2020-01-20").cast("timestamp")).select("user_id", "total_reports", "month_reports", "passed", "critical", "high", "medium")


@query("WITH m AS (SELECT strftime(unnest(generate_series(TIMESTAMP '1995-02-01', TIMESTAMP '1995-07-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) SELECT month, count(o_orderkey) AS n FROM m LEFT JOIN orders ON strftime(o_orderdate, '%Y-%m') = month GROUP BY month")
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return stats.monthly_trend(t(spark, d, "orders"), F.lit("1995-07-15").cast("timestamp"), "o_orderdate")


@query("SELECT o_orderkey, c_name, CASE WHEN o_totalprice / 4000 >= 85 THEN 'pass' WHEN o_totalprice / 4000 >= 60 THEN 'medium' WHEN o_totalprice / 4000 >= 40 THEN 'high' ELSE 'critical' END AS risk_level FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5")
def recent_reports(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("checked_by"), F.col("o_custkey").alias("file_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_totalprice") / 4000).alias("total_score"))
    f = t(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("filename"))
    return stats.recent_with_files(r, f).select(F.col("report_id").alias("o_orderkey"), F.col("filename").alias("c_name"), "risk_level")


@query("SELECT o_orderkey FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '12') AND o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def report_history(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"))
    return stats.history(own, "12", "1995-01-01", "1997-01-01").select(F.col("report_id").alias("o_orderkey"))


@query(f"WITH {_FOUND} SELECT coalesce(location, '') AS section, count(*) AS total, count(*) FILTER (risk_level = 'critical') AS critical, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low FROM found WHERE rule_type = 'forbidden' GROUP BY 1")
def risk_heatmap(spark: SparkSession, d: str) -> DataFrame:
    own = rules.forbidden(sections(spark, d), pack(spark)).withColumn("section", fn.section_name("location"))
    return stats.risk_heatmap(own)


@query(f"WITH {_FOUND}, {_MODEL_ONLY}, both_ AS (SELECT doc_id, 'rule' AS source, rule_id AS name, risk_level, weight FROM found UNION ALL SELECT doc_id, 'llm', type, risk_level, weight FROM model) SELECT doc_id, source, name, risk_level, weight::DOUBLE AS weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}, weight DESC, source, name) AS INTEGER) AS rank FROM both_ QUALIFY rank <= 5")
def top_violations(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_findings(found(spark, d), modelled(spark, d))


@query(f"WITH {_FOUND}, {_MODEL_ONLY}, m AS (SELECT DISTINCT * FROM {values(MAPPINGS, 'rule_id, platform, code')}), p AS (SELECT f.doc_id, platform, count(DISTINCT code) AS codes, count(*) AS violations, count(*) FILTER (risk_level = 'high') AS h FROM found f JOIN m USING (rule_id) GROUP BY ALL) SELECT doc_id, platform, codes, violations, h + (SELECT count(*) FROM model x WHERE x.doc_id = p.doc_id AND risk_level = 'high') AS high FROM p")
def platform_summary(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([(*x, "") for x in MAPPINGS], "rule_id string, platform string, platform_code string, description string")
    got = stats.platform_summary(rules.platform_codes(found(spark, d), m), modelled(spark, d))
    return got.select("doc_id", "platform", F.size("codes").cast("long").alias("codes"), "violations", "high")


_FEED = "(SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'false_positive' WHEN 'click' THEN 'false_positive' ELSE 'missed' END AS f FROM events)"


@query(
    f"""WITH s AS (SELECT user_id, list(CASE f WHEN 'confirm' THEN 0.02 WHEN 'false_positive' THEN -0.05 ELSE 0.0 END::DOUBLE ORDER BY ts, event_id) AS e, count(*) AS total_feedbacks, count(*) FILTER (f = 'false_positive') AS false_positive_count FROM {_FEED} GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, e), lambda c, x: CASE WHEN x = 0 THEN c ELSE least(1.0::DOUBLE, greatest(0.5::DOUBLE, c + x)) END), 9) AS current_confidence, total_feedbacks, false_positive_count, false_positive_count >= 3 AS needs_review, false_positive_count / total_feedbacks >= 0.3 AS alert FROM s"""
)
def feedback_fold(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type").isin("error", "click"), "false_positive").otherwise("missed")
    own = t(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("feedback_type"))
    return state.feedback_state(own, "user_id").select("user_id", F.round("current_confidence", 9).alias("current_confidence"), "total_feedbacks", "false_positive_count", "needs_review", "alert")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
fold AS (SELECT user_id, event_id, k, [t] AS last, true AS accepted FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN len(last) < 3 THEN list_append(last, t) WHEN last[1] <= t - 345600000000 THEN list_append(last[2:], t) ELSE last END, len(last) < 3 OR last[1] <= t - 345600000000 FROM fold f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, accepted FROM fold"""
)
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return state.rate_limited(t(spark, d, "events"), most=3, seconds=345_600)


@query(f"WITH q AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 100 END AS fl, CASE WHEN c_custkey % 2 = 0 THEN 50000 ELSE 1000000 END AS tl FROM customer), u AS (SELECT user_id, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens FROM {_USAGE} WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY user_id) SELECT q.user_id, coalesce(files, 0) AS files_used, greatest(0, fl - coalesce(files, 0)) AS files_remaining, greatest(0, tl - coalesce(tokens, 0)) AS tokens_remaining, greatest(0, fl - coalesce(files, 0)) <= 0 OR greatest(0, tl - coalesce(tokens, 0)) <= 0 AS exhausted FROM q LEFT JOIN u USING (user_id)")
def quota_status(spark: SparkSession, d: str) -> DataFrame:
    users = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "free").otherwise("pro").alias("plan"))
    got = state.quota_status(usage(spark, d).withColumn("files", F.lit(1)), users, F.lit("2024-01-10").cast("timestamp"))
    return got.select("user_id", "files_used", "files_remaining", "tokens_remaining", "exhausted")


@query(f"SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) <= 5 AS file_ok, coalesce(sum(tokens) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300 AS token_ok FROM {_USAGE}")
def quota_consume(spark: SparkSession, d: str) -> DataFrame:
    u = usage(spark, d)
    a = state.files_accepted(u, 5).withColumnRenamed("accepted", "file_ok")
    return state.tokens_accepted(a, 300).select("event_id", "file_ok", F.col("accepted").alias("token_ok"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_brand").alias("platform"), F.col("p_type").alias("rule_type"), "p_partkey", "p_size")
    old = p.where("p_partkey % 7 <> 0").withColumn("description", F.lit("old"))
    new = p.where("p_partkey % 5 <> 0").withColumn("description", F.when(F.col("p_size") % 4 == 0, "new").otherwise("old"))
    return old, new


@query("WITH a AS (SELECT * FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT * FROM part WHERE p_partkey % 5 <> 0) SELECT CAST(coalesce(a.p_partkey, b.p_partkey) AS VARCHAR) AS rule_id, CASE WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_partkey IS NULL THEN 'added' ELSE 'changed' END AS status, CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN '' ELSE 'description:old>new' END AS fields FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR b.p_size % 4 = 0")
def rule_diff(spark: SparkSession, d: str) -> DataFrame:
    got = sync.versions_diff(*_versions(spark, d), ["platform", "rule_type", "description"])
    return got.select("rule_id", "status", F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit(":"), f["old"], F.lit(">"), f["new"])), ",").alias("fields"))


@query("WITH i AS (SELECT p_partkey // 2 AS id, count(*) AS n FROM part WHERE p_partkey // 2 >= 100 GROUP BY 1), c AS (SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey % 3 = 0) SELECT count(*) FILTER (c.id IS NULL) AS new_rules, CAST(sum(CASE WHEN c.id IS NULL THEN n - 1 ELSE n END) AS BIGINT) AS updated_rules FROM i LEFT JOIN c USING (id)")
def rule_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    now = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_name").alias("description"))
    new = p.select(F.floor(F.col("p_partkey") / 2).cast("string").alias("rule_id"), F.col("p_name").alias("description"), F.col("p_partkey").alias("seq"))
    return sync.upserted(now, new)[1]


@query("WITH l AS (SELECT * FROM part WHERE p_partkey % 3 <> 0), r AS (SELECT * FROM part WHERE p_brand = 'Brand#11' AND p_partkey % 2 = 0), m AS (SELECT * FROM l WHERE p_brand = 'Brand#11') SELECT count(*) FILTER (m.p_partkey IS NULL) AS new_rules, count(*) FILTER (m.p_partkey IS NOT NULL AND r.p_partkey IS NOT NULL) AS updated_rules, count(*) FILTER (r.p_partkey IS NULL AND m.p_size % 2 = 0) AS disabled_rules FROM m FULL JOIN r ON m.p_partkey = r.p_partkey")
def platform_sync(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_brand").alias("platform"), F.col("p_name").alias("description"), (F.col("p_size") % 2 == 0).alias("enabled"), "p_partkey")
    remote = p.where("platform = 'Brand#11' AND p_partkey % 2 = 0").select("rule_id", "description")
    return sync.synced(p.where("p_partkey % 3 <> 0").drop("p_partkey"), remote, "Brand#11")[1]


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a1') OR contains(lower(p_type), 'a1') OR contains(lower(p_brand), 'a1') OR contains(CAST(p_partkey AS VARCHAR), 'a1') OR contains(lower(p_brand), '#1')")
def rule_search(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_brand").alias("platform"), F.col("p_type").alias("target"), F.col("p_name").alias("description"))
    return sync.searched(p, "A1").select("p_partkey").union(sync.searched(p.withColumn("description", F.lit("")).withColumn("target", F.lit("")), "#1").select("p_partkey")).distinct()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) IN (SELECT DISTINCT year(o_orderdate) FROM orders ORDER BY 1 DESC LIMIT 2)")
def versions_kept(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("version"))
    return sync.kept_versions(own, 2).select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT ON (u) page_id, u AS source_url FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS u FROM pages) WHERE u NOT IN (SELECT split_part(split_part(url, '?', 1), '#', 1) FROM pages WHERE page_id % 10 = 0) ORDER BY u, page_id")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("source_url"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("title"))
    return mine.absent(own, own.where("page_id % 10 = 0")).select("page_id", "source_url")


@query(f"WITH {_SECTIONS} SELECT section_type, CASE WHEN max(CAST(doc_id = 0 AS INT)) = 1 AND max(CAST(doc_id = 1 AS INT)) = 1 THEN 'both' WHEN max(CAST(doc_id = 0 AS INT)) = 1 THEN 'only_in_a' ELSE 'only_in_b' END AS side FROM sections WHERE doc_id IN (0, 1) GROUP BY section_type")
def file_compare(spark: SparkSession, d: str) -> DataFrame:
    return sync.files_compared(sections(spark, d), 0, 1)


_A = r"""regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', {})"""


@query(f"SELECT href, min(page_id) AS page_id FROM (SELECT page_id, unnest({_A.format(1)}) AS href, unnest({_A.format(2)}) AS title FROM pages) WHERE starts_with(href, '/') AND contains(title, 'th') GROUP BY href")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return mine.anchors(t(spark, d, "pages"), "/", "th").select("href", "page_id")


@query("SELECT url AS source_url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1))[1:200] AS title, 'dismissed' AS decision_type FROM pages")
def case_extract(spark: SparkSession, d: str) -> DataFrame:
    return mine.cases(t(spark, d, "pages")).select("source_url", "title", "decision_type")


_K = values(KNOWN, "keyword, rule_id")


@query(f"SELECT k.rule_id, count(*) AS hits FROM documents d JOIN {_K} k ON contains(d.text, k.keyword) WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1")
def case_mine(spark: SparkSession, d: str) -> DataFrame:
    return mine.known_patterns(_cases(spark, d), KNOWN, ["src1", "src2", "src3"]).groupBy("rule_id").agg(F.count("*").alias("hits"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("source").alias("decision_type"), F.col("text").alias("raw_content"), F.lit("").alias("summary"), F.lit(0).alias("is_analyzed"))


@query(f"SELECT doc_id AS case_id, name, rule_id NOT IN ('R-1') AS is_new FROM documents, {values(CANDIDATES, 'name, rule_id, rx, risk')} WHERE source IN ('src1', 'src2', 'src3') AND regexp_matches(text, rx)")
def case_candidates(spark: SparkSession, d: str) -> DataFrame:
    return mine.new_patterns(_cases(spark, d), CANDIDATES, ["R-1"], ["src1", "src2", "src3"]).select("case_id", "name", "is_new")


@query("SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS upheld, count(*) FILTER (lang = 'fr') AS rejected, count(*) FILTER (lang = 'de') AS partial, count(*) FILTER (source IN ('src1', 'src3')) AS analyzed, count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) AS dismissed FROM documents")
def case_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "upheld").when(F.col("lang") == "fr", "rejected").when(F.col("lang") == "de", "partial").otherwise("dismissed")
    own = t(spark, d, "documents").select(kind.alias("decision_type"), F.col("source").isin("src1", "src3").cast("int").alias("is_analyzed"))
    return mine.case_counts(own).select("total", "upheld", "rejected", "partial", "analyzed", "dismissed")


@query("SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS upheld, count(*) FILTER (lang = 'fr') AS rejected, count(*) FILTER (lang = 'de') AS partial, count(*) - count(*) FILTER (lang IN ('en', 'fr', 'de')) AS dismissed FROM documents")
def case_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """Without those that were analysed."""
    kind = F.when(F.col("lang") == "en", "upheld").when(F.col("lang") == "fr", "rejected").when(F.col("lang") == "de", "partial").otherwise("dismissed")
    own = t(spark, d, "documents").select(kind.alias("decision_type"), F.lit(0).alias("is_analyzed"))
    return mine.case_counts(own).select("total", "upheld", "rejected", "partial", "dismissed")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    nodes = n.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("rule").alias("node_type"), F.col("n_name").alias("title"), F.lit("").alias("content"), F.lit("").alias("source"), F.lit("").alias("tags")).union(r.select((F.col("r_regionkey") + 1000).cast("long"), F.lit("regulation"), "r_name", F.lit(""), F.lit(""), F.lit("")))
    edges = n.select(F.col("n_nationkey").cast("long").alias("source_id"), (F.col("n_regionkey") + 1000).cast("long").alias("target_id"), F.when(F.col("n_nationkey") % 2 == 0, "references").otherwise("satisfies").alias("relation"), F.lit(1.0).alias("weight"))
    return nodes, edges


@query("SELECT CAST(n_nationkey AS BIGINT) AS start_id, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def graph_related(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.related(nodes, edges, nodes.where("node_type = 'rule'").select(F.col("id").alias("start_id")), "references").select("start_id", "title")


@query("SELECT id, title FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region) WHERE contains(lower(title), 'a') ORDER BY id LIMIT 20")
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.search(_graph(spark, d)[0], "A").select("id", "title")
