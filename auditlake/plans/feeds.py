"""Sources, sinks and streams on the test tables: files are written to the shared folder first, then read by the operators."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as fn
from auditlake.plans import demo, tender
from auditlake.plans.demo import literal, query, t, values
from auditlake.session import new_folder, put_files
from auditlake.sources import documents, packs
from auditlake.streaming import state as streams

PACK = {
    "base_rules.json": {"rules": [{"id": "R-1", "type": "chapter_required", "target": "notice", "weight": 25}, {"id": "R-2", "type": "keyword_required", "target": "k", "keyword": "price", "target_section": "scope"}, {"id": "R-3", "type": "format_required", "target": "seal", "weight": 2, "severity": "low"}]},
    "forbidden_words.json": {"patterns": {"brand": {"severity": "high", "regex_list": [{"id": "F-1", "pattern": "only [a-z]+", "weight": 20, "message": "brand"}, {"id": "F-2", "pattern": "must", "severity": "low"}]}, "place": {"regex_list": [{"id": "F-3", "pattern": "local"}]}}},
    "industries/a.json": {"rules": [{"id": "IND-AAA-1", "type": "chapter_required", "target": "safety", "weight": 5}]},
    "industries/b.json": {"rules": [{"id": "IND-BBB-1", "type": "forbidden", "target": "x", "pattern": "old", "severity": "critical"}]},
    "manifest.json": {"industries": {"a": {"description": "A goods"}, "b": {"name": "B works"}, "c": "C services"}},
    "platforms/p1.json": {"code": 1},
    "platforms/p2.json": {"code": 2},
}
PROMPTS = {"prompts/review.txt": "Read {text}", "prompts/review_v2.txt": "Read {text} for {law}", "prompts/clause.txt": "Write {rule_id}"}
RULE_FILE = "Rule ID,Platform,Description,Enabled\nX-1,p1,first,true\nX-2,p2,second,False\nX-3,p1,third,\n"


def example(spark: SparkSession) -> str:
    """A folder with a small rule pack, prompts and a rule file."""
    folder = new_folder(spark, "pack")
    put_files(spark, folder, {k: json.dumps(v) for k, v in PACK.items()} | PROMPTS | {"rules.csv": RULE_FILE})
    return folder


_PACK = [
    (0, "R-1", "chapter_required", "notice", 25.0, "medium"), (1, "R-2", "keyword_required", "k", 10.0, "medium"), (2, "R-3", "format_required", "seal", 2.0, "low"), (3, "F-1", "forbidden", "only [a-z]+", 20.0, "high"),
    (4, "F-2", "forbidden", "must", 10.0, "low"), (5, "F-3", "forbidden", "local", 10.0, "medium"), (6, "IND-AAA-1", "chapter_required", "safety", 5.0, "medium"), (7, "IND-BBB-1", "forbidden", "x", 10.0, "critical"),
]


@query(f"SELECT CAST(rule_seq AS INTEGER) AS rule_seq, rule_id, type, target, weight, severity FROM {values(_PACK, 'rule_seq, rule_id, type, target, weight, severity')}")
def rule_pack(spark: SparkSession, d: str) -> DataFrame:
    """SRC-8, SRC-9, SRC-10: base, forbidden words, then industries in order; an industry that is there already is skipped"""
    folder = example(spark)
    own = packs.read_rules(spark, f"{folder}/base_rules.json", f"{folder}/forbidden_words.json", [f"{folder}/industries/{x}.json" for x in ("a", "b", "a")])
    return own.select("rule_seq", "rule_id", "type", "target", "weight", "severity")


@query(f"SELECT * FROM {values([('a', 'A goods'), ('b', 'B works'), ('c', 'C services')], 'industry, description')}")
def industries(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11"""
    return packs.read_manifest(spark, f"{example(spark)}/manifest.json")


@query(f"SELECT * FROM {values([('p1', '1'), ('p2', '2')], 'platform, code')}")
def platform_overrides(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13"""
    return packs.read_platform_overrides(spark, f"{example(spark)}/platforms").select("platform", F.get_json_object("config", "$.code").alias("code"))


@query(f"SELECT name, CAST(version AS INTEGER) AS version, variables FROM {values([('clause', 1, 'rule_id'), ('review', 2, 'law,text')], 'name, version, variables')}")
def prompt_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14"""
    return packs.read_prompts(spark, f"{example(spark)}/prompts").select("name", "version", F.array_join("variables", ",").alias("variables"))


@query("SELECT rule_id, platform, description, enabled FROM (VALUES ('X-1', 'p1', 'first', true), ('X-2', 'p2', 'second', false), ('X-3', 'p1', 'third', true)) AS v(rule_id, platform, description, enabled)")
def rule_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16"""
    return packs.read_rule_file(spark, f"{example(spark)}/rules.csv").select("rule_id", "platform", "description", "enabled")


@query("SELECT CAST(p_partkey AS VARCHAR) AS rule_id, p_name AS description FROM part WHERE p_partkey % 4 <> 3")
def api_answers(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17 after the network: a list, an object with rules, one with data, and a body that does not parse"""
    one = F.concat(F.lit("["), F.to_json(F.struct(F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_name").alias("description"))), F.lit("]"))
    kind = F.col("p_partkey") % 4
    body = F.when(kind == 0, one).when(kind == 1, F.concat(F.lit('{"rules": '), one, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"data": '), one, F.lit("}"))).otherwise("<html>")
    return packs.from_api_answer(spark, t(spark, d, "part").select(body.alias("body")), "rule_id: string, description: string")


_FILES = "(SELECT *, lower(CASE p_partkey % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE 'Docx' END) AS extension, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size * 1200000 END AS length FROM part)"


@query(f"SELECT p_partkey, CASE WHEN extension NOT IN ('pdf', 'docx') THEN 'extension' WHEN length = 0 THEN 'empty' WHEN length > 52428800 THEN 'size' END AS reason FROM {_FILES}")
def files_accepted(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1"""
    k = F.col("p_partkey") % 4
    own = t(spark, d, "part").select("p_partkey", F.lower(F.when(k == 0, "PDF").when(k == 1, "docx").when(k == 2, "txt").otherwise("Docx")).alias("extension"), F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size") * 1_200_000).alias("length"), F.lit(b"").alias("content"))
    ok, bad = documents.accepted(own)
    return ok.select("p_partkey", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("p_partkey", "reason"))


_SIZES = sorted((k.rpartition("/")[2].rpartition(".")[2], len((json.dumps(v) if isinstance(v, dict) else v).encode())) for k, v in (PACK | PROMPTS | {"rules.csv": RULE_FILE}).items())


@query(f"SELECT extension, CAST(length AS BIGINT) AS length FROM {values(_SIZES, 'extension, length')}")
def files_stored(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21: put, then read through any file system that Spark reads"""
    return documents.files(spark, example(spark)).select("extension", "length")


def docx(paragraphs: list[tuple[str, str]], table: list[list[str]]) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    body = "".join(p(x, s) for x, s in paragraphs) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


_DOCX = [("a.docx", [("第一章 招标公告", "Heading1"), ("text", "")], [["x", "y"], ["1", "2"]]), ("b.docx", [("只有一行", "")], [])]
_DOCX_ROWS = [("a.docx", 0, "第一章 招标公告", "Heading1", False), ("a.docx", 1, "text", "", False), ("a.docx", 2, "[TABLE 1]\nx | y\n1 | 2", "", True), ("b.docx", 0, "只有一行", "", False)]


@query("SELECT path, CAST(line_no AS INTEGER) AS line_no, text, style, is_table, NULL AS reason FROM " + values([(*r[:4], r[4]) for r in _DOCX_ROWS], "path, line_no, text, style, is_table") + " UNION ALL SELECT 'c.docx', NULL, NULL, NULL, NULL, 'BadZipFile: File is not a zip file'")
def docx_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2, SRC-4..7: paragraphs, styles and tables; a broken file is a rejected row"""
    raw = spark.createDataFrame([(p, "docx", bytearray(docx(x, y))) for p, x, y in _DOCX] + [("c.docx", "docx", bytearray(b"no zip"))], "path string, extension string, content binary")
    lines, bad = documents.lines_of_files(raw)
    own = lines.select("path", "line_no", "text", "style", "is_table", F.lit(None).cast("string").alias("reason"))
    return own.unionByName(bad.select("path", "reason"), allowMissingColumns=True)


@query(f"SELECT doc_id, violation_count, total_score FROM ({demo.SQL['reports']})")
def reports_written(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1: report rows with the whole row as JSON, read back"""
    folder = new_folder(spark, "reports")
    documents.write_reports(tender.reports(spark, d), folder)
    own = spark.read.parquet(folder)
    return own.select("doc_id", F.variant_get("report_data", "$.violation_count", "long").alias("violation_count"), F.variant_get("report_data", "$.total_score", "double").alias("total_score"))


@query(f"WITH {demo._SECTIONS} SELECT doc_id, section_type, CAST(length(content) AS INTEGER) AS n FROM sections")
def sections_written(spark: SparkSession, d: str) -> DataFrame:
    """SNK-2"""
    folder = new_folder(spark, "sections")
    documents.write_sections(demo.sections(spark, d), folder)
    return spark.read.parquet(folder).select("doc_id", "section_type", F.length("content").alias("n"))


@query("SELECT event_id FROM events WHERE CAST(user_id AS VARCHAR) = '1' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_entries(spark: SparkSession, d: str) -> DataFrame:
    """SNK-6: appended in two parts, then those of a user, newest first"""
    folder = new_folder(spark, "audit")
    own = t(spark, d, "events").select(F.col("event_id").alias("log_id"), "ts", "user_id")
    for part in (0, 1):
        documents.append_audit(own.where(F.col("log_id") % 2 == part), folder)
    return documents.audit_log(spark.read.parquet(folder), "1").select(F.col("log_id").alias("event_id"))


@query(
    f"""WITH {tender._TENDER}, s AS (SELECT doc_id, doc_id // 6 || '-' || doc_id % 3 AS sector, {demo._NORM.format("text")} AS norm, {demo._SCORE} AS score FROM (SELECT *, text AS line FROM tender) WHERE len(regexp_extract_all(text, '[一-鿿]')) >= 3),
n AS (SELECT doc_id // 6 || '-' || doc_id % 3 AS sector, count(*) AS docs FROM documents GROUP BY 1)
SELECT sector, '公开招标' AS method, '施工类' AS project_type, sha256(norm)[1:16] AS hash_id, count(*) AS frequency FROM s JOIN n USING (sector) GROUP BY sector, norm, docs HAVING (docs > 1 AND count(DISTINCT doc_id) = docs) OR (docs = 1 AND max(score) >= 5)"""
)
def fingerprint_tree(spark: SparkSession, d: str) -> DataFrame:
    """LAB-3, SNK-4 (with LAB-2 for a folder of one): fingerprints of a tree of templates, two to a folder, written and read back"""
    path = F.concat(F.lit("/t/"), F.floor(F.col("doc_id") / 6).cast("string"), F.lit("-"), (F.col("doc_id") % 3).cast("string"), F.lit("/公开招标--施工类.docx"))
    folder = new_folder(spark, "fingerprints")
    texts = tender.lines(spark, d).where(F.regexp_count("text", F.lit(fn.CJK)) >= 3).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    own = t(spark, d, "documents").select("doc_id").join(texts, "doc_id", "left").select(path.alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    documents.write_fingerprints(documents.fingerprints_of_templates(own), folder)
    return documents.read_fingerprints(spark, folder).select("sector", "method", "project_type", "hash_id", "frequency")


# STR: streams, run over what is available


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The files of a table, which is one file or a folder of files: as a pattern, as a stream's path without one must be a folder."""
    return spark.readStream.schema(t(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def result_of(stream: DataFrame, mode: str) -> DataFrame:
    """The rows of all micro-batches of one run."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    streams.run_available(stream, lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"), f"{folder}/checkpoint", mode).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query(f"SELECT user_id AS rule_id, current_confidence, total_feedbacks, false_positive_count, needs_review FROM ({demo.SQL['feedback_fold']})")
def stream_feedback(spark: SparkSession, d: str) -> DataFrame:
    """STR-4"""
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type").isin("error", "click"), "false_positive").otherwise("missed")
    own = stream_of(spark, d, "events").select(F.col("user_id").alias("rule_id"), "ts", "event_id", kind.alias("feedback_type"))
    got = result_of(streams.feedback_state(own), "update")
    return got.select("rule_id", F.round("current_confidence", 9).alias("current_confidence"), "total_feedbacks", "false_positive_count", "needs_review")


@query(demo.SQL["rate_limit"])
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """STR-1, STR-2"""
    return result_of(streams.rate_limited(stream_of(spark, d, "events"), most=3, seconds=345_600), "append").drop("late")


@query(f"SELECT k.rule_id, count(*) AS hits FROM documents d JOIN {demo._K} k ON contains(d.text, k.keyword) WHERE source IN ({', '.join(map(literal, tender._DECIDED))}) GROUP BY 1")
def stream_cases(spark: SparkSession, d: str) -> DataFrame:
    """STR-5"""
    folder = new_folder(spark, "cases")
    own = stream_of(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("source").alias("decision_type"), F.col("text").alias("raw_content"), F.lit("").alias("summary"), F.lit(0).alias("is_analyzed"))
    streams.mine_cases(own, f"{folder}/out", f"{folder}/checkpoint", demo.KNOWN, tender._DECIDED).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("rule_id").agg(F.count("*").alias("hits"))


@query(f"SELECT user_id, strftime(ts, '%Y-%m') AS period_key, count(*) AS files_used, CAST(sum(tokens) AS BIGINT) AS tokens_used FROM {demo._USAGE} GROUP BY ALL")
def stream_quota(spark: SparkSession, d: str) -> DataFrame:
    """STR-6"""
    own = stream_of(spark, d, "events").select("ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return result_of(streams.monthly_quota(own), "complete")


def stretched(spark: SparkSession, d: str) -> DataFrame:
    """Usage from events whose days are four times as long, so that they are several months."""
    first = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    ts = F.timestamp_micros(first + 4 * (F.unix_micros(F.col("ts").cast("timestamp")) - first))
    return stream_of(spark, d, "events").select(ts.alias("ts"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))


_STRETCHED = f"(SELECT TIMESTAMP '2024-01-01' + 4 * (ts - TIMESTAMP '2024-01-01') AS ts, user_id, tokens FROM {demo._USAGE})"


@query(f"WITH u AS {_STRETCHED} SELECT user_id, strftime(ts, '%Y-%m') AS period_key, count(*) AS files_used, CAST(sum(tokens) AS BIGINT) AS tokens_used FROM u WHERE date_trunc('month', ts) + INTERVAL 1 MONTH <= (SELECT max(ts) - INTERVAL 1 DAY FROM u) GROUP BY ALL")
def stream_quota_closed(spark: SparkSession, d: str) -> DataFrame:
    """STR-6: months that are over, each given once and then forgotten"""
    return result_of(streams.closed_quotas(stretched(spark, d)), "append")


@query(f"SELECT date_trunc('day', ts) AS start, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (success) AS ok FROM {demo._USAGE} WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL")
def stream_usage_windows(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1 over a stream: closed days by model"""
    own = stream_of(spark, d, "events").select("ts", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_type") != "error").alias("success"))
    return result_of(streams.usage_counts(own, "1 day"), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    f"""WITH e AS (SELECT user_id, ts, tokens, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) AS opens FROM {demo._USAGE} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1 by sessions: closed sessions of users"""
    own = stream_of(spark, d, "events").select("ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    got = result_of(streams.usage_sessions(own, "12 hours"), "append")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
