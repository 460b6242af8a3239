"""Sources over files whose contents are the tables' rows: Word files, rule files and packs are written from a table and read back, so that the work follows the table. And the dedicated bias patterns themselves."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import bias, fuse, sync
from auditlake.plans.demo import literal, query, t, values
from auditlake.session import new_folder, ship
from auditlake.sources import documents, packs

_CONTROL = r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"


def _word_file(text: str) -> bytes:
    """Lines as paragraphs, the first a heading; the last one is the only cell of a table, too."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    lines = text.split("\n")
    run = lambda x: f'<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r>'
    body = "".join(f"<w:p>{'<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if k == 0 else ''}{run(x)}</w:p>" for k, x in enumerate(lines))
    body += f"<w:tbl><w:tr><w:tc><w:p>{run(lines[-1])}</w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def _as_word_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_word_file(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["docx"] * batch.num_rows), pa.array(made, pa.binary())], ["path", "extension", "content"])


_CLEAN = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', '', 'g')"


@query(
    f"""WITH c AS (SELECT doc_id, string_split({_CLEAN}, chr(10)) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS paragraphs, sha256(array_to_string(l, chr(10))) AS text_sha256, CAST(greatest((len(l) - 1) // 30 + 1, len(l) // 30 + 1) AS INTEGER) AS pages, length(trim(l[-1], ' ' || chr(9)))::INTEGER AS table_chars FROM c"""
)
def word_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2, SRC-4..7: every document as a Word file, read back: its paragraphs, pages and table"""
    ship(spark)
    own = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace(F.coalesce("text", F.lit("")), _CONTROL, "").alias("text"))
    lines, bad = documents.lines_of_files(own.mapInArrow(_as_word_files, "path string, extension string, content binary"))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_table"), F.struct("line_no", "text"))))
    found = lines.groupBy("path").agg(body.alias("_l"), F.max("page").alias("pages"), F.max(F.when(F.col("is_table"), F.length("text"))).alias("_t"))
    found = found.select(F.col("path").cast("long").alias("doc_id"), F.size("_l").cast("long").alias("paragraphs"), F.sha2(F.array_join(F.transform("_l", lambda x: x["text"]), "\n"), 256).alias("text_sha256"), "pages", (F.col("_t") - F.length(F.lit("[TABLE 1]\n"))).alias("table_chars"))
    return found.unionByName(bad.select(F.col("path").cast("long").alias("doc_id")), allowMissingColumns=True)


@query("SELECT source, CAST(sum(octet_length(encode(doc_id::VARCHAR || ' ' || n_chars::VARCHAR)) + 1) AS BIGINT) AS length FROM documents GROUP BY source")
def files_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21: a table put as files, a folder for each source, and what a store says of them"""
    folder = new_folder(spark, "store")
    t(spark, d, "documents").select("source", F.concat_ws(" ", "doc_id", "n_chars").alias("line")).write.partitionBy("source").text(folder)
    found = documents.files(spark, folder).where(F.col("extension") == "txt")
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("length").alias("length"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS rule_id, p_brand AS platform, p_name AS description, p_size % 3 <> 0 AS enabled, p_partkey % 2 = 0 AS mandatory FROM part")
def rule_files_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16: rule files with headers of their own form"""
    folder = f"{new_folder(spark, 'rules')}/rules.csv"
    yes = lambda c, a, b: F.when(c, a).otherwise(b)
    t(spark, d, "part").select(F.col("p_partkey").alias("Rule ID"), F.col("p_brand").alias(" Platform"), F.col("p_name").alias("Description"), yes(F.col("p_size") % 3 != 0, "True", "no").alias("Enabled"), yes(F.col("p_partkey") % 2 == 0, "1", "FALSE").alias("mandatory")).write.option("header", True).csv(folder)
    return packs.read_rule_file(spark, folder).select("rule_id", "platform", "description", "enabled", "mandatory")


_BAD = {0: "'(' || p_name", 1: "p_name || '|'", 2: "'[0-9]{2'", 3: "p_name"}


@query(f"SELECT CAST(p_partkey AS INTEGER) AS rule_seq, CASE p_partkey % 5 WHEN 0 THEN 'does not compile' WHEN 1 THEN 'matches the empty string' WHEN 2 THEN 'does not compile' ELSE 'unknown type' END AS reason FROM part WHERE p_partkey % 5 <> 3")
def rules_rejected_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """RUL-11: rules whose patterns do not compile or match nothing, or of no known type"""
    k = F.col("p_partkey") % 5
    rx = F.when(k == 0, F.concat(F.lit("("), "p_name")).when(k == 1, F.concat("p_name", F.lit("|"))).when(k == 2, F.lit("[0-9]{2")).otherwise(F.col("p_name"))
    own = {"rule_seq": F.col("p_partkey").cast("int"), "rule_id": F.col("p_partkey").cast("string"), "type": F.when(k == 4, "other").otherwise("forbidden"), "target": F.lit("t"), "weight": F.lit(1.0), "pattern": rx}
    names = [(c.split()[0], c.split()[1]) for c in packs.RULES.split(", ")]
    rules = t(spark, d, "part").select(*(own.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names))
    return packs.checked(rules)[1].select("rule_seq", "reason")


_KINDS = ["chapter_required", "keyword_required", "forbidden", "format_required", None]


@query(
    f"""WITH k AS (SELECT event_id, {values([(i, x) for i, x in enumerate(_KINDS)], 'i, r').replace('(SELECT * FROM', '(SELECT list(r ORDER BY i) FROM', 1)}[event_id % 5 + 1] AS rule_type, {[*fuse.KINDS]}[event_id % 8 + 1] AS model_type FROM events),
p AS {values([(a, b, v) for (a, b), v in fuse.THRESHOLDS.items()], 'rule_type, model_type, v')} SELECT event_id, coalesce(v, 0.35)::DOUBLE AS threshold FROM k LEFT JOIN p USING (rule_type, model_type)"""
)
def thresholds_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """FUS-4 over pairs of findings"""
    kinds = lambda x: F.array(*(F.lit(k) for k in x))
    own = t(spark, d, "events").select("event_id", F.get(kinds(_KINDS), (F.col("event_id") % 5).cast("int")).alias("rule_type"), F.get(kinds(fuse.KINDS), (F.col("event_id") % 8).cast("int")).alias("model_type"))
    return own.select("event_id", fuse.threshold("rule_type", "model_type").cast("double").alias("threshold"))


#: Texts of which each hits or narrowly misses a dedicated pattern; {} is a number of the row.
_SAYINGS = [
    "本项目须选用同一品牌的产品{}", "投标产品同品牌{}台", "各部件品牌 一致，编号{}", "必须使用{}套配套品牌", "品牌不限{}", "投标人应提供原厂授权书{}份", "须有厂家盖章{}", "提供原厂售后服务承诺{}年", "提供售后承诺{}", "提供CNAS认可的报告{}份",
    "提供检验报告{}", "提供合格证{}", "技术参数不低于{}", "仅接受{}号参数", "功率{}W的指标", "价格{}元", "符合GB/T {}-2015标准", "该标准已于{}年废止", "已废止的{}号规范", "参考{}号文",
]


def _said() -> str:
    """SQL of a part's saying, and of what the dedicated lists find in it: the first pattern, in their order."""
    text = f"replace(([{', '.join(map(literal, _SAYINGS))}])[p_partkey % {len(_SAYINGS)} + 1], '{{}}', CAST(1000 + p_partkey % 9000 AS VARCHAR))"
    cases = []
    for name, (severity, rule, own) in bias.DEDICATED.items():
        of = lambda f, own=own: "CASE " + " ".join(f"WHEN regexp_matches(text, {literal(rx)}) THEN {f(rx, c)}" for rx, c in own) + " END"
        cases.append(f"SELECT p_partkey, {literal(name)} AS pattern_id, {literal(severity)} AS severity, {literal(rule)} AS rule_id, {of(lambda rx, c: f'regexp_extract(text, {literal(rx)})')} AS matched_text, {of(lambda rx, c: f'{c}::DOUBLE')} AS confidence FROM s")
    return f"WITH s AS (SELECT p_partkey, {text} AS text FROM part) SELECT * FROM ({' UNION ALL '.join(cases)}) WHERE matched_text IS NOT NULL"


@query(_said())
def bias_dedicated(spark: SparkSession, d: str) -> DataFrame:
    """BIA-4..8: the dedicated checks as they are, on texts that hit and miss them"""
    saying = F.replace(F.get(F.array(*map(F.lit, _SAYINGS)), (F.col("p_partkey") % len(_SAYINGS)).cast("int")), F.lit("{}"), (1000 + F.col("p_partkey") % 9000).cast("string"))
    own = t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("技术要求").alias("section_type"), saying.alias("content"))
    rx = bias.patterns_of(spark, [{"pattern_id": p, "check_fields": ["technical_params"]} for p in bias.DEDICATED])
    return bias.findings(own, rx).select(F.col("doc_id").alias("p_partkey"), "pattern_id", "severity", "rule_id", "matched_text", "confidence")


@query("SELECT 'sync-' || p_brand AS job, CAST(CASE WHEN k = 3 THEN 2 ELSE 1 END AS INTEGER) AS tries, k <> 4 AS ok FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand) % 5 AS k FROM (SELECT DISTINCT p_brand FROM part))")
def job_runs(spark: SparkSession, d: str) -> DataFrame:
    """SYN-6: a run of a job for each brand: some fail once, some always; the history tells"""
    folder = new_folder(spark, "jobs")
    brands = [r[0] for r in t(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    for k, brand in enumerate(brands, 1):
        state = {"n": 0}

        def act(k: int = k, state: dict = state) -> None:
            state["n"] += 1
            if k % 5 == 4 or (k % 5 == 3 and state["n"] == 1):
                raise OSError("no answer")

        sync.run_job(spark, f"sync-{brand}", act, folder, tries=1 if k % 5 == 4 else 3, wait=lambda _: None)
    return sync.job_history(spark, folder, n=1000).select("job", "tries", "ok")
