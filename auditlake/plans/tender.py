"""Operators that need text of their own kind, on the tables of the test data: tender lines, labels and names are laid over the documents by rule, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as fn
from auditlake.operators import bias, chunk, fuse, graph, label, mine, rules, scores, segment, state, stats, sync
from auditlake.plans import demo
from auditlake.plans.demo import literal, query, t, values
from auditlake.plans.review import clause_prompts, review
from auditlake.session import written
from auditlake.sources import documents, packs

#: Lines of a tender document: (line, whether it is a heading, the type of its section). Line i of document d is one of them where (7 d + 3 i) mod 24 is its number.
LINES = [
    ("第一章 招标公告", True, "招标公告"), ("第二章 投标人须知", True, "投标须知"), ("第三章 评标办法（综合评分法）", True, "评审办法"), ("第四章 合同条款及格式", True, "合同条款"),
    ("五、投标文件格式", True, "投标文件格式"), ("投标人资格要求", True, "资格要求"), ("本项目采用公开招标方式进行。", False, None), ("详见投标人须知前附表规定，由招标人另行通知各潜在投标人并予以公告说明事项", False, None),
    ("1.1 招标范围", True, "招标范围"), ("3. 交货时间", False, None), ("（二）技术要求", True, "技术要求"), ("", False, None), ("投标保证金：人民币伍万元整。", True, "投标保证金"), ("第五章 其他", False, None), ("目录：第一章、第二章", False, None), ("第六章 招标公告", True, "招标公告"),
]
_N = 24
_LAID = values([(k, x, kind) for k, (x, _, kind) in enumerate(LINES)], "k, laid, kind")
_TENDER = rf"""tender AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, CAST(i // 12 + 1 AS INTEGER) AS page, CASE WHEN k IS NULL THEN regexp_replace(line, '^\s+|\s+$', '', 'g') ELSE laid END AS text, kind
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) LEFT JOIN {_LAID} ON k = (7 * doc_id + 3 * i) % {_N})"""
_HEADED = f"""{_TENDER},
toc AS (SELECT doc_id, page, bool_or(contains(text, '目录')) AND sum(len(regexp_extract_all(text, '第[一二三四五六七八九十0-9]+章'))) >= 3 AS toc FROM tender GROUP BY ALL),
headed AS (SELECT doc_id, line_no, page, text, CASE WHEN NOT toc THEN kind END AS kind FROM tender JOIN toc USING (doc_id, page))"""
_RAW = f"""{_HEADED},
before AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM headed),
opened AS (SELECT *, kind IS NOT NULL AND kind IS DISTINCT FROM prior AS opens FROM before),
counted AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM opened),
whole AS (SELECT doc_id, sec, max(text) FILTER (opens) AS title, max(kind) FILTER (opens) AS section_type, max(page) FILTER (opens) AS page_start, arg_max(page, line_no) FILTER (text <> '' AND kind IS NULL) AS body_page,
  string_agg(CASE WHEN opens THEN '' WHEN text = '' THEN chr(10) WHEN kind IS NOT NULL THEN chr(10) || '【' || text || '】' || chr(10) ELSE text || chr(10) END, '' ORDER BY line_no) AS content FROM counted WHERE sec > 0 GROUP BY doc_id, sec),
raw AS (SELECT doc_id, CAST(sec - 1 AS INTEGER) AS sec_no, title, section_type, content, page_start, coalesce(body_page, page_start) AS page_end FROM (SELECT *, max(sec) OVER (PARTITION BY doc_id) AS last FROM whole) WHERE sec < last OR trim(content, chr(10) || ' ') <> '')"""
_MAPPED = f"""{_RAW},
closing AS (SELECT doc_id, max(sec_no) AS last, arg_max(section_type, sec_no) AS closing FROM raw GROUP BY doc_id),
mapped AS (SELECT doc_id, section_type, string_agg(content, chr(10) ORDER BY sec_no) FILTER (section_type <> closing OR sec_no = last) AS content, min(sec_no) AS ord FROM raw JOIN closing USING (doc_id) GROUP BY doc_id, section_type)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line_no, page, text)"""
    own = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    laid = F.broadcast(spark.createDataFrame([(k, x) for k, (x, _, _) in enumerate(LINES)], "k int, laid string"))
    both = own.join(laid, (7 * F.col("doc_id") + 3 * F.col("line_no")) % _N == F.col("k"), "left")
    plain = F.regexp_replace("line", r"^[\t\n\f\r ]+|[\t\n\f\r ]+$", "")
    return both.select("doc_id", "line_no", (F.floor(F.col("line_no") / 12) + 1).cast("int").alias("page"), F.when(F.col("k").isNull(), plain).otherwise(F.col("laid")).alias("text"))


def raw_sections(spark: SparkSession, d: str) -> DataFrame:
    return segment.sections_of_lines(lines(spark, d))


def sections(spark: SparkSession, d: str) -> DataFrame:
    return segment.section_map(raw_sections(spark, d))


# SEG: lines, headings, sections


@query(f"WITH {_HEADED} SELECT doc_id, line_no, text AS heading, kind AS section_type FROM headed WHERE kind IS NOT NULL")
def tender_headings(spark: SparkSession, d: str) -> DataFrame:
    """SEG-1, SEG-2, SEG-3"""
    return segment.with_headings(lines(spark, d)).where("heading IS NOT NULL").select("doc_id", "line_no", "heading", "section_type")


@query(f"WITH {_HEADED} SELECT doc_id, page FROM toc WHERE toc")
def tender_contents_pages(spark: SparkSession, d: str) -> DataFrame:
    """SEG-1"""
    pages = lines(spark, d).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return pages.where(segment.is_toc_page("text")).select("doc_id", "page")


@query(f"WITH {_RAW} SELECT doc_id, sec_no, title, section_type, sha256(content) AS content_sha256, page_start, page_end FROM raw")
def tender_sections(spark: SparkSession, d: str) -> DataFrame:
    """SEG-5"""
    return raw_sections(spark, d).select("doc_id", "sec_no", "title", "section_type", F.sha2("content", 256).alias("content_sha256"), "page_start", "page_end")


@query(f"WITH {_MAPPED} SELECT doc_id, section_type, sha256(content) AS content_sha256, ord FROM mapped")
def tender_section_map(spark: SparkSession, d: str) -> DataFrame:
    """SEG-5, the map of types"""
    return sections(spark, d).select("doc_id", "section_type", F.sha2("content", 256).alias("content_sha256"), "ord")


_REQUIRED = values([(x,) for x in segment.REQUIRED], "section_type")


@query(f"WITH {_RAW} SELECT d.doc_id, q.section_type FROM documents d, {_REQUIRED} q WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.doc_id = d.doc_id AND r.section_type = q.section_type)")
def tender_missing_sections(spark: SparkSession, d: str) -> DataFrame:
    """SEG-11, SET-4"""
    return segment.missing_required(raw_sections(spark, d), t(spark, d, "documents"))


@query(
    f"""WITH {_RAW} SELECT doc_id, count(*) AS section_count, sha256(string_agg(content[1:200], '|' ORDER BY sec_no)) AS previews_sha256, array_to_string(list(title ORDER BY sec_no)[1:20], '|') AS headings
FROM raw GROUP BY doc_id"""
)
def tender_previews(spark: SparkSession, d: str) -> DataFrame:
    """SEG-12"""
    return segment.previews(raw_sections(spark, d)).select("doc_id", "section_count", F.sha2(F.array_join("previews", "|"), 256).alias("previews_sha256"), F.array_join("headings", "|").alias("headings"))


_WHOLE = f"{_TENDER}, texts AS (SELECT doc_id, string_agg(CASE WHEN length(text) = 0 OR regexp_matches(text, '^[一二三四五六七八九十0-9（第]') THEN text ELSE 'x' || text END, chr(10) ORDER BY line_no) AS text FROM tender GROUP BY doc_id)"


def whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document as one text; lines that are none of a tender's are marked with an x."""
    own = F.when((F.length("text") == 0) | F.col("text").rlike("^[一二三四五六七八九十0-9（第]"), F.col("text")).otherwise(F.concat(F.lit("x"), "text"))
    return lines(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", own.alias("s")))), lambda x: x["s"]), "\n").alias("text"))


_TITLES = r"""titles AS (SELECT doc_id, list_distinct(list_filter(list_transform(list_concat(list_concat(regexp_extract_all(text, '(?m)^第[一二三四五六七八九十0-9]+[章节部分]\s*(.+?)$', 1), regexp_extract_all(text, '(?m)^[一二三四五六七八九十]+[、.\s]\s*(.+)$', 1)),
  regexp_extract_all(text, '(?m)^[0-9]+[、.\s]\s*(.+)$', 1)), lambda x: trim(x)), lambda x: x <> '')) AS titles FROM texts)"""


@query(f"WITH {_WHOLE}, {_TITLES} SELECT doc_id, unnest(titles) AS title FROM titles")
def tender_chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    """SEG-13"""
    return whole_texts(spark, d).select("doc_id", F.explode(segment.chapter_titles("text")).alias("title"))


_FONTS = "spans AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 3 AS INTEGER) AS page, l_linenumber AS line_no, 9 + l_quantity * 0.25 AS font_size, l_returnflag = 'A' AS bold, l_comment AS text FROM (SELECT *, repeat('x', CAST(l_suppkey % 70 AS INTEGER)) AS l_comment FROM lineitem))"
_BODY = f"""{_FONTS}, sizes AS (SELECT doc_id, page, round(font_size * 2) / 2 AS size FROM spans WHERE font_size >= 11),
by_page AS (SELECT doc_id, page, size FROM (SELECT doc_id, page, size, count(*) AS n FROM sizes GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, size) = 1),
by_doc AS (SELECT doc_id, size FROM (SELECT doc_id, size, count(*) AS n FROM sizes WHERE page > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) = 1),
body AS (SELECT p.doc_id, p.page, coalesce(a.size, b.size, 12.0)::DOUBLE AS body_size FROM (SELECT DISTINCT doc_id, page FROM spans) p LEFT JOIN by_page a USING (doc_id, page) LEFT JOIN by_doc b ON b.doc_id = p.doc_id)"""


def fonts(spark: SparkSession, d: str) -> DataFrame:
    own = t(spark, d, "lineitem")
    return own.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).cast("int").alias("page"), F.col("l_linenumber").alias("line_no"), (9 + F.col("l_quantity") * 0.25).cast("double").alias("font_size"), (F.col("l_returnflag") == "A").alias("bold"), F.repeat(F.lit("x"), (F.col("l_suppkey") % 70).cast("int")).alias("text"))


@query(f"WITH {_BODY} SELECT doc_id, page, body_size FROM body")
def font_bodies(spark: SparkSession, d: str) -> DataFrame:
    """SEG-7"""
    return segment.font_stats(fonts(spark, d))


_RATIO = "(font_size / body_size)"


@query(
    f"""WITH {_BODY} SELECT doc_id, line_no, round(CASE WHEN {_RATIO} > 1.1 THEN least(({_RATIO} - 1) * 3, 0.8) ELSE 0 END + CASE WHEN bold THEN 0.15 ELSE 0 END + CASE WHEN length(text) <= 5 THEN 0.15 WHEN length(text) >= 60 THEN -0.2 ELSE 0 END, 6)::DOUBLE AS score,
CAST(CASE WHEN {_RATIO} >= 1.5 THEN 1 WHEN {_RATIO} >= 1.25 THEN 2 ELSE 3 END AS INTEGER) AS level FROM spans JOIN body USING (doc_id, page)"""
)
def font_headings(spark: SparkSession, d: str) -> DataFrame:
    """SEG-8, SEG-10"""
    own = fonts(spark, d)
    both = own.join(segment.font_stats(own), ["doc_id", "page"])
    return both.select("doc_id", "line_no", F.round(segment.heading_score("font_size", "body_size", "bold", "text"), 6).alias("score"), segment.heading_level("font_size", "body_size").alias("level"))


#: SEG-9: (line, score, bold, whether it is probably a heading).
PROBABLE = [("第一章 招标公告", 0.0, False, True), ("任何文字", 0.6, False, True), ("投标保证金", 0.0, False, True), ("说明", 0.2, True, True), ("说明", 0.2, False, False), ("本项目位于城东", 0.1, True, False), ("123", 0.0, False, False), ("", 0.2, True, False)]


@query(f"SELECT doc_id, known AS probable FROM documents JOIN {values([(k, p) for k, (*_, p) in enumerate(PROBABLE)], 'k, known')} ON k = doc_id % {len(PROBABLE)}")
def probable_headings(spark: SparkSession, d: str) -> DataFrame:
    """SEG-9"""
    own = F.broadcast(spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(PROBABLE)], "k int, text string, score double, bold boolean"))
    both = t(spark, d, "documents").select("doc_id").join(own, F.col("doc_id") % len(PROBABLE) == F.col("k"))
    return both.select("doc_id", segment.is_probable_heading("text", "score", "bold").alias("probable"))


_STYLED = f"""{_TENDER}, styled AS (SELECT doc_id, line_no, page, text, kind IS NOT NULL AS heading, CAST((doc_id + line_no) % 3 + 1 AS INTEGER) AS level, kind, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM tender WHERE text <> ''),
fold AS (SELECT doc_id, k, CASE WHEN heading THEN k END AS opened, CASE WHEN heading THEN kind END AS open_kind, CASE WHEN heading THEN level END AS open_level, false AS inlined FROM styled WHERE k = 1
UNION ALL SELECT s.doc_id, s.k, CASE WHEN s.heading AND NOT coalesce(f.open_kind = s.kind AND s.level >= f.open_level, false) THEN s.k ELSE f.opened END, CASE WHEN s.heading AND NOT coalesce(f.open_kind = s.kind AND s.level >= f.open_level, false) THEN s.kind ELSE f.open_kind END,
  CASE WHEN s.heading AND NOT coalesce(f.open_kind = s.kind AND s.level >= f.open_level, false) THEN s.level ELSE f.open_level END, s.heading AND coalesce(f.open_kind = s.kind AND s.level >= f.open_level, false) FROM fold f JOIN styled s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
parts AS (SELECT doc_id, opened, max(text) FILTER (s.k = opened) AS title, max(open_kind) AS section_type, max(open_level) AS level, rtrim(string_agg(CASE WHEN s.k = opened THEN '' WHEN inlined THEN chr(10) || '【' || text || '】' || chr(10) ELSE text || chr(10) END, '' ORDER BY s.k), chr(10) || ' ') AS content,
  count(*) FILTER (inlined) AS subheadings FROM styled s JOIN fold USING (doc_id, k) WHERE opened IS NOT NULL GROUP BY doc_id, opened)"""


@query(f"WITH RECURSIVE {_STYLED} SELECT doc_id, title, section_type, level, sha256(content) AS content_sha256, subheadings FROM parts WHERE content <> ''")
def styled_sections(spark: SparkSession, d: str) -> DataFrame:
    """SEG-6, SEG-3"""
    kind = F.col("text").isin([x for x, heading, _ in LINES if heading])
    own = lines(spark, d).withColumn("heading", kind).withColumn("level", ((F.col("doc_id") + F.col("line_no")) % 3 + 1).cast("int"))
    return segment.sections_of_styled_lines(own).select("doc_id", "title", "section_type", "level", F.sha2("content", 256).alias("content_sha256"), F.size("headings").cast("long").alias("subheadings"))


@query(
    f"""WITH {_MAPPED}, a AS (SELECT * FROM mapped WHERE (doc_id + ord) % 2 = 0), b AS (SELECT doc_id, section_type, content || '!' AS content FROM mapped WHERE (doc_id + ord) % 3 <> 0),
wins AS (SELECT doc_id, coalesce(x, 0) >= coalesce(y, 0) AS first FROM (SELECT doc_id, count(*) AS x FROM a GROUP BY doc_id) FULL JOIN (SELECT doc_id, count(*) AS y FROM b GROUP BY doc_id) USING (doc_id))
SELECT doc_id, section_type, sha256(CASE WHEN first THEN coalesce(a.content, b.content) ELSE coalesce(b.content, a.content) END) AS content_sha256 FROM a FULL JOIN b USING (doc_id, section_type) JOIN wins USING (doc_id)"""
)
def better_sections(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3: two extractions of the same documents"""
    own = sections(spark, d)
    a = own.where((F.col("doc_id") + F.col("ord")) % 2 == 0)
    b = own.where((F.col("doc_id") + F.col("ord")) % 3 != 0).withColumn("content", F.concat("content", F.lit("!")))
    return segment.better_of(a, b).select("doc_id", "section_type", F.sha2("content", 256).alias("content_sha256"))


@query(
    f"""WITH RECURSIVE {_RAW}, {_STYLED.removeprefix(_TENDER + ", ")}, n AS (SELECT doc_id, count(*) FILTER (heading AND doc_id % 2 = 0) >= 3 AS by_style FROM styled GROUP BY doc_id)
SELECT doc_id, title, section_type, sha256(content) AS content_sha256 FROM parts JOIN n USING (doc_id) WHERE by_style AND content <> '' UNION ALL SELECT doc_id, title, section_type, sha256(content) FROM raw LEFT JOIN n USING (doc_id) WHERE NOT coalesce(by_style, false)"""
)
def docx_sections(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4, SRC-5, SRC-6: paragraphs with and without heading styles"""
    kind = F.col("text").isin([x for x, heading, _ in LINES if heading]) & (F.col("doc_id") % 2 == 0)
    style = F.when(kind, F.concat(F.lit("Heading "), ((F.col("doc_id") + F.col("line_no")) % 3 + 1).cast("string"))).otherwise("Normal")
    own = lines(spark, d).withColumn("style", style).withColumn("is_table", F.lit(False))
    return documents.docx_sections(own).select("doc_id", "title", "section_type", F.sha2("content", 256).alias("content_sha256"))


@query(f"WITH {_TENDER} SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY line_no)) AS tables_sha256 FROM tender WHERE line_no % 5 = 0 GROUP BY doc_id")
def docx_tables(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7"""
    return documents.table_texts(lines(spark, d).withColumn("is_table", F.col("line_no") % 5 == 0)).select("doc_id", F.sha2("tables", 256).alias("tables_sha256"))


# FN: text functions


@query(
    """WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), s AS (SELECT p_partkey, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM p),
each AS (SELECT p_partkey, s, t, unnest(generate_series(2, length(s))) AS k FROM s),
hit AS (SELECT p_partkey, max(k) AS longest FROM each WHERE len(list_filter(generate_series(1, length(s) - k + 1), lambda i: contains(t, s[i:i + k - 1]))) > 0 GROUP BY p_partkey)
SELECT p_partkey, round_even(coalesce(longest, 0) / greatest(length(s), 1), 3) AS similarity FROM s LEFT JOIN hit USING (p_partkey)"""
)
def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    """FN-5"""
    return t(spark, d, "part").select("p_partkey", fn.similarity("p_name", "p_type").alias("similarity"))


#: How a complaint ends: (words, type).
ENDINGS = [("投诉成立", "upheld"), ("投诉不成立，驳回", "rejected"), ("投诉部分成立", "partial"), ("情况复杂", "dismissed")]
_ENDING = f"(SELECT * FROM {values([(k, *x) for k, x in enumerate(ENDINGS)], 'k, ending, decision')})"


@query(
    f"""WITH c AS (SELECT p_partkey, p_name, ending, decision, p_partkey % 12 + 1 AS m, p_partkey % 28 + 1 AS day FROM part JOIN {_ENDING} ON k = p_partkey % 4),
r AS (SELECT *, '经查，参数与品牌不符，' || ending || '。' AS summary FROM c)
SELECT '全国' AS province, 'http://x/' || p_partkey AS source_url, p_name AS title, p_name AS project_name, 'N-' || p_partkey AS project_number, '供应商' || p_partkey AS complainant, '2024-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(day::VARCHAR, 2, '0') AS decision_date,
decision AS decision_type, '参数,品牌' AS complaint_types, summary,
p_name || chr(10) || '一、项目编号：N-' || p_partkey || chr(10) || '二、项目名称：' || p_name || chr(10) || '三、投诉人：供应商' || p_partkey || chr(10) || '五、处理依据及结果' || chr(10) || summary || chr(10) || '六、其他' || chr(10) || '2024年' || m || '月' || day || '日' AS raw_content FROM r"""
)
def case_records(spark: SparkSession, d: str) -> DataFrame:
    """SRC-19 with FN-13, FN-14, FN-15 and FN-16: all fields of a case"""
    ending = F.broadcast(spark.createDataFrame([(k, x) for k, (x, _) in enumerate(ENDINGS)], "k int, ending string"))
    p = t(spark, d, "part").join(ending, F.col("p_partkey") % 4 == F.col("k"))
    key = F.col("p_partkey").cast("string")
    parts = ["<html><head><title>", "p_name", "</title><style>p{}</style></head><body><p>一、项目编号：N-", key, "</p><p>二、项目名称：", "p_name", "</p><p>三、投诉人：供应商", key, "</p><p>五、处理依据及结果</p><p>经查，参数与品牌不符，", "ending", "。</p><p>六、其他</p><p>2024年"]
    html = F.concat(*(x if isinstance(x, Column) else F.col(x) if x in ("p_name", "ending") else F.lit(x) for x in parts), (F.col("p_partkey") % 12 + 1).cast("string"), F.lit("月"), (F.col("p_partkey") % 28 + 1).cast("string"), F.lit("日</p></body></html>"))
    own = mine.cases(p.select(F.concat(F.lit("http://x/"), key).alias("url"), html.alias("html"))).drop("is_analyzed")
    return own.withColumn("complaint_types", F.array_join("complaint_types", ","))


#: FN-17: (path, sector, method, project type).
TEMPLATES = [("/t/铁路工程项目/公开招标--施工类.docx", "铁路工程", "公开招标", "施工类"), ("/t/房建/监理资格后审邀请.docx", "房建", "邀请招标", "服务类"), ("/t/水利/货物询价.docx", "水利", "询价", "货物类"), ("/t/市政/设备预审.docx", "市政", "资格预审", "工程类"), ("/t/市政/竞争性磋商--设计类.docx", "市政", "竞争性磋商", "设计类")]


@query(f"SELECT doc_id, path, sector, method, project_type FROM documents JOIN {values([(k, *x) for k, x in enumerate(TEMPLATES)], 'k, path, sector, method, project_type')} ON k = doc_id % {len(TEMPLATES)}")
def template_names(spark: SparkSession, d: str) -> DataFrame:
    """FN-17"""
    paths = spark.createDataFrame([(k, x[0]) for k, x in enumerate(TEMPLATES)], "k int, path string")
    named = documents.template_names(paths).withColumnRenamed("path", "_p")
    own = t(spark, d, "documents").select("doc_id").join(F.broadcast(paths), F.col("doc_id") % len(TEMPLATES) == F.col("k"))
    return own.join(F.broadcast(named), F.col("path") == F.col("_p")).select("doc_id", "path", "sector", "method", "project_type")


@query(
    """SELECT o_orderkey, 'UFB-' || upper(md5(o_orderpriority || o_orderkey)[1:8]) AS id, regexp_matches(name, '^[A-Z0-9_-]{3,32}$') AS valid, strftime(o_orderdate, '%Y-%m') AS period
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'ABC-1' WHEN 1 THEN 'ab' WHEN 2 THEN 'A B C' ELSE 'X_' || o_orderkey END AS name FROM orders)"""
)
def rule_ids(spark: SparkSession, d: str) -> DataFrame:
    """FN-18, FN-19, FN-20"""
    key = F.col("o_orderkey")
    name = F.when(key % 4 == 0, "ABC-1").when(key % 4 == 1, "ab").when(key % 4 == 2, "A B C").otherwise(F.concat(F.lit("X_"), key.cast("string")))
    return t(spark, d, "orders").select("o_orderkey", fn.short_id("UFB-", F.concat("o_orderpriority", key.cast("string"))).alias("id"), fn.valid_rule_id(name).alias("valid"), fn.period_key("o_orderdate").alias("period"))


#: FN-21: (sentence, a blank of the fingerprints' list, a blank of the markers' list).
BLANKS = [("项目名称为（项目名称）", True, True), ("预算为XXX元", True, True), ("按本办法执行", False, False), ("见【附件】", True, True), ("□同意", False, True), ("此处由招标人填写", True, True), ("根据项目情况确定", True, True), ("详见第二章附表", True, True), ("投标保证金为5万元", False, False)]


@query(f"SELECT doc_id, a AS fingerprint, b AS marker FROM documents JOIN {values([(k, a, b) for k, (_, a, b) in enumerate(BLANKS)], 'k, a, b')} ON k = doc_id % {len(BLANKS)}")
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    """FN-21"""
    own = F.broadcast(spark.createDataFrame([(k, x) for k, (x, _, _) in enumerate(BLANKS)], "k int, s string"))
    both = t(spark, d, "documents").select("doc_id").join(own, F.col("doc_id") % len(BLANKS) == F.col("k"))
    return both.select("doc_id", fn.is_placeholder("s").alias("fingerprint"), fn.is_placeholder("s", "marker").alias("marker"))


# RUL: rules with titles, labels and broken patterns

CHAPTERS = [("T-1", "招标公告"), ("T-2", "投标人须知"), ("T-3", "评标办法"), ("T-4", "技术要求"), ("T-5", "交货")]
_CHAPTERS = values(CHAPTERS, "rule_id, target")


@query(f"WITH {_WHOLE}, {_TITLES} SELECT doc_id, rule_id, '缺少《' || target || '》相关内容' AS description FROM titles, {_CHAPTERS} WHERE len(list_filter(titles, lambda x: contains(x, target) OR contains(target, x))) = 0")
def chapters_missing_by_title(spark: SparkSession, d: str) -> DataFrame:
    """RUL-2"""
    pack = packs.rules_from(spark, [{"rule_id": i, "type": "chapter_required", "target": x} for i, x in CHAPTERS])
    return rules.missing_chapters_by_title(whole_texts(spark, d), pack).select("doc_id", "rule_id", "description")


_SPAN_ROWS = demo._SPANS.split(",\nsummed AS")[0]
_LABELS = f"{_SPAN_ROWS}, spans AS (SELECT *, CASE WHEN (doc_id + span_no) % 3 = 0 THEN 'FIXED' WHEN (doc_id + span_no) % 3 = 1 THEN 'VARIABLE' ELSE 'UNCERTAIN' END AS label FROM raw)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the demo's sections, labelled by their number."""
    k = (F.col("doc_id") + F.col("span_no")) % 3
    return label.spans_of(demo.sections(spark, d)).withColumn("label", F.when(k == 0, "FIXED").when(k == 1, "VARIABLE").otherwise("UNCERTAIN"))


_FREE = """free AS (SELECT doc_id, section_type AS at, string_agg(text, chr(10) ORDER BY span_no) AS text FROM spans WHERE label <> 'FIXED' GROUP BY ALL
UNION ALL SELECT doc_id, '', string_agg(text, chr(10) ORDER BY ord, section_type, span_no) FROM spans JOIN (SELECT doc_id, section_type, ord FROM sections) USING (doc_id, section_type) WHERE label <> 'FIXED' GROUP BY doc_id)"""


@query(
    f"""WITH {_LABELS}, {demo._WHOLE}, {_FREE}, own AS (SELECT doc_id, section_type AS at, content FROM sections UNION ALL SELECT doc_id, '', content FROM whole)
SELECT d.doc_id, rule_id FROM documents d CROSS JOIN rules r LEFT JOIN own o ON o.doc_id = d.doc_id AND o.at = coalesce(r.section, '') LEFT JOIN free f ON f.doc_id = d.doc_id AND f.at = coalesce(r.section, '')
WHERE r.type = 'keyword_required' AND NOT contains(coalesce(f.text, o.content, ''), keyword)"""
)
def keywords_missing_in_free_text(spark: SparkSession, d: str) -> DataFrame:
    """RUL-4"""
    return rules.missing_keywords(t(spark, d, "documents").select("doc_id"), demo.sections(spark, d), demo.pack(spark), spans(spark, d), demo.SYNONYMS).select("doc_id", "rule_id")


_OFFSETS = """placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, section_type ORDER BY span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM spans),
first AS (SELECT f.doc_id, f.section_type, f.rule_seq, f.start, arg_min(p.label, p.span_no) AS label FROM forb f JOIN placed p ON p.doc_id = f.doc_id AND p.section_type = f.section_type AND f.start < p.a + length(p.text) AND f.start + length(f.matched) > p.a GROUP BY ALL)"""
_HITS_ONLY = demo._HITS.removeprefix(demo._SECTIONS).lstrip(",\n")


@query(
    f"""WITH {_LABELS}, {_HITS_ONLY}, {_OFFSETS} SELECT f.doc_id, f.section_type || ' ~第' || line_no || '行' AS location, f.rule_seq, f.start, coalesce(label, '') AS span_label, CASE label WHEN 'UNCERTAIN' THEN 0.4 WHEN 'FIXED' THEN 0.3 ELSE 0.0 END::DOUBLE AS template_confidence
FROM forb f LEFT JOIN first USING (doc_id, section_type, rule_seq, start)"""
)
def forbidden_with_spans(spark: SparkSession, d: str) -> DataFrame:
    """RUL-7, RUL-9, JOI-6: heuristic mode, where template text counts less"""
    return rules.forbidden(demo.sections(spark, d), demo.pack(spark), spans(spark, d)).select("doc_id", "location", "rule_seq", "start", "span_label", "template_confidence")


@query(f"WITH {_LABELS}, {_HITS_ONLY}, {_OFFSETS} SELECT f.doc_id, f.rule_seq, f.start, coalesce(label, '') AS span_label FROM forb f LEFT JOIN first USING (doc_id, section_type, rule_seq, start) WHERE coalesce(label, '') <> 'FIXED'")
def forbidden_outside_templates(spark: SparkSession, d: str) -> DataFrame:
    """RUL-7: fingerprint mode, where template text is trusted"""
    return rules.forbidden(demo.sections(spark, d), demo.pack(spark), spans(spark, d), True).select("doc_id", "rule_seq", "start", "span_label")


#: RUL-11: (type, pattern, why it is rejected).
BROKEN = [("forbidden", "a(b", "does not compile"), ("forbidden", "a*", "matches the empty string"), ("forbidden", "ab+", None), ("chapter_required", None, None), ("other", None, "unknown type"), ("forbidden", "[一-龥]{2}", None)]


@query(f"SELECT CAST(k AS INTEGER) AS rule_seq, reason FROM {values([(k, r) for k, (_, _, r) in enumerate(BROKEN) if r], 'k, reason')}")
def rules_rejected(spark: SparkSession, d: str) -> DataFrame:
    """RUL-11"""
    pack = packs.rules_from(spark, [{"rule_id": f"B-{k}", "type": kind, "target": "x", "pattern": rx} for k, (kind, rx, _) in enumerate(BROKEN)])
    return packs.checked(pack)[1].select("rule_seq", "reason")


# LAB: labels

_LINES10 = f"lines10 AS (SELECT DISTINCT line AS text, {demo._NORM.format('line')} AS n FROM lines WHERE length(line) >= 10)"
_NEAR = f"""near AS (SELECT DISTINCT text FROM (SELECT text, n, {demo._GRAMS.format("n")} AS g FROM lines10 WHERE length(n) > 2) a, (SELECT n, {demo._GRAMS.format("n")} AS g FROM (SELECT DISTINCT {demo._NORM.format("text")} AS n FROM prints) WHERE length(n) > 2) b
  WHERE abs(length(a.n) - length(b.n)) <= greatest(length(a.n) * 0.3, 10) AND len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) >= 0.85)"""
_KNOWN = f"{demo._LINES}, {demo._PRINTS}, {_LINES10}, {_NEAR}, known AS (SELECT l.text, l.text IN (SELECT text FROM near) AS near, sha256(l.n)[1:16] IN (SELECT h FROM prints) AS equal FROM lines10 l)"


@query(f"WITH {_KNOWN} SELECT text, equal OR near AS is_fixed, CASE WHEN equal THEN 0.95 WHEN near THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence FROM known")
def sentences_known(spark: SparkSession, d: str) -> DataFrame:
    """LAB-6"""
    own = demo._own_lines(spark, d).select("text").distinct().withColumn("sid", F.col("text"))
    return label.is_known_fixed(own, demo._prints(spark, d)).select(F.col("sid").alias("text"), "is_fixed", "confidence")


_BLANK = "|".join([*fn.PLACEHOLDERS, "（.*?）"])
_HEURISTIC = ",\nsummed AS" + demo._SPANS.split(",\nsummed AS")[1].split(",\nspans AS")[0]


@query(
    f"""WITH {_KNOWN}, raw AS (SELECT 0 AS doc_id, '' AS section_type, text, 0 AS span_no FROM lines10){_HEURISTIC}
SELECT text, CASE WHEN blank THEN 'VARIABLE' WHEN equal OR near THEN 'FIXED' ELSE label0 END AS label, round(CASE WHEN blank THEN 0.9 WHEN equal THEN 0.95 WHEN near THEN 0.8 ELSE conf0 END, 6)::DOUBLE AS confidence
FROM (SELECT *, regexp_matches(text, {literal(_BLANK)}) AS blank FROM labelled) JOIN known USING (text)"""
)
def sentences_quick_checked(spark: SparkSession, d: str) -> DataFrame:
    """LAB-14 (and LAB-11 before smoothing): by placeholder, equal and near fingerprint, signs"""
    own = demo._own_lines(spark, d).select("text").distinct().withColumn("sid", F.col("text"))
    return label.quick_checked(own, demo._prints(spark, d)).select("text", "label", F.round("confidence", 6).alias("confidence"))


@query("SELECT DISTINCT lang, source AS header FROM documents")
def headers_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """LAB-7, SET-2"""
    return label.headers(t(spark, d, "documents").select("lang", F.col("source").alias("header")), ["lang"])


@query(
    f"""WITH {_LABELS} SELECT doc_id, count(*) AS total_spans, {', '.join(f"round_even(sum(CASE WHEN label = '{x}' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1), 3) AS {x.lower()}_ratio" for x in ('FIXED', 'VARIABLE', 'UNCERTAIN'))} FROM spans GROUP BY doc_id"""
)
def span_ratios(spark: SparkSession, d: str) -> DataFrame:
    """LAB-12"""
    return label.ratios(spans(spark, d))


_RUNS = """runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, section_type ORDER BY span_no) AS run FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY doc_id, section_type ORDER BY span_no) = label THEN 0 ELSE 1 END AS new FROM spans)),
tagged AS (SELECT doc_id, section_type, run, '<<' || tag || '>>' || chr(10) || text || chr(10) || '<</' || tag || '>>' AS text FROM (SELECT doc_id, section_type, run, CASE WHEN label = 'FIXED' THEN 'TEMPLATE' ELSE 'REVIEW' END AS tag, string_agg(text, ' ' ORDER BY span_no) AS text FROM runs GROUP BY doc_id, section_type, run, label))"""


@query(
    f"""WITH {_LABELS}, {_RUNS}, a AS (SELECT doc_id, section_type, string_agg(text, chr(10) ORDER BY run) AS x FROM tagged GROUP BY ALL), b AS (SELECT doc_id, section_type, string_agg(text, chr(10) ORDER BY span_no) AS y FROM spans WHERE label <> 'FIXED' GROUP BY ALL)
SELECT doc_id, section_type, sha256(x) AS tagged_sha256, sha256(y) AS variable_sha256 FROM a LEFT JOIN b USING (doc_id, section_type)"""
)
def span_texts(spark: SparkSession, d: str) -> DataFrame:
    """LAB-13, LAB-14: tagged text and text to review"""
    return label.texts_for_review(spans(spark, d)).select("doc_id", "section_type", F.sha2("tagged", 256).alias("tagged_sha256"), F.sha2("variable", 256).alias("variable_sha256"))


@query(f"WITH {_LABELS} SELECT doc_id, section_type, CAST(span_no AS INTEGER) AS span_no FROM spans WHERE label IN ('VARIABLE', 'UNCERTAIN')")
def spans_to_check(spark: SparkSession, d: str) -> DataFrame:
    """LAB-13"""
    return label.spans_to_check(spans(spark, d)).select("doc_id", "section_type", "span_no")


# FUS and SCO: findings and scores


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role, text[1:20], length(text) % 2 ORDER BY turn) = 1")
def findings_once(spark: SparkSession, d: str) -> DataFrame:
    """FUS-2"""
    own = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.concat(F.lit("《"), "role", F.lit("》")).alias("location"), F.lit("-").alias("description"), F.left("text", F.lit(20)).alias("text"), (F.length("text") % 2).cast("string").alias("risk_level"))
    return fuse.first_of_equal(own).select(F.col("doc_id").alias("conv_id"), F.col("seq").alias("turn"))


_KINDS = ["forbidden", "keyword_required", "chapter_required", "format_required"]


@query(
    f"SELECT r AS rule_type, m AS model_type, coalesce(v, 0.35)::DOUBLE AS threshold FROM (SELECT unnest({_KINDS}) AS r), (SELECT unnest({fuse.KINDS}) AS m) LEFT JOIN {values([(a, b, v) for (a, b), v in fuse.THRESHOLDS.items()], 'a, b, v')} ON a = r AND b = m"
)
def similarity_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """FUS-4"""
    own = spark.createDataFrame([(r, m) for r in _KINDS for m in fuse.KINDS], "rule_type string, model_type string")
    return own.withColumn("threshold", fuse.threshold("rule_type", "model_type"))


_RANKED = f"(SELECT doc_id, sum(p / sqrt(rn)) AS r FROM (SELECT doc_id, {demo._PENALTY} AS p, row_number() OVER (PARTITION BY doc_id ORDER BY {demo._ORDER}, weight DESC) AS rn FROM found) GROUP BY doc_id)"


@query(
    f"""WITH {demo._FUSED}, both_ AS (SELECT doc_id, risk_level FROM found UNION ALL SELECT doc_id, risk_level FROM kept), n AS (SELECT doc_id, {', '.join(f"count(*) FILTER (risk_level = '{x}') AS {x}_count" for x in fuse.RISKS)}, count(*) AS violation_count FROM both_ GROUP BY doc_id),
gone AS (SELECT doc_id, m - coalesce(k, 0) AS dedup_cross_engine FROM (SELECT doc_id, count(*) AS m, sum({demo._PENALTY}) AS w FROM model GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS k FROM kept GROUP BY doc_id) USING (doc_id)),
mp AS (SELECT doc_id, sum({demo._PENALTY}) AS m FROM model GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce({x}_count, 0) AS {x}_count" for x in fuse.RISKS)}, coalesce(violation_count, 0) AS violation_count, coalesce(dedup_cross_engine, 0) AS dedup_cross_engine,
round(greatest(0.0, least(100.0, 100 - CASE WHEN m IS NULL THEN coalesce(r, 0) ELSE coalesce(r, 0) * 0.6 + m * 0.4 END)), 1)::DOUBLE AS total_score FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN {_RANKED} USING (doc_id) LEFT JOIN mp USING (doc_id)"""
)
def reports(spark: SparkSession, d: str) -> DataFrame:
    """FUS-5, SCO-2"""
    own = written(demo.sections(spark, d), "sections")
    found = rules.run(demo.docs(spark, d), own, demo.pack(spark), synonyms=demo.SYNONYMS, format_words=demo.FORMATS)
    got = fuse.reports(demo.docs(spark, d), found, demo.short(fuse.reviewed(own, demo.REVIEWER)))
    return got.select("doc_id", *(f"{x}_count" for x in fuse.RISKS), "violation_count", "dedup_cross_engine", "total_score")


_DIMENSION = "round(greatest(5.0, 100 - coalesce({}, 0)), 1)::DOUBLE"


@query(
    f"""WITH {demo._FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_type ORDER BY weight DESC) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC) AS rn FROM found),
s AS (SELECT doc_id, {', '.join(f"sum(weight / sqrt(k)) FILTER (rule_type = '{x}') AS {n}" for n, x in scores.DIMENSIONS.items())}, sum(weight / sqrt(rn)) AS whole FROM r GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"{_DIMENSION.format(n)} AS {n}" for n in scores.DIMENSIONS)}, {_DIMENSION.format("whole")} AS total_score FROM documents d LEFT JOIN s USING (doc_id)"""
)
def dimension_scores(spark: SparkSession, d: str) -> DataFrame:
    """SCO-1"""
    return scores.rule_scores(demo.docs(spark, d), demo.found(spark, d))


@query(f"WITH {demo._MODEL} SELECT d.doc_id, greatest(0.0, 100 - coalesce(sum(weight), 0))::DOUBLE AS llm_score FROM documents d LEFT JOIN model USING (doc_id) GROUP BY d.doc_id")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """SCO-3"""
    return scores.model_scores(demo.docs(spark, d), demo.modelled(spark, d))


# the whole review


@query(f"SELECT doc_id, confirmed_count, high_risk_count, needs_review_count, advisory_count, risk_level, review_status FROM ({demo.SQL['risk_merge'].replace('FROM model0)', 'FROM model0 WHERE doc_id % 2 = 0)')})")
def review_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The review as one plan: verdicts of all documents. No budget stands in these texts, so the method alone decides whether a model looks at one: at every second."""
    own = t(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "单一来源").otherwise("").alias("method"))
    got = review(own, demo.sections(spark, d), demo.pack(spark), bias.patterns_of(spark, demo.BIAS, demo.BIAS_DEDICATED), synonyms=demo.SYNONYMS, formats=demo.FORMATS, fields=demo.BIAS_FIELDS, reviewer=demo.REVIEWER)
    return got.verdicts.select("doc_id", "confirmed_count", "high_risk_count", "needs_review_count", "advisory_count", "risk_level", "review_status")


# AGG and SRT: statistics and lists


@query(
    f"""WITH {demo._FOUND}, a AS (SELECT doc_id, string_agg(section_type || ':' || length(content), ',' ORDER BY section_type) AS section_lengths FROM sections GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(rule_type || ':' || n, ',' ORDER BY rule_type) AS findings FROM (SELECT doc_id, rule_type, count(*) AS n FROM found GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, section_lengths, findings FROM a FULL JOIN b USING (doc_id)"""
)
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17"""
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias(c)
    return stats.diagnostics(demo.sections(spark, d), demo.found(spark, d)).select("doc_id", flat("section_lengths"), flat("findings_by_type").alias("findings"))


@query(f"SELECT user_id, false_positive_count FROM ({demo.SQL['feedback_fold']}) WHERE needs_review")
def rules_to_review(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10"""
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type").isin("error", "click"), "false_positive").otherwise("missed")
    own = state.feedback_state(t(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("feedback_type")), "user_id")
    return state.rules_to_review(own).select("user_id", "false_positive_count")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size < 25 ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20 OFFSET 5")
def cases_listed(spark: SparkSession, d: str) -> DataFrame:
    """SRT-2"""
    own = t(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("province"), F.when(F.col("p_size") < 25, "upheld").otherwise("rejected").alias("decision_type"), F.col("p_retailprice").alias("decision_date"))
    return mine.listed(own, "Brand#11", "upheld", 5).select(F.col("case_id").alias("p_partkey"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC LIMIT 30")
def announcements(spark: SparkSession, d: str) -> DataFrame:
    """SRT-3"""
    return stats.newest(t(spark, d, "orders"), 30, "o_orderdate", "o_totalprice", "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 50")
def users_newest(spark: SparkSession, d: str) -> DataFrame:
    """SRT-6"""
    return stats.newest(t(spark, d, "customer"), 50, "c_acctbal", "c_custkey").select("c_custkey")


# CHK: packing

AFFINITY = [("notice", "scope", 0.9), ("evaluation", "qualification", 0.85), ("scope", "instructions", 0.3)]
_AFFINITY = values(AFFINITY, "a, b, w")
_WEIGHTS = f"""pairs AS (SELECT DISTINCT x.section_type AS a, y.section_type AS b, length(y.section_type) AS pos FROM sections x JOIN sections y ON x.doc_id = y.doc_id AND x.section_type <> y.section_type),
weighed AS (SELECT p.a, p.b, pos, coalesce(f.w, g.w, 0.0)::DOUBLE AS w FROM pairs p LEFT JOIN {_AFFINITY} f ON f.a = p.a AND f.b = p.b LEFT JOIN {_AFFINITY} g ON g.a = p.b AND g.b = p.a)"""


@query(f"WITH {demo._SECTIONS}, {_WEIGHTS} SELECT a, b, w, CAST(row_number() OVER (PARTITION BY a ORDER BY w DESC, pos, b) AS INTEGER) AS rank FROM weighed")
def ranked_sections(spark: SparkSession, d: str) -> DataFrame:
    """SRT-4, CHK-6"""
    own = demo.sections(spark, d).select("doc_id", "section_type")
    pairs = own.select("doc_id", F.col("section_type").alias("a")).join(own.select("doc_id", F.col("section_type").alias("b")), "doc_id").where("a <> b").select("a", "b").distinct()
    pairs = pairs.withColumn("pos", F.struct(F.length("b"), "b"))
    return chunk.ranked_candidates(pairs, spark.createDataFrame(AFFINITY, "a string, b string, w double")).select("a", "b", "w", "rank")


_SAMPLED = "CAST('0x' || md5(section_type)[1:8] AS BIGINT) % 1000 / 1000 <= 0.3"


@query(
    f"""WITH {demo._HITS}, named AS (SELECT DISTINCT doc_id, section_type FROM forb) SELECT s.doc_id, s.section_type, n.doc_id IS NOT NULL AS is_violated FROM sections s LEFT JOIN named n USING (doc_id, section_type) WHERE n.doc_id IS NOT NULL OR {_SAMPLED}"""
)
def sections_selected(spark: SparkSession, d: str) -> DataFrame:
    """CHK-2, CHK-3"""
    own = demo.sections(spark, d)
    violated = chunk.violated_sections(rules.forbidden(own, demo.pack(spark)), own)
    return chunk.selected(own, violated).select("doc_id", "section_type", "is_violated")


#: CHK-7: (ord, id, high, medium, low, limit of tokens).
GROUPS = [(0, "entry", ["notice"], ["scope"], ["qualification"], 3000), (1, "price", ["evaluation"], ["qualification"], ["notice"], None), (2, "terms", ["instructions"], ["scope", "evaluation"], [], 1000)]
_POINTS = values([(o, i, x, w, m) for o, i, *by, m in GROUPS for xs, w in zip(by, (3, 2, 1), strict=True) for x in xs], "ord, id, section, points, most")
_CLUSTERS = """clusters AS (SELECT doc_id, section_type, content, ord, CAST(ord // 3 % 2 AS INTEGER) AS chunk_no FROM sections)"""
_BEST = f"""best AS (SELECT doc_id, chunk_no, id, greatest(2000, coalesce(most, 0)) AS budget FROM (SELECT doc_id, chunk_no, ord, id, most, sum(points) AS score FROM (SELECT c.doc_id, c.chunk_no, p.* FROM clusters c JOIN {_POINTS} p ON p.section = c.section_type) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY score DESC, ord) = 1)"""


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "ord int, id string, sections_high array<string>, sections_medium array<string>, sections_low array<string>, token_limit_override int")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Sections of even and of odd blocks as two clusters of a document."""
    own = demo.sections(spark, d).select("doc_id", "section_type", "ord", (F.floor(F.col("ord") / 3) % 2).cast("int").alias("chunk_no"))
    return own.groupBy("doc_id", "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section_type"))), lambda x: x["section_type"]).alias("sections"))


@query(f"WITH {demo._SECTIONS}, {_CLUSTERS}, {_BEST} SELECT doc_id, chunk_no, coalesce(id, 'general') AS dimension, CAST(coalesce(budget, 2000) AS INTEGER) AS token_limit FROM (SELECT DISTINCT doc_id, chunk_no FROM clusters) LEFT JOIN best USING (doc_id, chunk_no)")
def best_groups(spark: SparkSession, d: str) -> DataFrame:
    """CHK-7"""
    own = clusters(spark, d).select(F.struct("doc_id", "chunk_no").alias("key"), F.explode("sections").alias("section"))
    return chunk.best_group(own, groups(spark), 2000).select("key.doc_id", "key.chunk_no", "dimension", "token_limit")


def _tail(n: str, p: str) -> str:
    at = f"instr(right({p}, {n}), chr(10)) - 1"
    return f"CASE WHEN length({p}) <= {n} THEN {p} WHEN {at} > 0 AND {at} < {n} // 2 THEN right({p}, {n})[{at} + 2:] ELSE right({p}, {n}) END"


@query(
    f"""WITH {demo._SECTIONS}, {_CLUSTERS}, {_BEST},
texts AS (SELECT doc_id, chunk_no, string_agg(section_type, ' + ' ORDER BY ord) AS section_names, string_agg('=== ' || section_type || ' ===' || chr(10) || content || chr(10) || chr(10), '' ORDER BY ord) AS text FROM clusters GROUP BY ALL),
budgets AS (SELECT *, coalesce(id, 'general') AS dimension, coalesce(budget, 2000) AS token_budget, CAST(ceil(least(greatest(200, coalesce(budget, 2000) * 0.15), 800) / 2) AS BIGINT) AS n, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_no), '') AS prev FROM texts LEFT JOIN best USING (doc_id, chunk_no)),
tails AS (SELECT *, {_tail("n", "prev")} AS tail FROM budgets)
SELECT doc_id, chunk_no, section_names, dimension, CAST(token_budget AS INTEGER) AS token_budget, sha256('<' || CASE WHEN tail <> '' THEN '【上文重叠】' || chr(10) || tail || chr(10) || chr(10) || text ELSE text END || '>') AS prompt_sha256, CAST(length(tail) * 2 AS BIGINT) AS overlap_tokens FROM tails"""
)
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """CHK-8, CHK-5, CHK-7"""
    got = chunk.semantic_chunks(demo.sections(spark, d), clusters(spark, d), groups(spark), 2000, "<{text}>")
    return got.select("doc_id", "chunk_no", "section_names", "dimension", "token_budget", F.sha2("prompt", 256).alias("prompt_sha256"), "overlap_tokens")


_ROUTES = [("R", "model-a"), ("N", "model-b")]


@query(f"SELECT l_orderkey, l_linenumber, coalesce(model, 'model-0') AS model FROM lineitem LEFT JOIN {values(_ROUTES, 'flag, model')} ON flag = l_returnflag")
def models_routed(spark: SparkSession, d: str) -> DataFrame:
    """CHK-9"""
    own = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("dimension"))
    return chunk.routed_models(own, spark.createDataFrame(_ROUTES, "dimension string, model string"), "model-0").select("l_orderkey", "l_linenumber", "model")


@query("SELECT DISTINCT p_brand AS model FROM part UNION SELECT 'Brand#0'")
def models_used(spark: SparkSession, d: str) -> DataFrame:
    """CHK-9"""
    return chunk.models_used(t(spark, d, "part").select(F.col("p_brand").alias("model")), "Brand#0")


# MIN, SYN, GRA, CLS: mining, sync, graph, clauses

_DECIDED = ["src1", "src2", "src3"]
_TODO = f"(SELECT * FROM documents WHERE source IN ({', '.join(map(literal, _DECIDED))}) AND doc_id % 3 <> 0)"


def todo_cases(spark: SparkSession, d: str) -> DataFrame:
    """A third of the cases was analysed before."""
    return demo._cases(spark, d).withColumn("is_analyzed", (F.col("case_id") % 3 == 0).cast("int"))


@query(f"SELECT k.rule_id, count(*) AS hits FROM {_TODO} d JOIN {demo._K} k ON contains(d.text, k.keyword) GROUP BY 1")
def mined_rules(spark: SparkSession, d: str) -> DataFrame:
    """MIN-2, known patterns"""
    return mine.mined(todo_cases(spark, d), demo.KNOWN, demo.CANDIDATES, ["R-1"], _DECIDED)[0]


_NEW = f"SELECT name, rule_id NOT IN ('R-1') AS is_new, risk, count(*) AS hits FROM {_TODO}, {values(demo.CANDIDATES, 'name, rule_id, rx, risk')} WHERE regexp_matches(text, rx) GROUP BY ALL"


@query(_NEW)
def mined_patterns(spark: SparkSession, d: str) -> DataFrame:
    """MIN-2, new patterns"""
    return mine.mined(todo_cases(spark, d), demo.KNOWN, demo.CANDIDATES, ["R-1"], _DECIDED)[1].select("name", "is_new", "risk", "hits")


@query(f"SELECT name, hits FROM ({_NEW}) WHERE is_new ORDER BY hits DESC, name LIMIT 5")
def mined_top(spark: SparkSession, d: str) -> DataFrame:
    """SRT-5"""
    return mine.top_patterns(mine.mined(todo_cases(spark, d), demo.KNOWN, demo.CANDIDATES, ["R-1"], _DECIDED)[1]).select("name", "hits")


@query(
    """WITH f AS (SELECT p_brand AS platform, 'C' || p_size AS platform_code, min(p_name) AS description FROM part GROUP BY ALL), r AS (SELECT DISTINCT p_brand AS platform, 'C' || p_size AS platform_code FROM part WHERE p_partkey % 2 = 0)
SELECT platform, platform_code, description, 'UFB-' || upper(md5(platform || '|' || platform_code)[1:8]) AS rule_id, false AS enabled FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.platform = f.platform AND r.platform_code = f.platform_code)"""
)
def rules_drafted(spark: SparkSession, d: str) -> DataFrame:
    """SYN-4, FN-18"""
    own = t(spark, d, "part").select(F.col("p_brand").alias("platform"), F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("platform_code"), F.col("p_name").alias("description"), "p_partkey")
    return sync.drafted(own.drop("p_partkey"), own.where("p_partkey % 2 = 0")).select("platform", "platform_code", "description", "rule_id", "enabled")


@query(
    """WITH l AS (SELECT * FROM part WHERE p_partkey % 3 <> 0), r AS (SELECT * FROM part WHERE p_brand = 'Brand#11' AND p_partkey % 2 = 0), m AS (SELECT * FROM l WHERE p_brand = 'Brand#11')
SELECT CAST(p_partkey AS VARCHAR) AS rule_id, p_brand AS platform, p_name AS description, p_size % 2 = 0 AS enabled FROM l WHERE p_brand <> 'Brand#11'
UNION ALL SELECT CAST(coalesce(r.p_partkey, m.p_partkey) AS VARCHAR), 'Brand#11', coalesce('remote ' || r.p_name, m.p_name), r.p_partkey IS NOT NULL FROM m FULL JOIN r ON r.p_partkey = m.p_partkey"""
)
def platform_synced(spark: SparkSession, d: str) -> DataFrame:
    """SYN-1: the rules after a sync, where platform_sync has the counts"""
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_brand").alias("platform"), F.col("p_name").alias("description"), (F.col("p_size") % 2 == 0).alias("enabled"), "p_partkey")
    remote = p.where("platform = 'Brand#11' AND p_partkey % 2 = 0").select("rule_id", F.concat(F.lit("remote "), "description").alias("description"))
    return sync.synced(p.where("p_partkey % 3 <> 0").drop("p_partkey"), remote, "Brand#11")[0].select("rule_id", "platform", "description", "enabled")


@query("SELECT CAST(n_nationkey AS BIGINT) AS start_id, r_name AS title, 'references' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE contains(lower(n_name), 'na')) AND n_nationkey % 2 = 0 UNION ALL SELECT CAST(n_nationkey AS BIGINT), r_name, 'satisfies' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE contains(lower(n_name), 'na')) AND n_nationkey % 2 = 1")
def graph_of_rule(spark: SparkSession, d: str) -> DataFrame:
    """GRA-3"""
    nodes, edges = demo._graph(spark, d)
    own = graph.of_rule(nodes, edges, "NA", "references").unionByName(graph.of_rule(nodes, edges, "NA", "satisfies"))
    return own.select("start_id", "title", "relation")


@query(f"WITH {demo._HITS} SELECT doc_id, rule_seq, sha256(rule_id || ': ' || trim(around)) AS prompt_sha256 FROM forb")
def clause_prompts_of_findings(spark: SparkSession, d: str) -> DataFrame:
    """CLS-1 up to the model, SRC-15"""
    own = rules.forbidden(demo.sections(spark, d), demo.pack(spark))
    return clause_prompts(own, "{rule_id}: {text}").select("doc_id", "rule_seq", F.sha2("prompt", 256).alias("prompt_sha256"))


@query(
    """WITH u AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN '/api/check/' || event_type ELSE '/api/' || event_type END AS path FROM events)
SELECT event_id, path, CASE WHEN starts_with(path, '/api/check') THEN 10 WHEN starts_with(path, '/api') THEN 60 END AS most, CASE WHEN starts_with(path, '/api/check') THEN 60 ELSE 30 END AS seconds FROM u"""
)
def limits_of_paths(spark: SparkSession, d: str) -> DataFrame:
    """STR-2: the limit of a path"""
    path = F.when(F.col("event_type").isin("purchase", "error"), F.concat(F.lit("/api/check/"), "event_type")).otherwise(F.concat(F.lit("/api/"), "event_type"))
    limits = spark.createDataFrame([(0, "/api/check", 10, 60), (1, "/api", 60, 30)], "ord int, prefix string, most int, seconds int")
    return state.longest_prefix_limits(t(spark, d, "events").select("event_id", path.alias("path")), limits)
