"""Rule checks as joins (RUL-*). docs(doc_id), sections(doc_id, section_type, content, ord), rules as sources.packs.RULES, spans as operators.label gives them.

Rules are of bounded number (packs of hundreds or thousands of rows), so they are the broadcast side; documents are never collected. Texts meet the rules by one automaton (operators.scan), not one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from auditlake.functions.text import FLAGS, context_of, line_of, matches
from auditlake.operators.scan import constant, scanning
from auditlake.operators.segment import chapter_titles
from auditlake.sources.packs import quoted

# fixed values: names that stand for a canonical section
TARGETS = {
    "招标公告": "招标公告",
    "投标邀请": "招标公告",
    "采购公告": "招标公告",
    "招标邀请": "招标公告",
    "投标邀请书": "招标公告",
    "竞争性谈判公告": "招标公告",
    "招标范围": "招标范围",
    "采购范围": "招标范围",
    "项目概况": "招标范围",
    "项目背景": "招标范围",
    "项目概述": "招标范围",
    "采购内容": "招标范围",
    "项目概述与招标范围": "招标范围",
    "资格要求": "资格要求",
    "投标人资格": "资格要求",
    "供应商资格": "资格要求",
    "资质要求": "资格要求",
    "合格投标人": "资格要求",
    "投标人资格要求": "资格要求",
    "申请人资格要求": "资格要求",
    "评审办法": "评审办法",
    "评标办法": "评审办法",
    "评审方法": "评审办法",
    "评分标准": "评审办法",
    "评分细则": "评审办法",
    "评审标准": "评审办法",
    "评标标准": "评审办法",
    "综合评分法": "评审办法",
    "投标须知": "投标须知",
    "投标人须知": "投标须知",
    "投标说明": "投标须知",
    "投标要求": "投标须知",
    "投标人须知前附表": "投标须知",
    "投标人须知及前附表": "投标须知",
    "合同条款": "合同条款",
    "合同草案": "合同条款",
    "合同主要条款": "合同条款",
    "采购合同": "合同条款",
    "合同文本": "合同条款",
    "投标文件格式": "投标文件格式",
    "投标文件组成": "投标文件格式",
    "投标文件编制": "投标文件格式",
    "投标文件的编制": "投标文件格式",
    "投标保证金": "投标保证金",
    "预算金额": "预算金额",
    "预算控制价": "预算金额",
    "最高限价": "预算金额",
    "报价要求": "报价要求",
    "履约要求": "履约要求",
    "保密条款": "保密条款",
    "知识产权": "知识产权",
    "招标项目需求": "招标范围",
    "投标人": "资格要求",
    "技术规格": "招标范围",
    "验收标准": "验收标准",
    "耗材与配件": "耗材与配件",
}
FORMAT_WORDS = {"页码": "页码", "密封要求": "密封", "签章要求": "签章", "电子投标": "电子投标", "装订要求": "装订", "目录编排": "目录", "光盘/U盘": "光盘"}
# end of the fixed values

COLUMNS = ["doc_id", "rule_seq", "rule_id", "rule_type", "description", "location", "text", "risk_level", "suggestion", "law_ref", "weight", "start", "matched", "line_no", "span_label", "template_confidence"]


def canonical(name: Column | str, synonyms: dict[str, list[str]] | None = None) -> Column:
    """The canonical section of a name; the name itself if none is known. synonyms: canonical section -> names, instead of TARGETS."""
    c = F.col(name) if isinstance(name, str) else name
    pairs = TARGETS if synonyms is None else {n: kind for kind, names in synonyms.items() for n in names}
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.coalesce(F.create_map(*entries)[c], c) if entries else c


def _finding(df: DataFrame, **values: Column) -> DataFrame:
    none = {"location": "string", "text": "string", "start": "int", "matched": "string", "line_no": "int"}
    base = {c: F.lit(None).cast(t) for c, t in none.items()} | {"rule_type": F.col("type"), "span_label": F.lit(""), "template_confidence": F.lit(0.0)}
    values = base | values
    return df.select(*(values[c].alias(c) if c in values else F.col(c) for c in COLUMNS))


def missing_chapters(docs: DataFrame, sections: DataFrame, rules: DataFrame, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """RUL-1: rules whose canonical target is no section type of the document; always high. Documents without sections are left to missing_chapters_by_title."""
    own = F.broadcast(rules.where("type = 'chapter_required'").withColumn("section_type", canonical("target", synonyms)))
    need = docs.select("doc_id").join(sections.select("doc_id").distinct(), "doc_id", "left_semi").crossJoin(own)
    gone = need.join(sections.select("doc_id", "section_type"), ["doc_id", "section_type"], "left_anti")
    return _finding(gone, risk_level=F.lit("high"), description=F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("缺少《"), "target", F.lit("》章节"))), suggestion=F.coalesce(F.nullif("suggestion", F.lit("")), F.concat(F.lit("请补充《"), "target", F.lit("》章节"))))


def missing_chapters_by_title(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """RUL-2: texts(doc_id, text) of documents without sections: no title contains the target or is contained in it."""
    own = F.broadcast(rules.where("type = 'chapter_required'"))
    both = texts.select("doc_id", chapter_titles("text").alias("_titles")).crossJoin(own)
    gone = both.where(~F.exists("_titles", lambda t: t.contains(F.col("target")) | F.col("target").contains(t)))
    return _finding(gone, risk_level=F.lit("high"), description=F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("缺少《"), "target", F.lit("》相关内容"))), suggestion=F.coalesce(F.nullif("suggestion", F.lit("")), F.concat(F.lit("请补充《"), "target", F.lit("》章节"))))


def whole_text(sections: DataFrame, sep: str = "\n") -> DataFrame:
    """(doc_id, content) of all sections in order."""
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section_type", "content"))), lambda x: x["content"]), sep).alias("content"))


def missing_keywords(docs: DataFrame, sections: DataFrame, rules: DataFrame, spans: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """RUL-3/4: literal keyword missing in its target section, or in all of them; a section that is not there has no text. With spans (fingerprint mode) only spans
    that are not FIXED are searched, unless there is nothing but white space in them. High from weight 15 on, else medium."""
    own = F.broadcast(rules.where("type = 'keyword_required' AND keyword <> ''").withColumn("section", canonical("target_section", synonyms)))
    text = sections.select("doc_id", F.col("section_type").alias("section"), "content").unionByName(whole_text(sections).withColumn("section", F.lit("")))
    if spans is not None:
        free = spans.where("label <> 'FIXED'")
        joined = lambda *o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*o, "text"))), lambda x: x["text"]), "\n").alias("_free")
        free = free.groupBy("doc_id", F.col("section_type").alias("section")).agg(joined("span_no")).unionByName(free.groupBy("doc_id").agg(joined("ord", "section_type", "span_no")).withColumn("section", F.lit("")))
        text = text.join(free, ["doc_id", "section"], "left").withColumn("content", F.when(F.col("_free").rlike(r"(?U)\S"), F.col("_free")).otherwise(F.col("content")))
    need = docs.select("doc_id").crossJoin(own).withColumn("_at", F.coalesce("section", F.lit("")))
    both = need.join(text.select("doc_id", F.col("section").alias("_at"), "content"), ["doc_id", "_at"], "left")
    gone = both.where(~F.coalesce("content", F.lit("")).contains(F.col("keyword")))
    place = F.when(F.col("_at") != "", F.concat(F.lit("应在《"), "_at", F.lit("》中"))).otherwise(F.lit("全文"))
    return _finding(gone, location=place, risk_level=F.when(F.col("weight") >= 15, "high").otherwise("medium"), description=F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("缺少关键字「"), "keyword", F.lit("」"))), suggestion=F.coalesce(F.nullif("suggestion", F.lit("")), F.concat(F.lit("请补充「"), "keyword", F.lit("」相关表述"))))


def missing_formats(docs: DataFrame, sections: DataFrame, rules: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """RUL-8: the word of a format rule is in no section; always low. One pass over sections, one small row per document and rule."""
    words = FORMAT_WORDS if words is None else words
    word = F.coalesce(F.create_map(*(F.lit(x) for kv in words.items() for x in kv))[F.col("target")], F.col("target")) if words else F.col("target")
    own = F.broadcast(rules.where("type = 'format_required'").withColumn("word", word))
    seen = scanning(rules.sparkSession, [(r.rule_seq, r.word, None) for r in own.where("word IS NOT NULL").select("rule_seq", "word").collect()], [])
    if seen is None:
        there = sections.join(own.select("rule_seq", "word"), sections["content"].contains(F.col("word"))).select("doc_id", "rule_seq").distinct()
    else:
        there = sections.select("doc_id", F.explode(seen(F.col("content"))["exact"]).alias("rule_seq")).distinct()
    gone = docs.select("doc_id").crossJoin(own).join(there, ["doc_id", "rule_seq"], "left_anti")
    return _finding(gone, risk_level=F.lit("low"), description=F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("缺少格式规范："), "target")), suggestion=F.coalesce(F.nullif("suggestion", F.lit("")), F.concat(F.lit("请补充关于"), "target", F.lit("的格式要求"))))


def forbidden_matches(sections: DataFrame, rules: DataFrame) -> DataFrame:
    """RUL-5: every match of every pattern in every section: adds start (characters from 0), matched, line_no, text (the match and 20 characters around). The text of a
    section does not leave the join. A section meets the patterns of which it has a literal."""
    own = F.broadcast(rules.where("type = 'forbidden'").withColumn("_rx", F.concat(F.lit(FLAGS), F.coalesce("pattern", quoted("target")))))
    sections = sections.select("doc_id", "section_type", "content")
    seen = scanning(rules.sparkSession, [], [(r.rule_seq, r["_rx"]) for r in own.where("_rx IS NOT NULL").select("rule_seq", "_rx").collect()])
    if seen is None:
        hit = sections.join(own, F.expr("content rlike _rx"))
    else:
        hit = sections.withColumn("rule_seq", F.explode(seen(F.col("content"))["maybe"])).join(own, "rule_seq").where(F.expr("content rlike _rx"))
    each = hit.withColumn("_m", F.explode(matches("content", "_rx"))).withColumn("start", F.col("_m.start")).withColumn("matched", F.col("_m.match"))
    n = F.length("matched")
    near = F.substring("content", F.greatest(F.col("start") - 10, F.lit(0)) + 1, F.col("start") + n + 10 - F.greatest(F.col("start") - 10, F.lit(0)))
    excluded = F.coalesce(F.exists("exclude_contexts", lambda e: near.contains(e)), F.lit(False))
    return each.where(~excluded).select("doc_id", "section_type", *own.drop("_rx").columns, "start", "matched", line_of("content", "start").alias("line_no"), context_of("content", "start", n).alias("text"))


def forbidden(sections: DataFrame, rules: DataFrame, spans: DataFrame | None = None, fingerprint_mode: bool = False) -> DataFrame:
    """RUL-5..7 as findings. With spans: a match in a FIXED span is dropped in fingerprint mode, else it stays with confidence 0.3; UNCERTAIN stays with 0.4."""
    own = forbidden_matches(sections, rules)
    if spans is None:
        own = own.withColumn("span_label", F.lit("")).withColumn("template_confidence", F.lit(0.0))
    else:
        own = with_span_label(own, spans)
        if fingerprint_mode:
            own = own.where("span_label <> 'FIXED'")
        own = own.withColumn("template_confidence", F.when(F.col("span_label") == "UNCERTAIN", 0.4).when(F.col("span_label") == "FIXED", 0.3).otherwise(0.0))
    return _finding(
        own, location=F.concat("section_type", F.lit(" ~第"), F.col("line_no").cast("string"), F.lit("行")), text=F.col("text"), risk_level=F.col("severity"), start=F.col("start"), matched=F.col("matched"), line_no=F.col("line_no"),
        description=F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("发现禁用词: "), "matched")), suggestion=F.coalesce(F.nullif("suggestion", F.lit("")), F.concat(F.lit("请修改「"), "matched", F.lit("」相关表述"))), span_label=F.col("span_label"), template_confidence=F.col("template_confidence"),
    )


def with_offsets(spans: DataFrame) -> DataFrame:
    """RUL-9: approximate offsets: the trimmed lengths of the spans before, and one each."""
    before = Window.partitionBy("doc_id", "section_type").orderBy("span_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return spans.withColumn("approx_start", start).withColumn("approx_end", start + F.length("text"))


def with_span_label(found: DataFrame, spans: DataFrame) -> DataFrame:
    """JOI-6: label of the first span that overlaps a match, '' if none does.

    One sweep over the ends of spans and the starts of matches of a section, from its end: spans follow one another, so the first to overlap is the one that ends first after the match's start, if it begins
    before the match's end. No span meets a match that it is not asked about."""
    own = with_offsets(spans).select("doc_id", "section_type", F.col("approx_end").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct("label", "approx_start").alias("_span"))
    asked = found.withColumn("_at", F.col("start").cast("long")).withColumn("_kind", F.lit(0))
    sweep = Window.partitionBy("doc_id", "section_type").orderBy(F.col("_at").desc(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(own, allowMissingColumns=True).withColumn("_span", F.last("_span", ignorenulls=True).over(sweep)).where("_kind = 0")
    label = F.when(F.col("start") + F.length("matched") > F.col("_span.approx_start"), F.col("_span.label"))
    return both.withColumn("span_label", F.coalesce(label, F.lit(""))).select(*found.columns, "span_label")


@F.arrow_udf(ArrayType(IntegerType()))
def _ending_after(ends: pa.Array, starts: pa.Array) -> pa.Array:
    """For each start the place of the first of the ascending ends that is greater; their number if there is none."""
    return pa.array([None if e.as_py() is None or s.as_py() is None else np.searchsorted(np.asarray(e.as_py(), np.int64), np.asarray(s.as_py(), np.int64), "right").tolist() for e, s in zip(ends, starts, strict=True)], pa.list_(pa.int32()))


def platform_codes(found: DataFrame, mappings: DataFrame) -> DataFrame:
    """RUL-10: adds platform_codes array<struct<platform, code, description>> of a finding's rule id, each (platform, code) once."""
    own = mappings.where("rule_id <> ''").groupBy("rule_id", "platform", F.coalesce("platform_code", F.lit("")).alias("code")).agg(F.min("description").alias("description"))
    own = own.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("platform", "code", "description"))).alias("platform_codes"))
    return found.join(F.broadcast(own), "rule_id", "left").withColumn("platform_codes", F.coalesce("platform_codes", F.array().cast("array<struct<platform:string,code:string,description:string>>")))


HIT = "struct<rule_seq:int,section_type:string,start:int,matched:string,line_no:int,text:string,label:string>"


def run(docs: DataFrame, sections: DataFrame, rules: DataFrame, spans: DataFrame | None = None, fingerprint_mode: bool = False, synonyms: dict[str, list[str]] | None = None, format_words: dict[str, str] | None = None) -> DataFrame:
    """RUL-12: findings of all four checks. docs(doc_id[, text]); a text is needed for documents without sections.

    One pass over the sections: an automaton tells which keywords and words of formats a section has and which forbidden patterns it may match; these are joined by number and evaluated, and no other.
    One aggregate by document then says what is there, and the findings are what is not, and the matches: no anti-joins, and no text is joined to all rules, so time hardly follows their number.
    The results are those of missing_chapters, missing_keywords, forbidden and missing_formats (run_apart).
    """
    spark = rules.sparkSession
    words = FORMAT_WORDS if format_words is None else format_words
    word = F.coalesce(F.create_map(*(F.lit(x) for kv in words.items() for x in kv))[F.col("target")], F.col("target")) if words else F.col("target")
    own = rules.withColumn("_section", canonical("target", synonyms)).withColumn("_at", F.coalesce(canonical("target_section", synonyms), F.lit(""))).withColumn("_word", word)
    own = own.withColumn("_rx", F.when(F.col("type") == "forbidden", F.concat(F.lit(FLAGS), F.coalesce("pattern", quoted("target")))))
    pack = own.select("rule_seq", "type", "target", "keyword", "_section", "_at", "_word", "_rx").collect()
    of = lambda kind: [r for r in pack if r.type == kind]
    keyed = [r for r in of("keyword_required") if r.keyword]
    exact = [(r.rule_seq, r.keyword, r["_at"] or None) for r in keyed] + [(r.rule_seq, r["_word"], None) for r in of("format_required") if r["_word"] is not None]
    seen = scanning(spark, exact, [(r.rule_seq, r["_rx"]) for r in of("forbidden") if r["_rx"] is not None])
    if seen is None or any("\n" in r.keyword for r in keyed if not r["_at"]):
        return run_apart(docs, sections, rules, spans, fingerprint_mode, synonyms, format_words)

    numbers = lambda rows: constant([r.rule_seq for r in rows], "array<int>")
    content, kind, free = F.col("content"), F.col("section_type"), F.lit("")
    sections = sections.select("doc_id", "section_type", "content")
    if spans is not None:
        placed = with_offsets(spans)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") != "FIXED", F.struct("span_no", "text")))), lambda x: x["text"]), "\n")
        placed = placed.groupBy("doc_id", "section_type").agg(F.array_sort(F.collect_list(F.struct("span_no", "label", "approx_start", "approx_end"))).alias("_spans"), joined.alias("_free"))
        sections = sections.join(placed, ["doc_id", "section_type"], "left")
        if fingerprint_mode:
            free = F.coalesce("_free", F.lit(""))
    by_print = fingerprint_mode and spans is not None
    blank = ~free.rlike(r"(?U)\S") if by_print else F.lit(True)

    def hit(m: Column, k: Column) -> Column:
        start, n = m["start"], F.length(m["match"])
        label = F.lit("")
        if spans is not None:
            first = F.get("_spans", F.get("_first", k))
            label = F.coalesce(F.when(start + n > first["approx_start"], first["label"]), F.lit(""))
        return F.struct(F.col("rule_seq"), kind.alias("section_type"), start.alias("start"), m["match"].alias("matched"), line_of("content", start).alias("line_no"), context_of("content", start, n).alias("text"), label.alias("label"))

    def allowed(m: Column) -> Column:
        start, n = m["start"], F.length(m["match"])
        a = F.greatest(start - 10, F.lit(0))
        near = F.substring(content, a + 1, start + n + 10 - a)
        return ~F.coalesce(F.exists("exclude_contexts", lambda e: near.contains(e)), F.lit(False))

    none = F.array().cast("array<int>")
    nothing = F.array().cast(f"array<{HIT}>")
    one = sections.withColumn("_seen", seen(content, kind))
    one = one.withColumn("_own", F.col("_seen.exact"))
    if by_print:  # keywords are looked for in what is not fixed, if there is any
        in_free = scanning(spark, [(r.rule_seq, r.keyword, r["_at"] or None) for r in keyed], [])
        one = one.withColumn("_blank", blank).withColumn("_in_free", in_free(free, kind)["exact"])
    else:
        one = one.withColumn("_blank", F.lit(True)).withColumn("_in_free", none)
    local, whole, formats = numbers([r for r in keyed if r["_at"]]), numbers([r for r in keyed if not r["_at"]]), numbers(of("format_required"))
    one = one.select(
        "*", (~F.col("_blank")).alias("free"), F.array_intersect(F.when(F.col("_blank"), F.col("_own")).otherwise(F.col("_in_free")), local).alias("local"), F.array_intersect("_own", whole).alias("whole"), F.array_intersect("_in_free", whole).alias("whole_free"),
        F.array_intersect("_own", formats).alias("formats"),
    )
    lists = ("local", "whole", "whole_free", "formats")
    if of("forbidden"):
        one = one.select("doc_id", "section_type", "content", "free", *(("_spans",) if spans is not None else ()), *lists, F.posexplode_outer("_seen.maybe").alias("_k", "rule_seq"))
        one = one.join(F.broadcast(own.where("type = 'forbidden'").select("rule_seq", "_rx", "exclude_contexts")), "rule_seq", "left")
        one = one.withColumn("_matches", F.when(F.col("_rx").isNotNull() & F.expr("content rlike _rx"), F.filter(matches("content", "_rx"), allowed)))
        if spans is not None:  # the span of each match, by its place among their ends
            one = one.withColumn("_first", _ending_after(F.transform("_spans", lambda x: x["approx_end"].cast("long")), F.transform("_matches", lambda m: m["start"])))
        found = F.transform("_matches", hit)
        first = F.coalesce(F.col("_k"), F.lit(0)) == 0  # the lists of a section once
        one = one.select("doc_id", "section_type", "free", F.coalesce(found.cast(f"array<{HIT}>"), nothing).alias("hits"), *(F.when(first, F.col(c)).alias(c) for c in lists))
    else:
        one = one.withColumn("hits", nothing)
    each = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    there = one.groupBy("doc_id").agg(F.collect_set("section_type").alias("types"), F.flatten(F.collect_list("hits")).alias("hits"), F.max("free").alias("free"), *map(each, lists))
    both = docs.select("doc_id").join(there, "doc_id", "left")
    has = lambda c: F.coalesce(c, none)
    chapters = constant([{"k": r.rule_seq, "s": r["_section"]} for r in of("chapter_required")], "array<struct<k:int,s:string>>")
    gone = F.concat(
        F.when(F.col("types").isNotNull(), F.transform(F.filter(chapters, lambda r: ~F.array_contains("types", r["s"])), lambda r: r["k"])).otherwise(none), F.array_except(local, has(F.col("local"))),
        F.array_except(whole, has(F.when(F.col("free"), F.col("whole_free")).otherwise(F.col("whole")))), F.array_except(formats, has(F.col("formats"))),
    )
    gone = F.transform(gone, lambda k: F.struct(k.alias("rule_seq"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split(":") for x in HIT[7:-1].split(",")[1:])))).cast(f"array<{HIT}>")
    found = both.select("doc_id", F.inline(F.concat(gone, F.coalesce(F.col("hits").cast(f"array<{HIT}>"), nothing))))
    if "text" in docs.columns:  # for documents without sections
        titles = docs.join(there.select("doc_id"), "doc_id", "left_anti").select("doc_id", chapter_titles("text").alias("_titles"))
        targets = constant([{"k": r.rule_seq, "t": r.target} for r in of("chapter_required")], "array<struct<k:int,t:string>>")
        missing = F.filter(targets, lambda r: ~F.exists("_titles", lambda x: x.contains(r["t"]) | r["t"].contains(x)))
        more = titles.select("doc_id", F.explode(F.transform(missing, lambda r: r["k"])).alias("rule_seq"))
        found = found.unionByName(more.withColumn("text", F.lit("title")), allowMissingColumns=True)
    return described(found, own, fingerprint_mode)


def described(found: DataFrame, rules: DataFrame, fingerprint_mode: bool) -> DataFrame:
    """Findings in full: found(doc_id, and HIT: section_type is null for what is missing; text is "title" for a chapter that no title names) with their rules."""
    own = found.withColumnsRenamed({"text": "_text", "section_type": "_kind", "label": "_label"}).join(F.broadcast(rules), "rule_seq")
    kind, target, at, matched = F.col("type"), F.col("target"), F.col("_at"), F.col("matched")
    by = lambda **of: F.coalesce(*(F.when(kind == k, v) for k, v in of.items()))
    quote = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    by_title = F.coalesce(F.col("_text") == "title", F.lit(False)) & (kind == "chapter_required")
    label = F.coalesce("_label", F.lit(""))
    if fingerprint_mode:
        own = own.where((kind != "forbidden") | (label != "FIXED"))
    said = by(chapter_required=F.when(by_title, quote("缺少《", target, "》相关内容")).otherwise(quote("缺少《", target, "》章节")), keyword_required=quote("缺少关键字「", F.col("keyword"), "」"), forbidden=F.concat(F.lit("发现禁用词: "), matched), format_required=F.concat(F.lit("缺少格式规范："), target))
    advice = by(chapter_required=quote("请补充《", target, "》章节"), keyword_required=quote("请补充「", F.col("keyword"), "」相关表述"), forbidden=quote("请修改「", matched, "」相关表述"), format_required=quote("请补充关于", target, "的格式要求"))
    return _finding(
        own, location=by(keyword_required=F.when(at != "", quote("应在《", at, "》中")).otherwise("全文"), forbidden=F.concat("_kind", F.lit(" ~第"), F.col("line_no").cast("string"), F.lit("行"))), text=F.when(kind == "forbidden", F.col("_text")), start=F.col("start"), matched=matched, line_no=F.col("line_no"),
        risk_level=by(chapter_required=F.lit("high"), keyword_required=F.when(F.col("weight") >= 15, "high").otherwise("medium"), forbidden=F.col("severity"), format_required=F.lit("low")), description=F.coalesce(F.nullif("description", F.lit("")), said), suggestion=F.coalesce(F.nullif("suggestion", F.lit("")), advice),
        span_label=F.when(kind == "forbidden", label).otherwise(""), template_confidence=F.when((kind == "forbidden") & (label == "UNCERTAIN"), 0.4).when((kind == "forbidden") & (label == "FIXED"), 0.3).otherwise(0.0),
    )


def run_apart(docs: DataFrame, sections: DataFrame, rules: DataFrame, spans: DataFrame | None = None, fingerprint_mode: bool = False, synonyms: dict[str, list[str]] | None = None, format_words: dict[str, str] | None = None) -> DataFrame:
    """run() as a union of its four checks: also for keywords with line feeds, which may stand across two sections."""
    free = spans if fingerprint_mode else None
    parts = [missing_chapters(docs, sections, rules, synonyms), missing_keywords(docs, sections, rules, free, synonyms), forbidden(sections, rules, spans, fingerprint_mode), missing_formats(docs, sections, rules, format_words)]
    if "text" in docs.columns:
        parts.insert(1, missing_chapters_by_title(docs.join(sections.select("doc_id"), "doc_id", "left_anti"), rules))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
