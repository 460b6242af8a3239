"""Lines -> headings -> sections (SEG-*). lines(doc_id, line_no, page, text) and, with fonts, max_font_size, is_bold, heading_score.

Text mode is window functions; the font-aware mode, whose headings depend on the running level, is an aggregate() over the sorted lines of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import CJK, col, grams, let, overlap, strip

# fixed values: names of the sections of a tender document
SECTION_PATTERNS = {
    "招标公告": ["招标公告", "投标邀请", "投标邀请书", "竞争性谈判公告", "采购公告", "招标公告"],
    "招标范围": ["项目概况与招标范围", "项目概述与招标范围", "招标范围", "采购范围", "建设规模", "工程概况"],
    "资格要求": ["投标人资格要求", "申请人资格要求", "资格要求", "投标人资格", "供应商资格", "合格投标人", "投标人资质", "资质要求"],
    "评审办法": ["评审办法", "评标办法", "综合评分法", "评分标准", "评分细则", "评审标准", "评标标准", "评审方法", "评标方法"],
    "投标须知": ["投标人须知前附表", "投标人须知及前附表", "投标须知", "投标人须知", "投标说明", "投标人须知与合同", "投标人须知"],
    "合同条款": ["合同条款", "合同主要条款", "合同文本", "合同草案", "采购合同", "合同条款及格式", "合同格式"],
    "投标文件格式": ["投标文件格式", "投标文件组成", "投标文件编制", "投标文件的编制", "电子投标文件的格式", "电子投标文件格式"],
    "投标保证金": ["投标保证金"],
    "技术要求": ["技术参数", "技术要求", "技术规格", "技术标准", "技术需求", "采购需求", "货物需求一览表", "技术标准和要求", "工程量清单", "采购项目需求", "项目需求"],
    "报价要求": ["报价要求", "报价说明", "报价方式", "报价一览表", "投标报价"],
    "履约要求": ["履约要求", "项目实施方案", "实施计划", "履约能力", "项目组织"],
    "保密条款": ["保密条款", "保密要求", "保密承诺", "信息安全", "商业秘密"],
    "知识产权": ["知识产权", "知识产权归属", "专利归属", "技术成果归属", "知识产权条款"],
}
REQUIRED = ["招标公告", "招标范围", "资格要求", "评审办法", "投标须知"]
MIN_CHARS, MIN_RATIO = 4, 0.45
NUMBER = "[一二三四五六七八九十0-9]+"
CHAPTER = [rf"(?U)^第{NUMBER}[章节节部分]\s*\S", rf"(?U)^第{NUMBER}条\s*\S"]
LIST = [r"(?U)^[0-9]+[、.\s]\s*\S", r"(?U)^[A-Z]+[.\s]\s*\S", r"(?U)^[一二三四五六七八九十]+[、.\s]\s*\S", r"(?U)^[（(][一二三四五六七八九十0-9]+[)）]\s*\S"]
# end of the fixed values

_LONG = sorted({p for ps in SECTION_PATTERNS.values() for p in ps if len(p) >= MIN_CHARS})


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text has one of the words (none of which has a sign with a meaning in patterns)."""
    return c.rlike("|".join(words))


def is_toc_page(text: Column | str) -> Column:
    """SEG-1"""
    c = col(text)
    return c.contains("目录") & (F.regexp_count(c, F.lit(f"第{NUMBER}章")) >= 3)


def _nearest(clean: Column) -> Column:
    """Type of the best bigram overlap, MIN_RATIO at least; the first type on ties."""
    sets = []
    for kind, ps in SECTION_PATTERNS.items():
        for p in dict.fromkeys([kind, *(p for p in ps if len(p) >= MIN_CHARS)]):
            sets.append(F.struct(F.lit(kind).alias("kind"), F.array(*(F.lit(g) for g in sorted({p[i : i + 2] for i in range(len(p) - 1)}))).alias("g")))

    def scored(own: Column) -> Column:
        each = F.transform(F.array(*sets), lambda x: F.struct(overlap(own, x["g"], "max").alias("score"), x["kind"].alias("kind")))
        none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("kind"))
        return F.aggregate(each, none, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a), lambda a: F.when(a["score"] >= MIN_RATIO, a["kind"]))

    return F.when(F.length(clean) >= MIN_CHARS, let(grams(clean, 2), scored))


def section_type(title: Column | str) -> Column:
    """SEG-3: canonical type of a title; null if none is near enough. Patterns are tried in order; on equal overlap the first type wins."""

    def of(t: Column) -> Column:
        exact = F.coalesce(*(F.when(t.contains(p) | (F.lit(p).contains(t) & (F.length(t) >= 0.6 * len(p))), F.lit(kind)) for kind, ps in SECTION_PATTERNS.items() for p in ps))
        clean = strip(F.regexp_replace(t, rf"(?U)^第{NUMBER}[章节节部分]|^[一二三四五六七八九十]+[、.\s]|^[0-9]+[、.\s]|^[A-Z]+[.\s]|^[（(][^)）]+[)）]", ""))
        clean = strip(F.regexp_replace(clean, "[（(].*[)）]|[:：].*$", ""))
        return F.when(F.length(t) > 0, F.coalesce(exact, let(clean, _nearest)))

    return let(col(title), of)


def heading_of(line: Column | str) -> Column:
    """SEG-2: the trimmed line if it is a heading, else null."""

    def of(s: Column) -> Column:
        known = any_of(s, _LONG)

        def titled(caption: Column) -> Column:
            return (caption != "") & (F.length(caption) <= 30) & (caption.rlike("^(?:" + "|".join(_LONG) + ")") | (F.length(caption) <= 8))

        chapter = s.rlike("|".join(CHAPTER)) & known & let(F.regexp_replace(s, rf"(?U)^(第[^章节部分]+[章节节部分]|[一二三四五六七八九十0-9]+[、.\s]|第{NUMBER}条)\s*", ""), titled)
        item = F.regexp_replace(s, r"(?U)^([0-9]+[、.\s]|[A-Z]+[.\s]|[（(][^)）]+[)）])\s*", "")
        short = known & (F.length(s) <= 20) & F.regexp_replace(s, "[。！？；：,.!]+$", "").rlike(CJK)
        fuzzy = (F.length(s) <= 40) & ~known & section_type(s).isNotNull()
        return F.when((s != "") & (F.length(s) <= 70), F.when(chapter, s).when(s.rlike("|".join(LIST)), F.when(known & any_of(item, _LONG), s)).when(short | fuzzy, s))

    return let(strip(line), of)


def with_headings(lines: DataFrame) -> DataFrame:
    """Adds heading and section_type; lines of contents pages have none."""
    pages = Window.partitionBy("doc_id", "page")
    toc = is_toc_page(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text")).over(pages)), lambda x: x["text"]), "\n"))
    out = lines.withColumn("_toc", toc).withColumn("heading", F.when(~F.col("_toc"), heading_of("text"))).drop("_toc")
    return out.withColumn("section_type", F.when(F.col("heading").isNotNull(), F.coalesce(section_type("heading"), F.col("heading"))))


_PART = "struct<title:string,section_type:string,content:string,level:int,page_start:int,page_end:int>"


def sections_of_lines(lines: DataFrame) -> DataFrame:
    """SEG-5, text mode: (doc_id, sec_no, title, section_type, content, level, page_start, page_end), the raw sections in order.

    A heading of the type of the open section is inlined as 【heading】; lines before the first heading are dropped; a blank line is a line feed; a heading
    without a body stays if another one follows, and is dropped at the end.

    The open section always has the type of the heading before, as an inlined heading has that type, too: so a heading opens a section if its type is another than that of
    the heading before it, and sections are runs of a running count.
    """
    text = F.coalesce(strip("text"), F.lit(""))
    marked = with_headings(lines).withColumn("_s", text).withColumn("_kind", F.when(text != "", F.col("section_type")))
    ordered = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.last("_kind", True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("_kind").isNotNull() & ~F.col("_kind").eqNullSafe(before)
    runs = marked.withColumn("_opens", opens).withColumn("_sec", F.sum(F.col("_opens").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("_sec > 0")
    piece = F.when(F.col("_opens"), "").when(F.col("_s") == "", "\n").when(F.col("_kind").isNotNull(), F.concat(F.lit("\n【"), "heading", F.lit("】\n"))).otherwise(F.concat("_s", F.lit("\n")))
    body = F.when((F.col("_s") != "") & F.col("_kind").isNull(), F.struct("line_no", "page"))
    own = runs.groupBy("doc_id", "_sec").agg(
        F.max(F.when(F.col("_opens"), F.col("heading"))).alias("title"), F.max(F.when(F.col("_opens"), F.col("_kind"))).alias("section_type"), F.array_sort(F.collect_list(F.struct("line_no", piece.alias("p")))).alias("_p"),
        F.max(F.when(F.col("_opens"), F.col("page"))).cast("int").alias("page_start"), F.max(body).alias("_b"),
    )
    own = own.withColumn("content", F.array_join(F.transform("_p", lambda x: x["p"]), "")).withColumn("_last", F.max("_sec").over(Window.partitionBy("doc_id")))
    own = own.where((F.col("_sec") < F.col("_last")) | (strip("content") != ""))
    return own.select("doc_id", (F.col("_sec") - 1).cast("int").alias("sec_no"), "title", "section_type", "content", F.lit(1).alias("level"), "page_start", F.coalesce(F.col("_b.page").cast("int"), "page_start").alias("page_end"))


def section_map(raw: DataFrame) -> DataFrame:
    """(doc_id, section_type, content, ord): repeated types are joined by a line feed in order, but the last raw section of a document replaces earlier ones of its
    type. ord: where the type stood first."""
    last = F.max("sec_no").over(Window.partitionBy("doc_id"))
    closing = F.max(F.when(F.col("sec_no") == F.col("_last"), F.col("section_type"))).over(Window.partitionBy("doc_id"))
    own = raw.withColumn("_last", last).withColumn("_closing", closing)
    first = F.min("sec_no").over(Window.partitionBy("doc_id", "section_type"))
    own = own.withColumn("ord", first).where((F.col("section_type") != F.col("_closing")) | (F.col("sec_no") == F.col("_last")))
    return own.groupBy("doc_id", "section_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_no", "content"))), lambda x: x["content"]), "\n").alias("content"), F.min("ord").alias("ord"))


def font_stats(spans: DataFrame, least: float = 11.0) -> DataFrame:
    """SEG-7: (doc_id, page, body_size): the commonest size of a page (to half a point), else of the document without its cover (page 0), else 12."""
    sizes = spans.where(F.col("font_size") >= least).withColumn("size", F.round(F.col("font_size") * 2) / 2)
    page = sizes.groupBy("doc_id", "page").agg(F.mode("size", True).alias("_page"))
    whole = sizes.where("page > 0").groupBy("doc_id").agg(F.mode("size", True).alias("_all"))
    return spans.select("doc_id", "page").distinct().join(page, ["doc_id", "page"], "left").join(whole, "doc_id", "left").select("doc_id", "page", F.coalesce("_page", "_all", F.lit(12.0)).alias("body_size"))


def heading_score(size: Column | str, body: Column | str, bold: Column | str, text: Column | str) -> Column:
    """SEG-8"""
    ratio, n = col(size) / col(body), F.length(strip(text))
    by_size = F.when((col(size) > 0) & (col(body) > 0) & (ratio > 1.1), F.least((ratio - 1) * 3, F.lit(0.8))).otherwise(0.0)
    return by_size + F.when(col(bold), 0.15).otherwise(0.0) + F.when(n <= 5, 0.15).when(n >= 60, -0.2).otherwise(0.0)


def is_watermark(span: Column | str) -> Column:
    """Spans of more than ten digits are left out of a line."""
    return strip(span).rlike(r"^[0-9]{11,}\z")


def is_probable_heading(text: Column | str, score: Column | str, bold: Column | str, least: float = 0.5) -> Column:
    """SEG-9"""
    s, known = strip(text), any_of(strip(text), _LONG)
    cjk = s.rlike(CJK)
    weak = s.rlike("|".join(CHAPTER)) | (known & s.rlike("|".join(LIST))) | (known & (F.length(s) <= 20) & cjk) | (col(bold) & (F.length(s) <= 30) & (col(score) >= 0.15) & cjk)
    return (col(score) >= least) | ((s != "") & (F.length(s) <= 60) & (weak | (known & ~F.regexp_replace(s, "[。！？；：,.!]+$", "").rlike(r"^[0-9]+\z"))))


def heading_level(size: Column | str, body: Column | str) -> Column:
    """SEG-10, by font size."""
    ratio = col(size) / col(body)
    return F.when((col(body) <= 0) | (col(size) <= 0), 1).when(ratio >= 1.5, 1).when(ratio >= 1.25, 2).otherwise(3)


def style_level(style: Column | str) -> Column:
    """SEG-10, by the name of a paragraph style."""
    return F.coalesce(F.regexp_extract(col(style), r"(?i)heading\s*([0-9]+)", 1).try_cast("int"), F.lit(1))


def sections_of_styled_lines(lines: DataFrame) -> DataFrame:
    """SEG-6: lines(doc_id, line_no, page, text, heading boolean, level) -> raw sections. A heading of the open type and no higher level is inlined and counted as a subheading;
    sections without a body are dropped everywhere."""
    own = lines.withColumn("text", strip("text")).where("text <> ''").withColumn("section_type", F.when(F.col("heading"), F.coalesce(section_type("text"), F.col("text"))))
    rows = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("page").cast("int").alias("page"), "text", "heading", F.col("level").cast("int").alias("level"), "section_type"))).alias("rows"))
    part = _PART[:-1] + ",headings:array<string>>"
    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.lit(None).cast(part).alias("open"))
    closed = lambda acc: F.when(acc["open"].isNotNull() & (strip(acc["open"]["content"]) != ""), F.array_append(acc["done"], F.struct(*[(F.regexp_replace(acc["open"][c], r"(?U)\s+\z", "") if c == "content" else acc["open"][c]).alias(c) for c in ("title", "section_type", "content", "level", "page_start", "page_end", "headings")]))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        now = acc["open"]

        def put(more: Column, page: Column, headings: Column) -> Column:
            return F.struct(now["title"].alias("title"), now["section_type"].alias("section_type"), F.concat(now["content"], more).alias("content"), now["level"].alias("level"), now["page_start"].alias("page_start"), page.alias("page_end"), headings.alias("headings"))

        fresh = F.struct(x["text"].alias("title"), x["section_type"].alias("section_type"), F.lit("").alias("content"), x["level"].alias("level"), x["page"].alias("page_start"), x["page"].alias("page_end"), F.array().cast("array<string>").alias("headings"))
        same = F.struct(acc["done"].alias("done"), put(F.concat(F.lit("\n【"), x["text"], F.lit("】\n")), now["page_end"], F.array_append(now["headings"], x["text"])).alias("open"))
        body = F.struct(acc["done"].alias("done"), F.when(now.isNotNull(), put(F.concat(x["text"], F.lit("\n")), x["page"], now["headings"])).alias("open"))
        inline = (now["section_type"] == x["section_type"]) & (x["level"] >= now["level"])
        return F.when(x["heading"], F.when(inline, same).otherwise(F.struct(closed(acc).alias("done"), fresh.alias("open")))).otherwise(body)

    return rows.select("doc_id", F.posexplode(F.aggregate("rows", start, step, closed)).alias("sec_no", "s")).select("doc_id", "sec_no", "s.*")


def styled_section_map(raw: DataFrame, sep: str = "\n\n") -> DataFrame:
    return raw.groupBy("doc_id", "section_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_no", "content"))), lambda x: x["content"]), sep).alias("content"), F.min("sec_no").alias("ord"))


def missing_required(sections: DataFrame, docs: DataFrame, required: list[str] | None = None) -> DataFrame:
    """SEG-11 / SET-4: (doc_id, section_type) of the required types that a document lacks."""
    need = docs.select("doc_id").distinct().withColumn("section_type", F.explode(F.array(*map(F.lit, required or REQUIRED))))
    return need.join(sections, ["doc_id", "section_type"], "left_anti")


def previews(sections: DataFrame, chars: int = 200, headings: int = 20) -> DataFrame:
    """SEG-12: per document the number of sections, previews and the first headings."""
    own = F.array_sort(F.collect_list(F.struct("sec_no", "title", F.left("content", F.lit(chars)).alias("preview"))))
    return sections.groupBy("doc_id").agg(F.count("*").alias("section_count"), own.alias("_all")).select("doc_id", "section_count", F.transform("_all", lambda x: x["preview"]).alias("previews"), F.slice(F.transform("_all", lambda x: x["title"]), 1, headings).alias("headings"))


def chapter_titles(text: Column | str) -> Column:
    """SEG-13: titles of headings in a plain text, each once."""
    forms = [rf"(?m)^第{NUMBER}[章节节部分]\s*(.+?)$", r"(?m)^[一二三四五六七八九十]+[、.\s]\s*(.+)$", r"(?m)^[0-9]+[、.\s]\s*(.+)$"]
    found = F.concat(*(F.regexp_extract_all(col(text), F.lit("(?dU)" + p), F.lit(1)) for p in forms))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def better_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """SRC-3: of two section maps of the same documents, that with more types (a on equality), filled with the types only the other has."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    wins = n(a, "x").join(n(b, "y"), "doc_id", "full_outer").select("doc_id", (F.coalesce("x", F.lit(0)) >= F.coalesce("y", F.lit(0))).alias("first"))
    cols = ["doc_id", "section_type", "content"]
    first = a.select(*cols).join(wins, "doc_id").withColumn("rank", F.when(F.col("first"), 0).otherwise(1))
    second = b.select(*cols).join(wins, "doc_id").withColumn("rank", F.when(F.col("first"), 1).otherwise(0))
    return first.unionByName(second).groupBy("doc_id", "section_type").agg(F.min_by("content", "rank").alias("content"))
