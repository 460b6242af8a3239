"""Complaint cases: extraction from pages, mining of rules (SRC-18/19, FN-13..16, MIN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import TAGS, col, decision_type, labelled_field, last_date, strip, tags
from auditlake.operators.scan import scanning

# fixed values: words of known patterns and their rules; candidates for new rules (name, rule, pattern, risk)
KNOWN = [("参数", "R007"), ("品牌", "R107"), ("指向", "R107"), ("排他", "R107"), ("授权", "R101"), ("检测报告", "R109"), ("厂家授权", "R101"), ("指定品牌", "R107"), ("歧视", "R101"), ("业绩", "R104"), ("认证", "R104-2"), ("进口", "R201"), ("中小企业", "AI-SME"), ("评分", "AI-SCORE-VAGUE"), ("评审", "AI-SCORE-VAGUE"), ("虚假", "R303"), ("串通", "R306"), ("资质", "R001"), ("混包", "F003"), ("低价", "F002"), ("标准", "E006"), ("★", "AI-COMBINE"), ("★参数", "AI-STAR-EXCESS"), ("辐射安全许可证", "E007")]
CANDIDATES = [
    ("检测报告_注册证造假", "AI-REG-VERIFY", "检测报告|注册证|认证证书.*造假|虚假.*检测", "critical"), ("串通投标_MAC一致", "AI-BID-RIGGING", "MAC地址|IP地址.*相同|CPU代码|硬件特征码", "critical"), ("评审未按标准扣分", "AI-EVAL-ERROR", "评审.*未.*扣分|未按.*标准.*评审|评审.*违规", "high"),
    ("代理超标准收费", "AI-FEE-EXCESS", "代理.*费.*超标|多收.*服务费|超标准.*收费", "medium"), ("符合性审查程序错误", "AI-EVAL-ERROR", "符合性审查.*错误|非实质性.*条款.*无效", "high"), ("指定检测机构", "FORB-L04", "指定.*检测.*机构|特定.*检测.*报告|仅限.*检测", "medium"),
]
# rule ids there are
EXISTING = [
    "R001", "R002", "R003", "R004", "R005", "R006", "R007", "R008", "R101", "R102", "R103", "R104", "R104-2", "R105", "R106", "R107", "R108", "R109", "R110", "R111",
    "R201", "R202", "R203", "R204", "R205", "R206", "R207", "R301", "R302", "R303", "R304", "R305", "R306", "R307", "R308", "R401", "R402", "R403", "R404", "R405", "R406", "R407", "R408",
    "R501", "R502", "R503", "R504", "R505", "R601", "R602", "R603", "R604", "R605", "R606", "R607", "R701", "R702", "R703", "R704", "R705", "E001", "E002", "E003", "E004", "E005", "E006", "E007", "F001", "F002", "F003",
]
DECIDED = ["upheld", "partial"]
# end of the fixed values


def anchors(pages: DataFrame, prefix: str = "", word: str = "", base: str = "") -> DataFrame:
    """SRC-18: pages(page_id, html) -> (page_id, pos, href, title), links whose address begins with a prefix and whose text has a word; each address once, the first."""
    rx = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(rx), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(rx), F.lit(2)).alias("inner"))
    each = pages.select("page_id", F.posexplode(pairs).alias("pos", "a")).select("page_id", "pos", F.col("a.href").alias("href"), strip(F.regexp_replace("a.inner", "(?s)<[^>]*>", "")).alias("title"))
    some = each.where(F.col("href").startswith(prefix) & F.col("title").contains(word))
    some = some.withColumn("href", F.concat(F.lit(base), "href")) if base else some
    return some.groupBy("href").agg(F.min(F.struct("page_id", "pos", "title")).alias("f")).select("f.page_id", "f.pos", "href", "f.title")


def page_text(html: Column | str) -> Column:
    """Text of a page: without scripts, styles and tags; a tag ends a line; entities of signs decoded."""
    c = F.regexp_replace(col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), "\n")


def cases(pages: DataFrame) -> DataFrame:
    """SRC-19: pages(url, html) -> structured cases."""
    raw = page_text("html")
    own = pages.select(F.col("url").alias("source_url"), raw.alias("raw"), strip(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("_title"))
    lines = F.filter(F.split("raw", "\n"), lambda x: x.contains("政府采购投诉") | x.contains("投诉处理结果公告"))
    title = F.when(F.col("_title").isin("投诉处理", "") | F.col("_title").contains("当前位置"), F.coalesce(F.get(lines, F.lit(0)), F.col("_title"))).otherwise(F.col("_title"))
    result = F.left(strip(F.regexp_extract("raw", r"(?s)(?:五、处理依据及结果|五、处理依据|处理依据及结果|处理决定)(.*?)(?:六、|七、|\z)", 1)), F.lit(800))
    own = own.withColumn("_result", result)
    kw = tags("raw", TAGS)
    return own.select(
        F.lit("全国").alias("province"), "source_url", F.left(title, F.lit(200)).alias("title"), F.left(labelled_field("raw", "项目名称"), F.lit(200)).alias("project_name"), F.left(labelled_field("raw", "项目编号"), F.lit(128)).alias("project_number"),
        labelled_field("raw", "投诉人", 300).alias("complainant"), last_date("raw").alias("decision_date"), decision_type(F.when(F.col("_result") != "", F.col("_result")).otherwise(F.col("raw"))).alias("decision_type"), kw.alias("complaint_types"), F.left("_result", F.lit(500)).alias("summary"), F.left("raw", F.lit(5000)).alias("raw_content"), F.lit(0).alias("is_analyzed"),
    )


def _decided(cases_: DataFrame, decided: list[str] | None) -> DataFrame:
    text = F.concat(F.coalesce("raw_content", F.lit("")), F.coalesce("summary", F.lit("")))
    return cases_.where(F.col("decision_type").isin(decided or DECIDED)).select("case_id", text.alias("_t"))


def known_patterns(cases_: DataFrame, known: list[tuple[str, str]] | None = None, decided: list[str] | None = None) -> DataFrame:
    """MIN-1: (case_id, keyword, rule_id) for cases that were upheld, wholly or in part."""
    words = known or KNOWN
    seen = scanning(cases_.sparkSession, [(k, w, None) for k, (w, _) in enumerate(words)], [])
    rows = F.broadcast(cases_.sparkSession.createDataFrame([(k, *w) for k, w in enumerate(words)], "_k int, keyword string, rule_id string"))
    own = _decided(cases_, decided)
    found = own.join(rows, F.col("_t").contains(F.col("keyword"))) if seen is None else own.select("case_id", F.explode(seen(F.col("_t"))["exact"]).alias("_k")).join(rows, "_k")
    return found.select("case_id", "keyword", "rule_id")


def new_patterns(cases_: DataFrame, candidates: list[tuple[str, str, str, str]] | None = None, existing: list[str] | None = None, decided: list[str] | None = None) -> DataFrame:
    """MIN-1: (case_id, name, rule_id, risk, is_new)"""
    known = [(k, name, rule, "(?d)" + rx, risk) for k, (name, rule, rx, risk) in enumerate(candidates or CANDIDATES)]
    seen = scanning(cases_.sparkSession, [], [(k, rx) for k, _, _, rx, _ in known])
    rows = F.broadcast(cases_.sparkSession.createDataFrame(known, "_k int, name string, rule_id string, rx string, risk string"))
    own = _decided(cases_, decided)
    found = own.join(rows, F.expr("_t rlike rx")) if seen is None else own.withColumn("_k", F.explode(seen(F.col("_t"))["maybe"])).join(rows, "_k").where(F.expr("_t rlike rx"))
    return found.select("case_id", "name", "rule_id", "risk", (~F.col("rule_id").isin(EXISTING if existing is None else existing)).alias("is_new"))


def mined(cases_: DataFrame, known: list[tuple[str, str]] | None = None, candidates: list[tuple[str, str, str, str]] | None = None, existing: list[str] | None = None, decided: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """MIN-2 over the cases not analysed yet: (hits by rule id, hits by new pattern), most first. MIN-2's mark "analysed" is the caller's: an append of ids, or a checkpoint."""
    todo = cases_.where("is_analyzed = 0")
    hits = known_patterns(todo, known, decided).groupBy("rule_id").agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "rule_id")
    new = new_patterns(todo, candidates, existing, decided).groupBy("name", "rule_id", "risk", "is_new").agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "name")
    return hits, new


def top_patterns(new: DataFrame, n: int = 5) -> DataFrame:
    """SRT-5: the patterns of mined() that no rule covers yet, with most hits; names break ties."""
    return new.where("is_new").orderBy(F.col("hits").desc(), "name").limit(n)


def absent(new: DataFrame, there: DataFrame, key: str = "source_url") -> DataFrame:
    """SNK-5: rows whose key is not there yet, each key once (the first by title)."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), "title").alias("r")).select("r.*")
    return first.join(there.select(key), key, "left_anti").select(new.columns)


def case_counts(cases_: DataFrame) -> DataFrame:
    """AGG-7: dismissed is what is left."""
    n = lambda t: F.count_if(F.col("decision_type") == t)
    own = cases_.agg(F.count("*").alias("total"), n("upheld").alias("upheld"), n("rejected").alias("rejected"), n("partial").alias("partial"), F.count_if(F.expr("is_analyzed = 1")).alias("analyzed"))
    return own.withColumn("dismissed", F.col("total") - F.col("upheld") - F.col("rejected") - F.col("partial"))


def listed(cases_: DataFrame, province: str | None = None, decision: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """SRT-2: newest first; ids break ties."""
    own = cases_ if province is None else cases_.where(F.col("province") == province)
    own = own if decision is None else own.where(F.col("decision_type") == decision)
    return own.orderBy(F.col("decision_date").desc(), F.col("case_id").desc()).offset(offset).limit(limit)
