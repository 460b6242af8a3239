"""Template separation (LAB-*): fingerprints of template sentences, and labels FIXED / VARIABLE / UNCERTAIN of spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import CASED, SIGNED, col, gram_codes, is_placeholder, let, normalized, overlap, sentences, template_sentences, text_hash
from auditlake.operators.near import nearest
from auditlake.session import written

# fixed values: signs of template text and of authored text, with weights; words of template text
FIXED_SIGNS = [("(?:招标投标法|政府采购法|实施条例|财政部令|号令|号文)", 3), (r"(?:第[一二三四五六七八九十\d]+[章节条]|^[一二三四五六七八九十]+[、\.])", 2), ("(?:注[：:]|说明[：:]|注意[：:]|提示[：:]|附[：:])", 1), ("(?:不得|必须|应当|严禁|禁止|须按|须在|应在)", 1), ("(?:投标人须知|前附表|招标公告|资格要求|评审办法|投标须知)", 2), ("(?:投诉|质疑|答复|行政复议|起[诉])", 1)]
VARIABLE_SIGNS = [
    ("[（(][^）)]*(?:项目名称|采购人|招标人|投标人|金额|日期|编号|数量|填写)[^）)]*[）)]", 4), ("(?:本项目|该工程|本工程|本次招标|本次采购).{0,15}(?:位于|地点|规模|内容|预算|投资)", 3), ("(?:投标人|供应商).{0,5}(?:资格|资质|要求|条件|须|需|应)", 2), ("(?:技术参数|技术要求|技术规格|性能指标|配置要求)", 3), ("[（(][^）)]{0,30}[）)]", 2),
    ("(?:业绩|案例|经验).{0,10}(?:要求|条件|需要|提供)", 2), ("(?:评分|分值|权重|得分|满分|扣分)", 2), ("(?:预算|最高限价|控制价|投标报价|价格)", 2), ("(?:工期|交货期|服务期|工期要求|完成时间)", 2), ("[Xx_＿]{2,}", 3), ("□", 2),
]
TEMPLATE_WORDS = ["招标投标法", "政府采购法", "实施条例", "财政部", "公共资源交易", "电子招标投标", "招标文件", "投标人须知", "投标须知", "前附表", "投标文件", "投标保证金", "履约保证金", "招标公告", "资格要求", "评审办法", "评标办法", "开标", "评标", "定标", "中标", "质疑", "投诉", "答复", "签字", "盖章", "密封", "装订", "格式", "要求", "说明", "注：", "注:", "不得", "必须", "应当", "严禁", "第一条", "第二条", "第三条", "第四条", "第五条"]
FUZZY = 0.85
# end of the fixed values
FEW, HITS = 100_000, 8


def _sum(x: Column, signs: list[tuple[str, int]]) -> Column:
    out = F.lit(0)
    for p, w in signs:
        out = out + F.when(x.rlike(CASED + p), w).otherwise(0)
    return out


def classified(x: Column | str) -> Column:
    """LAB-8: struct<label, confidence> of a sentence."""
    c = col(x)
    pair = lambda label, conf: F.struct(F.lit(label).alias("label"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence"))

    def decide(n: Column) -> Column:
        fixed, variable = n["fixed"], n["variable"]
        return (
            F.when(variable >= 4, pair("VARIABLE", F.least(F.lit(0.9), 0.6 + variable * 0.08))).when((fixed >= 5) & (variable <= 1), pair("FIXED", F.least(F.lit(0.9), 0.6 + fixed * 0.06)))
            .when((fixed >= 3) & (variable == 0), pair("FIXED", 0.65)).when((variable >= 2) & (fixed <= 2), pair("VARIABLE", 0.65)).otherwise(pair("UNCERTAIN", 0.5))
        )

    def by_length(n: Column) -> Column:
        longer = F.when((F.length(c) > 80) & (n["fixed"] >= 3), 2).otherwise(0)
        shorter = F.when((F.length(c) < 10) & (n["variable"] == 0), 1).otherwise(0)
        return F.struct((n["fixed"] + longer + shorter).alias("fixed"), n["variable"].alias("variable"))

    signs = F.when(c.rlike(SIGNED), F.struct(_sum(c, FIXED_SIGNS).alias("fixed"), _sum(c, VARIABLE_SIGNS).alias("variable"))).otherwise(F.struct(F.lit(0).alias("fixed"), F.lit(0).alias("variable")))
    return let(let(signs, by_length), decide)


def template_score(x: Column | str) -> Column:
    """LAB-2: at least 5 makes a sentence of a single template fixed."""
    c = col(x)
    words = F.size(F.filter(F.array(*map(F.lit, TEMPLATE_WORDS)), lambda w: c.contains(w)))
    law, number, note = "招标投标法|政府采购法|实施条例|财政部|87号令|94号令|38号文", r"(?:第[一二三四五六七八九十\d]+[章节条]|^\d+[.、])", "(?:注[：:]|说明[：:]|注意[：:]|提示[：:])"
    return F.when(c.rlike(law), 3).otherwise(0) + F.least(words, F.lit(5)) * 2 + F.when(F.length(c) >= 40, 2).otherwise(0) + F.when(c.rlike("(?U)" + number), 2).otherwise(0) + F.when(c.rlike(note), 1).otherwise(0)


def smoothed(spans: DataFrame) -> DataFrame:
    """LAB-9: a short UNCERTAIN span between two FIXED ones is FIXED, 0.55."""
    w = Window.partitionBy("doc_id", "section_type").orderBy("span_no")
    between = (F.col("label") == "UNCERTAIN") & (F.length("text") <= 15) & (F.lag("label").over(w) == "FIXED") & (F.lead("label").over(w) == "FIXED")
    between = F.coalesce(between, F.lit(False))
    return spans.withColumn("_b", between).withColumn("label", F.when(F.col("_b"), "FIXED").otherwise(F.col("label"))).withColumn("confidence", F.when(F.col("_b"), 0.55).otherwise(F.col("confidence"))).drop("_b")


def spans_of(sections: DataFrame) -> DataFrame:
    """(doc_id, section_type, ord, span_no, text): sentences of three characters at least."""
    return sections.select("doc_id", "section_type", "ord", F.posexplode(F.filter(sentences("content"), lambda s: F.length(s) >= 3)).alias("span_no", "text"))


def marked(sections: DataFrame) -> DataFrame:
    """LAB-10: heuristic labels."""
    return smoothed(spans_of(sections).withColumn("_c", classified("text")).select("*", "_c.*").drop("_c").withColumn("fingerprint_id", F.lit(None).cast("string")))


def fingerprints(templates: DataFrame, group: list[str], singles: bool = True, split=template_sentences) -> DataFrame:
    """LAB-1 / SET-1: templates(doc_id, text, *group) -> (*group, hash_id, normalized, text, frequency, length): sentences that all templates of a group have; of a
    group of one template those with template_score of 5 at least."""
    each = templates.select("doc_id", *group, F.posexplode(split("text")).alias("_at", "sentence")).withColumn("normalized", normalized("sentence"))
    docs = templates.groupBy(*group).agg(F.countDistinct("doc_id").alias("_docs"))  # grows with the groups: the planner chooses the join
    own = each.groupBy(*group, "normalized").agg(F.countDistinct("doc_id").alias("_in"), F.count("*").alias("frequency"), F.min(F.struct("doc_id", "_at", "sentence")).alias("_first"), F.max(template_score("sentence")).alias("_score"))
    kept = own.join(docs, group).where(((F.col("_docs") > 1) & (F.col("_in") == F.col("_docs"))) | ((F.col("_docs") == 1) & (F.col("_score") >= 5) & F.lit(singles)))
    return kept.select(*group, text_hash("normalized").alias("hash_id"), "normalized", F.col("_first.sentence").alias("text"), "frequency", F.length("normalized").alias("length"))


def headers(templates: DataFrame, group: list[str]) -> DataFrame:
    """LAB-7 / SET-2: templates(*group, header) -> each header of a group once."""
    return templates.select(*group, "header").distinct()


def variable_markers(templates: DataFrame, group: list[str]) -> DataFrame:
    """Sentences with a blank to fill in."""
    return templates.select(*group, F.explode(template_sentences("text")).alias("text")).where(is_placeholder("text"))


def exact(sentences_: DataFrame, prints: DataFrame, key: str = "text", few: bool = False) -> DataFrame:
    """LAB-4: adds fingerprint_id by equal hash, null if there is none. The side of fingerprints is one row per hash; few: it is broadcast."""
    own = prints.select(F.col("hash_id").alias("_h")).distinct()
    own = F.broadcast(own) if few else own
    return sentences_.withColumn("_key", text_hash(key)).join(own, F.col("_key") == F.col("_h"), "left").withColumn("fingerprint_id", F.col("_h")).drop("_key", "_h")


def _texts(prints: DataFrame) -> DataFrame:
    """Fingerprints that have grams: (hash_id, _norm)."""
    return prints.select("hash_id", normalized("text").alias("_norm")).where("length(_norm) > 2").groupBy("hash_id").agg(F.min("_norm").alias("_norm"))


def _with_near(own: DataFrame, prints: DataFrame, seen: Callable[[Column], Column] | None, asked: Column) -> DataFrame:
    """own(text, ...) with _near, the hash of the near fingerprint of rows that are asked for; seen: of nearest()."""
    if seen:
        return own.withColumn("_near", seen(F.when(asked, normalized("text")))["hash_id"])
    texts = own.where(asked).select("text").distinct().withColumn("sid", F.col("text"))
    return own.join(fuzzy(texts, prints).select(F.col("sid").alias("text"), F.col("hash_id").alias("_near")), "text", "left")


def fuzzy(sentences_: DataFrame, prints: DataFrame, least: float = FUZZY, key: str = "text") -> DataFrame:
    """LAB-5: sentences_(sid, text) -> (sid, hash_id, score): the best fingerprint by 3-gram overlap of the smaller set, `least` at least, of a length that differs by
    no more than the larger of 30 % and 10; the first in order of text on ties.

    A few fingerprints (near.MOST_CELLS) are sent to the rows; else sets are joined. Of a pair, at least c = ceil(least * size of the smaller set) grams are common, so any size - c + k grams of a fingerprint hold k of them. Fingerprints are looked up by their grams that are rarest in
    the sentences, k = HITS of them or c, where these are less: a sentence must have so many, and only such pairs are compared in full. The lookup goes by classes of length, and sentences of a length that
    no fingerprint's band has are left out first. Only a sentence that has few different grams for its length (_low) can need more than the rarer part of a fingerprint's grams. Fingerprints of FEW grams,
    which are counted first, are broadcast, so that the sentences' grams are not shuffled; more are joined by a shuffle. Ids are hashes of 64 bits there: equal ones can only add a pair to compare.
    """
    if seen := nearest(_texts(prints), least):
        found = sentences_.where("sid IS NOT NULL").select("sid", seen(normalized(key)).alias("_b")).where("_b IS NOT NULL")
        return found.groupBy("sid").agg(F.max_by("_b", "_b.score").alias("b")).select("sid", "b.*")
    b = _texts(prints).withColumn("_plen", F.length("_norm"))
    short, long, n = (x or 0 for x in b.agg(F.min("_plen"), F.max("_plen"), F.sum(F.col("_plen") - 2)).first())
    small = F.broadcast if n <= FEW else lambda df: df
    reach = lambda x: F.greatest(x * 0.3, F.lit(10.0))
    a = sentences_.where("sid IS NOT NULL").select("sid", let(normalized(key), lambda x: F.when((F.length(x) > 2) & (F.length(x) - reach(F.length(x)) <= long) & (F.length(x) + reach(F.length(x)) >= short), x)).alias("_norm"))
    a = written(a, "sentences").where("_norm IS NOT NULL").withColumn("_len", F.length("_norm"))

    # explode_outer: no set is empty, and for explode Spark would make each set once more to see that
    each = lambda df, ident, size, n: df.select(F.xxhash64(ident).alias("_id"), n, gram_codes("_norm").alias("_g")).select("_id", n, F.size("_g").alias(size), F.explode_outer("_g").alias("g"))
    step = lambda x: F.floor(F.log(x.cast("double")) * 4).cast("int")
    low = F.col("_as") < 0.5 * (F.greatest(F.col("_len") * 1.3, F.col("_len") + 10.0) - 2)
    each_a = each(a, "sid", "_as", "_len").select(F.col("_id").alias("_s"), "_len", "_as", "g", low.alias("_low"), step(F.col("_len")).alias("_step"))
    each_b = each(b, "hash_id", "_bs", "_plen").withColumnRenamed("_id", "_p")

    often = each_a.join(small(each_b.select("g").distinct()), "g", "left_semi").groupBy("g").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.coalesce("_n", F.lit(0)), "g"))
    most = lambda x: F.ceil(x * least - 1e-9)
    # the largest sentence's set that needs a gram, and the band's lengths; both may be a little too wide
    far = F.when(F.col("_k") <= F.col("_bs") - most(F.col("_bs")) + F.least(most(F.col("_bs")), F.lit(HITS)), 1 << 30).otherwise(F.floor((F.col("_bs") + HITS - F.col("_k")) / least + 1e-6)).cast("int")
    from_ = F.greatest(F.floor(F.least(F.col("_plen") / 1.3, F.col("_plen") - 10.0)) - 1, F.lit(3)).cast("int")
    to = (F.ceil(F.greatest(F.col("_plen") / 0.7, F.col("_plen") + 10.0)) + 1).cast("int")
    ranked = each_b.join(often, "g", "left").withColumn("_k", place).where("_n IS NOT NULL").select("g", "_p", "_bs", far.alias("_far"), from_.alias("_from"), to.alias("_to"))
    ranked = ranked.select("*", F.explode(F.sequence(step(F.col("_from")), step(F.col("_to")))).alias("_step"))
    places = ranked.withColumn("_low", F.explode(F.when(F.col("_far") >= 0.5 * F.col("_bs"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    hits = each_a.join(small(places), ["g", "_low", "_step"]).where("_as <= _far AND _len BETWEEN _from AND _to")
    pairs = hits.groupBy("_s", "_p").agg(F.count("*").alias("_n"), F.min(F.least("_as", "_bs")).alias("_least")).where(F.col("_n") >= F.least(most(F.col("_least")), F.lit(HITS))).select("_s", "_p")

    own = b.select(F.xxhash64("hash_id").alias("_p"), "hash_id", F.crc32("_norm").alias("_tie"), "_plen", F.col("_norm").alias("_pnorm"))
    found = a.withColumn("_s", F.xxhash64("sid")).join(pairs, "_s").join(small(own), "_p").where(F.abs(F.col("_len") - F.col("_plen")) <= reach(F.col("_len")))
    score = let(F.struct(gram_codes("_norm").alias("a"), gram_codes("_pnorm").alias("b")), lambda g: overlap(g["a"], g["b"], "min"))
    full = found.select("sid", "hash_id", "_tie", score.alias("score")).where(F.col("score") >= least)
    return full.groupBy("sid").agg(F.max_by(F.struct("hash_id", "score"), F.struct(F.col("score"), -F.col("_tie"))).alias("b")).select("sid", "b.*")


def marked_by_fingerprint(sections: DataFrame, prints: DataFrame, with_fuzzy: bool = True) -> DataFrame:
    """LAB-11: placeholder -> VARIABLE .90; equal hash -> FIXED .95; fuzzy -> FIXED .80; else LAB-8; then LAB-9."""
    return smoothed(_by_fingerprint(spans_of(sections), prints, with_fuzzy))


def _by_fingerprint(spans: DataFrame, prints: DataFrame, with_fuzzy: bool) -> DataFrame:
    seen = nearest(_texts(prints), FUZZY) if with_fuzzy else None
    own = exact(spans, prints, few=seen is not None).withColumn("_p", is_placeholder("text")).withColumn("_c", classified("text"))
    own = _with_near(own, prints, seen, F.expr("NOT _p AND fingerprint_id IS NULL")) if with_fuzzy else own.withColumn("_near", F.lit(None).cast("string"))
    label = F.when(F.col("_p"), "VARIABLE").when(F.col("fingerprint_id").isNotNull() | F.col("_near").isNotNull(), "FIXED").otherwise(F.col("_c.label"))
    conf = F.when(F.col("_p"), 0.9).when(F.col("fingerprint_id").isNotNull(), 0.95).when(F.col("_near").isNotNull(), 0.8).otherwise(F.col("_c.confidence"))
    fid = F.when(~F.col("_p"), F.coalesce("fingerprint_id", "_near"))
    out = own.withColumn("label", label).withColumn("confidence", conf).withColumn("fingerprint_id", fid)
    return out.select("doc_id", "section_type", "ord", "span_no", "text", "label", "confidence", "fingerprint_id")


def is_known_fixed(texts_: DataFrame, prints: DataFrame) -> DataFrame:
    """LAB-6: texts_(sid, text) -> (sid, is_fixed, confidence, fingerprint_id): 0.95 by an equal fingerprint, 0.80 by a near one, 0 by none."""
    seen = nearest(_texts(prints), FUZZY)
    both = _with_near(exact(texts_.select("sid", "text"), prints, few=seen is not None), prints, seen, F.col("fingerprint_id").isNull())
    return both.select("sid", F.coalesce("fingerprint_id", "_near").isNotNull().alias("is_fixed"), F.when(F.col("fingerprint_id").isNotNull(), 0.95).when(F.col("_near").isNotNull(), 0.8).otherwise(0.0).alias("confidence"), F.coalesce("fingerprint_id", "_near").alias("fingerprint_id"))


def ratios(spans: DataFrame) -> DataFrame:
    """LAB-12: shares of characters by label, 3 decimals."""
    n = lambda lab: F.sum(F.when(F.col("label") == lab, F.length("text")).otherwise(0))
    total = F.greatest(F.sum(F.length("text")), F.lit(1))
    return spans.groupBy("doc_id").agg(F.count("*").alias("total_spans"), *(F.bround(n(x) / total, 3).alias(f"{x.lower()}_ratio") for x in ("FIXED", "VARIABLE", "UNCERTAIN")))


def texts(spans: DataFrame, of: str = "variable") -> DataFrame:
    """LAB-13: (doc_id, section_type, text) of all spans ("all"), or those not FIXED ("variable"), one per line."""
    own = spans if of == "all" else spans.where("label <> 'FIXED'")
    return own.groupBy("doc_id", "section_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def spans_to_check(spans: DataFrame, uncertain: bool = True) -> DataFrame:
    return spans.where(F.col("label").isin(["VARIABLE", "UNCERTAIN"] if uncertain else ["VARIABLE"]))


def tagged_text(spans: DataFrame) -> DataFrame:
    """LAB-13: runs of equal labels inside <<TEMPLATE>> or <<REVIEW>> marks (gaps and islands)."""
    w = Window.partitionBy("doc_id", "section_type").orderBy("span_no")
    new = F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)
    runs = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), " ")
    one = runs.groupBy("doc_id", "section_type", "_run", "label").agg(joined.alias("_t"))
    tag = F.when(F.col("label") == "FIXED", "TEMPLATE").otherwise("REVIEW")
    one = one.withColumn("_t", F.concat(F.lit("<<"), tag, F.lit(">>\n"), "_t", F.lit("\n<</"), tag, F.lit(">>")))
    return one.groupBy("doc_id", "section_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_run", "_t"))), lambda x: x["_t"]), "\n").alias("text"))


def quick_checked(texts_: DataFrame, prints: DataFrame | None = None, with_fuzzy: bool = True) -> DataFrame:
    """LAB-14: texts_(sid, text) with label and confidence of each text by itself: by placeholder, equal or near fingerprint (LAB-11, without smoothing) where there are any."""
    if prints is None:
        return texts_.select("sid", "text").withColumn("_c", classified("text")).select("sid", "text", "_c.*")
    one = texts_.select(F.col("sid").alias("doc_id"), F.lit("").alias("section_type"), F.lit(0).alias("ord"), F.lit(0).alias("span_no"), "text")
    return _by_fingerprint(one, prints, with_fuzzy).select(F.col("doc_id").alias("sid"), "text", "label", "confidence")


def texts_for_review(spans: DataFrame) -> DataFrame:
    """LAB-14: per section the tagged text and the text to review."""
    return tagged_text(spans).withColumnRenamed("text", "tagged").join(texts(spans).withColumnRenamed("text", "variable"), ["doc_id", "section_type"], "left")
