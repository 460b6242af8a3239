"""Fusion of rule, bias and model findings (FUS-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import col, json_array, risk_penalty, section_name, strip

# fixed values: kinds of model findings; thresholds by pair of kinds; keywords of the deterministic reviewer
KINDS = ["exclusivity", "bias", "hidden_barrier", "ambiguity", "high_risk", "format_issue", "legal_risk", "procedural_issue"]
RISKS = ["high", "medium", "low"]
THRESHOLDS = {("forbidden", "exclusivity"): 0.25, ("forbidden", "hidden_barrier"): 0.25, ("forbidden", "bias"): 0.30, ("keyword_required", "exclusivity"): 0.40, ("keyword_required", "bias"): 0.40, ("chapter_required", "high_risk"): 0.50}
REVIEWER = [
    (["本地企业", "本地注册", "本市"], "exclusivity", "high", 20.0, 0.92), (["指定品牌", "指定型号", "唯一"], "exclusivity", "high", 20.0, 0.95), (["倾向", "明显偏高", "不合理权重", "特定"], "bias", "medium", 10.0, 0.78),
    (["注册资金", "注册资本"], "hidden_barrier", "medium", 15.0, 0.85), (["仅限", "仅有", "只能"], "exclusivity", "high", 20.0, 0.90), (["酌情", "视情况", "等"], "ambiguity", "low", 5.0, 0.72),
]
# end of the fixed values

ANSWER = "array<struct<type:string,section:string,text:string,risk_level:string,reason:string,suggestion:string,law_ref:string,basis:string,weight:double,evidence:string,evidence_text:string,consequence:string,confidence:string>>"


def deduplicated(rule_found: DataFrame, model_found: DataFrame) -> DataFrame:
    """FUS-1: model findings without those that a finding of a rule covers: same section (not empty), same risk, and a text that contains theirs. A finding of a
    rule without a text has its description."""
    r = rule_found.select("doc_id", section_name(F.coalesce(F.nullif("location", F.lit("")), "description")).alias("_sec"), F.col("risk_level").alias("_risk"), F.coalesce(F.nullif("text", F.lit("")), "description").alias("_text")).where("_sec <> ''")
    m = model_found.withColumn("_own", F.coalesce(F.nullif("section", F.lit("")), section_name("text")))
    same = (m["doc_id"] == r["doc_id"]) & (m["_own"] == r["_sec"]) & (m["risk_level"] == r["_risk"]) & (F.col("text") != "") & r["_text"].contains(m["text"])
    return m.join(r, same, "left_anti").drop("_own")


def first_of_equal(found: DataFrame) -> DataFrame:
    """FUS-2: one finding per section, text and risk: the first by seq."""
    w = Window.partitionBy("doc_id", section_name(F.coalesce(F.nullif("location", F.lit("")), "description")), F.coalesce(F.nullif("text", F.lit("")), "description"), "risk_level").orderBy("seq")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_of_similar(model_found: DataFrame) -> DataFrame:
    """FUS-3: one finding per type, section and first 40 characters: that of the highest confidence, the first on ties."""
    w = Window.partitionBy("doc_id", "type", "section", F.left("text", F.lit(40))).orderBy(F.col("confidence").desc(), "seq")
    return model_found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def threshold(rule_type: Column | str, model_type: Column | str) -> Column:
    """FUS-4"""
    out = F.lit(0.35)
    for (a, b), v in THRESHOLDS.items():
        out = F.when((col(rule_type) == a) & (col(model_type) == b), v).otherwise(out)
    return out


def parsed(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FUS-8 and FN-12: answers(doc_id, chunk_no, response) -> (findings, rejected with a reason).

    A type of the list and a text are needed; evidence_text and basis stand for evidence and law_ref where these are missing; confidence is 0.5 unless it is a number, and
    within 0..1; an unknown risk is medium.
    """
    whole = answers.withColumn("_items", json_array("response", ANSWER))
    broken = whole.where("_items IS NULL").select("doc_id", "chunk_no", F.lit("no JSON array").alias("reason"))
    each = whole.select("doc_id", "chunk_no", F.posexplode("_items").alias("seq", "i"))
    reason = F.when(F.col("i").isNull(), "no object").when(~F.coalesce(F.col("i.type").isin(KINDS), F.lit(False)), "type").when(F.coalesce("i.text", F.lit("")) == "", "text")
    each = each.withColumn("reason", reason)
    number = F.col("i.confidence").try_cast("double")  # least and greatest would pass over a null
    conf = F.when(number.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    ok = each.where("reason IS NULL").select(
        "doc_id", "chunk_no", "seq", F.lower("i.type").alias("type"), F.coalesce("i.section", F.lit("")).alias("section"), "i.text", F.when(F.col("i.risk_level").isin(RISKS), F.col("i.risk_level")).otherwise("medium").alias("risk_level"), F.coalesce("i.reason", F.lit("")).alias("reason"),
        F.coalesce("i.suggestion", F.lit("")).alias("suggestion"), F.coalesce("i.law_ref", "i.basis").alias("law_ref"), F.coalesce("i.weight", F.lit(10.0)).alias("weight"), F.coalesce("i.evidence", "i.evidence_text", F.lit("")).alias("evidence"), F.coalesce("i.consequence", F.lit("")).alias("consequence"), conf.alias("confidence"),
    )
    return ok, broken.unionByName(each.where("reason IS NOT NULL").select("doc_id", "chunk_no", "reason"))


def reviewed(sections: DataFrame, reviewer: list[tuple[list[str], str, str, float, float]] | None = None, checked: DataFrame | None = None) -> DataFrame:
    """FUS-9: the deterministic reviewer: for each section and group the first keyword found (in `checked`(doc_id, section_type, text) where given and not blank); the text is 15
    characters before and 30 from the keyword on."""
    groups = reviewer or REVIEWER
    own = sections.select("doc_id", "section_type", "content")
    if checked is not None:
        own = own.join(checked.select("doc_id", "section_type", F.col("text").alias("_c")), ["doc_id", "section_type"], "left")
        look = F.when(F.col("_c").rlike(r"(?U)\S"), F.col("_c")).otherwise(F.col("content"))
    else:
        look = F.col("content")
    own = own.withColumn("_look", look)
    items = []
    for k, (words, kind, risk, weight, conf) in enumerate(groups):
        word = F.coalesce(*(F.when(F.col("_look").contains(w), F.lit(w)) for w in words))
        items.append(F.when(word.isNotNull(), F.struct(F.lit(k).alias("seq"), word.alias("keyword"), F.lit(kind).alias("type"), F.lit(risk).alias("risk_level"), F.lit(weight).alias("weight"), F.lit(conf).alias("confidence"))))
    each = own.withColumn("f", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())))
    at = F.instr(F.col("content"), F.col("f.keyword")) - 1
    a = F.greatest(at - 15, F.lit(0))
    text = F.when(at >= 0, strip(F.substring(F.col("content"), a + 1, at + 30 - a))).otherwise("")
    return each.select("doc_id", F.col("section_type").alias("section"), "f.*", text.alias("text"))


def risk_items(rule_found: DataFrame, bias_found: DataFrame, model_found: DataFrame) -> DataFrame:
    """FUS-6: (doc_id, source, risk_level, category, title, evidence, confidence).

    A forbidden rule whose id a bias finding has, too, is confirmed. Bias findings with a rule id that a rule finding has are left out.
    """
    by_bias = bias_found.where("rule_id IS NOT NULL").select("doc_id", "rule_id").distinct().withColumn("_bias", F.lit(True))
    r = rule_found.join(by_bias, ["doc_id", "rule_id"], "left")
    is_forbidden = F.col("rule_type") == "forbidden"
    category = F.when(is_forbidden & F.col("_bias"), "confirmed").when(is_forbidden | (F.col("risk_level") == "high"), "high_risk").when(F.col("risk_level") == "medium", "needs_review").otherwise("advisory")
    rules = r.withColumn("category", category).select("doc_id", F.lit("rule").alias("source"), "risk_level", "category", F.concat(F.lit("["), "rule_id", F.lit("] "), F.left(F.coalesce("description", F.lit("")), F.lit(80))).alias("title"), F.coalesce("text", F.lit("")).alias("evidence"), F.when(F.col("category") == "confirmed", 0.95).otherwise(0.80).alias("confidence"))
    free = bias_found.join(rule_found.select("doc_id", "rule_id").distinct(), ["doc_id", "rule_id"], "left_anti")
    bias = free.select("doc_id", F.lit("bias").alias("source"), F.when(F.col("severity") == "critical", "high").otherwise(F.col("severity")).alias("risk_level"), F.when(F.col("severity").isin("critical", "high"), "high_risk").otherwise("needs_review").alias("category"), F.concat(F.lit("["), "pattern_id", F.lit("]")).alias("title"), F.col("matched_text").alias("evidence"), "confidence")
    model = model_found.select("doc_id", F.lit("llm").alias("source"), "risk_level", F.when(F.col("risk_level") == "high", "high_risk").otherwise("needs_review").alias("category"), F.concat(F.lit("["), "type", F.lit("]")).alias("title"), F.col("text").alias("evidence"), F.lit(0.65).alias("confidence"))
    return rules.unionByName(bias).unionByName(model)


def verdicts(docs: DataFrame, items: DataFrame, quality: Column | str = "ok") -> DataFrame:
    """FUS-7: one row per document: counts, level, passed, review status. quality ("ok", "text_layer", "ocr", "partial", "failed"; a column or one value): a bad one raises low and
    medium by one."""
    n = lambda c: F.count_if(F.col("category") == c).alias(f"{c}_count")
    own = docs.join(items.groupBy("doc_id").agg(*(n(c) for c in ("confirmed", "high_risk", "needs_review", "advisory"))), "doc_id", "left").na.fill(0, [f"{c}_count" for c in ("confirmed", "high_risk", "needs_review", "advisory")])
    return _judged(own.withColumn("_q", quality if isinstance(quality, Column) else F.lit(quality)))


def _judged(own: DataFrame) -> DataFrame:
    q = F.col("_q")
    c, h, r = F.col("confirmed_count"), F.col("high_risk_count"), F.col("needs_review_count")
    level = F.when(c >= 2, "critical").when((c > 0) | (h > 0), "high").when(r > 0, "medium").otherwise("low")
    up = q.isin("ocr", "partial", "failed")
    passed = (c == 0) & (h == 0)
    return own.select(
        "doc_id", "confirmed_count", "high_risk_count", "needs_review_count", "advisory_count", level.alias("risk_level_original"), F.when(up & (level == "low"), "medium").when(up & (level == "medium"), "high").otherwise(level).alias("risk_level"),
        passed.alias("final_passed"), F.when(passed & (r == 0), "auto_passed").when(c > 0, "auto_failed").otherwise("needs_review").alias("review_status"), (~(passed & (r == 0))).alias("requires_human_review"), F.when(up, "upgraded").otherwise("none").alias("parse_quality_adjustment"),
    )


def gathered(rule_found: DataFrame, bias_found: DataFrame | None, model_found: DataFrame) -> DataFrame:
    """(doc_id, rules, bias, model): the findings of each document as three arrays, by one union and one shuffle: what fusion looks at of each. A document's findings follow its text."""
    r = F.struct("rule_id", "rule_type", "risk_level", F.col("weight").cast("double").alias("weight"), section_name(F.coalesce(F.nullif("location", F.lit("")), "description")).alias("section"), F.coalesce(F.nullif("text", F.lit("")), "description").alias("text"))
    m = F.struct("risk_level", F.col("weight").cast("double").alias("weight"), F.coalesce(F.nullif("section", F.lit("")), section_name("text")).alias("section"), "text")
    parts = [rule_found.select("doc_id", r.alias("rules")), model_found.select("doc_id", m.alias("model"))]
    if bias_found is not None:
        parts.append(bias_found.select("doc_id", F.struct("rule_id", "severity").alias("bias")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    if bias_found is None:
        every = every.withColumn("bias", F.lit(None).cast("struct<rule_id:string,severity:string>"))
    return every.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("rules", "bias", "model")))


def _with_findings(docs: DataFrame, found: DataFrame) -> DataFrame:
    own = docs.select("doc_id").join(found, "doc_id", "left")
    return own.select("doc_id", *(F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("rules", "bias", "model")))


def reports_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """FUS-5 over gathered findings: see reports."""
    own = _with_findings(docs, found)
    # FUS-1
    covered = lambda m: (m["text"] != "") & F.exists("rules", lambda r: (r["section"] != "") & (r["section"] == m["section"]) & (r["risk_level"] == m["risk_level"]) & r["text"].contains(m["text"]))
    own = own.withColumn("_kept", F.filter("model", lambda m: ~F.coalesce(covered(m), F.lit(False))))
    n = lambda c, risk: F.size(F.filter(c, lambda x: x["risk_level"] == risk))
    counts = [(n("rules", r) + n("_kept", r)).cast("long").alias(f"{r}_count") for r in RISKS]
    # SCO-2
    order = lambda x: F.when(x["risk_level"] == "high", 0).when(x["risk_level"] == "medium", 1).otherwise(2)
    ranked = F.array_sort(F.transform("rules", lambda x: F.struct(order(x).alias("o"), (-x["weight"]).alias("w"), x["risk_level"].alias("risk_level"), x["weight"].alias("weight"))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    own = own.withColumn("_r", total(F.transform(ranked, lambda x, k: risk_penalty(x["risk_level"], x["weight"]) / F.sqrt(k + 1)))).withColumn("_m", total(F.transform("model", lambda x: risk_penalty(x["risk_level"], x["weight"]))))
    some = F.size("model") > 0
    cut = lambda x: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - x)), 1)
    both = F.when(some, F.col("_r") * 0.6 + F.col("_m") * 0.4).otherwise(F.col("_r"))
    return own.select(
        "doc_id", *counts, (F.size("rules") + F.size("_kept")).cast("long").alias("violation_count"), (F.size("model") - F.size("_kept")).cast("long").alias("dedup_cross_engine"), cut(both).alias("total_score"), F.bround("_r", 1).alias("rule_penalty"), F.bround("_m", 1).alias("llm_penalty"),
        cut(F.col("_r")).alias("rule_raw_score"), F.when(some, cut(F.col("_m"))).otherwise(100.0).alias("llm_raw_score"),
    )


def verdicts_of(docs: DataFrame, found: DataFrame, quality: Column | str = "ok") -> DataFrame:
    """FUS-6 and FUS-7 over gathered findings: the counts of risk_items, and their verdicts."""
    own = _with_findings(docs, found)
    ids = lambda c: F.transform(c, lambda x: x["rule_id"])
    own = own.withColumn("_by_bias", F.array_distinct(ids("bias"))).withColumn("_by_rule", F.array_distinct(ids("rules")))
    has = lambda c, x: x.isNotNull() & F.coalesce(F.array_contains(c, x), F.lit(False))
    rule = lambda x: F.when((x["rule_type"] == "forbidden") & has("_by_bias", x["rule_id"]), "confirmed").when((x["rule_type"] == "forbidden") | (x["risk_level"] == "high"), "high_risk").when(x["risk_level"] == "medium", "needs_review").otherwise("advisory")
    bias = F.transform(F.filter("bias", lambda x: ~has("_by_rule", x["rule_id"])), lambda x: F.when(x["severity"].isin("critical", "high"), "high_risk").otherwise("needs_review"))
    model = F.transform("model", lambda x: F.when(x["risk_level"] == "high", "high_risk").otherwise("needs_review"))
    own = own.withColumn("_c", F.concat(F.transform("rules", rule), bias, model))
    n = lambda c: F.size(F.filter("_c", lambda x: x == c)).cast("long").alias(f"{c}_count")
    return _judged(own.select("doc_id", *map(n, ("confirmed", "high_risk", "needs_review", "advisory")), (quality if isinstance(quality, Column) else F.lit(quality)).alias("_q")))


def reports(docs: DataFrame, rule_found: DataFrame, model_found: DataFrame) -> DataFrame:
    """FUS-5: one row per document: counts by risk over both lists (the model's without what rules cover), number of findings removed, and SCO-2 with the model's whole list."""
    return reports_of(docs, gathered(rule_found, None, model_found))
