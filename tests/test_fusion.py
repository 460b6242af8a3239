"""Fusion over gathered findings equals fusion by joins and windows, in one shuffle."""

import random

from pyspark.sql import functions as F

from auditlake.operators import fuse, scores

RULE = "doc_id long, rule_id string, rule_type string, risk_level string, weight double, location string, description string, text string"
BIAS = "doc_id long, rule_id string, severity string, pattern_id string, matched_text string, confidence double"
MODEL = "doc_id long, section string, type string, risk_level string, weight double, text string"


def findings(spark, seed=1, n=300):
    rng = random.Random(seed)
    pick = rng.choice
    risk, ids = ["high", "medium", "low", "critical", None], ["A", "B", "C", None]
    rule = [(pick(range(12)), pick(ids), pick(["forbidden", "keyword_required"]), pick(risk), pick([3.0, 10.0, 25.0]), pick(["s1 ~第3行", "《s2》", "", None]), pick(["缺少《s1》章节", "d", None]), pick(["some text here", "text", "", None])) for _ in range(n)]
    bias = [(pick(range(14)), pick(ids), pick(["critical", "high", "medium"]), "p", "m", 0.7) for _ in range(n // 6)]
    model = [(pick(range(6)), pick(["s1", "s2", "", None]), "t", pick(risk), pick([5.0, 20.0]), pick(["text", "some", "", None, "none"])) for _ in range(n // 3)]
    docs = spark.range(15).select(F.col("id").alias("doc_id"))
    return docs, spark.createDataFrame(rule, RULE), spark.createDataFrame(bias, BIAS), spark.createDataFrame(model, MODEL)


def test_reports_and_verdicts_equal_joins(spark):
    docs, rule, bias, model = findings(spark)
    found = fuse.gathered(rule, bias, model)
    want = fuse.verdicts(docs, fuse.risk_items(rule, bias, model)).orderBy("doc_id").collect()
    assert fuse.verdicts_of(docs, found).orderBy("doc_id").collect() == want
    kept = fuse.deduplicated(rule, model)
    counts = {(r.doc_id, r.risk_level): r["count"] for r in rule.select("doc_id", "risk_level").unionByName(kept.select("doc_id", "risk_level")).groupBy("doc_id", "risk_level").count().collect()}
    total = {r.doc_id: r for r in scores.total_scores(docs, rule, model).collect()}
    gone = {r.doc_id: r["count"] for r in model.groupBy("doc_id").count().collect()}
    left = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    for r in fuse.reports(docs, rule, model).collect():
        assert [r[f"{x}_count"] for x in fuse.RISKS] == [counts.get((r.doc_id, x), 0) for x in fuse.RISKS]
        assert r.dedup_cross_engine == gone.get(r.doc_id, 0) - left.get(r.doc_id, 0)
        assert abs(r.total_score - total[r.doc_id].total_score) < 0.11 and r.llm_raw_score == total[r.doc_id].llm_raw_score
    plan = fuse.verdicts_of(docs, found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_fusion_without_findings(spark):
    docs, rule, bias, model = findings(spark)
    none = fuse.gathered(rule.limit(0), bias.limit(0), model.limit(0))
    assert {r.risk_level for r in fuse.verdicts_of(docs, none).collect()} == {"low"}
    assert {(r.total_score, r.violation_count) for r in fuse.reports_of(docs, none).collect()} == {(100.0, 0)}
    assert fuse.verdicts_of(docs.limit(0), fuse.gathered(rule, bias, model)).count() == 0
