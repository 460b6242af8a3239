"""Rule checks, scores, bias, routing on small documents of the kind the packs are for."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text as fn
from auditlake.operators import bias, fuse, routing, rules, scores
from auditlake.sources import packs

# shortened rules in the form of a pack
PACK = [
    {"rule_id": "SEC-1", "type": "chapter_required", "target": "投标人须知", "weight": 25.0}, {"rule_id": "SEC-2", "type": "chapter_required", "target": "评标办法", "weight": 20.0}, {"rule_id": "SEC-3", "type": "chapter_required", "target": "合同草案", "weight": 10.0},
    {"rule_id": "KEY-1", "type": "keyword_required", "target": "k", "keyword": "预算", "target_section": "招标公告", "weight": 15.0}, {"rule_id": "KEY-2", "type": "keyword_required", "target": "k", "keyword": "营业执照", "weight": 10.0}, {"rule_id": "KEY-3", "type": "keyword_required", "target": "k", "keyword": "x", "target_section": "知识产权", "weight": 5.0},
    {"rule_id": "FORB-1", "type": "forbidden", "target": "t", "pattern": "指定品牌", "severity": "critical", "weight": 25.0}, {"rule_id": "FORB-1", "type": "forbidden", "target": "t", "pattern": "唯一[授权|供应]", "severity": "high", "weight": 20.0},
    {"rule_id": "FORB-2", "type": "forbidden", "target": "t", "pattern": "CMA", "severity": "medium", "weight": 10.0, "exclude_contexts": ["不要求"]}, {"rule_id": "FMT-1", "type": "format_required", "target": "密封要求", "weight": 3.0}, {"rule_id": "FMT-2", "type": "format_required", "target": "页码", "weight": 3.0},
]
TEXTS = {"招标公告": "项目编号一\n采购项目", "投标须知": "投标人须知\n文件应密封提交", "资格要求": "营业执照\n\n要求提供指定品牌产品，唯一授权cma报告", "评审办法": "不要求CMA证书"}


@pytest.fixture(scope="module")
def data(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "第一章 投标人须知\n一、合同草案")], "doc_id long, text string")
    sections = spark.createDataFrame([(1, k, v, i) for i, (k, v) in enumerate(TEXTS.items())], "doc_id long, section_type string, content string, ord int")
    return docs, sections, packs.rules_from(spark, PACK)


def test_chapters_by_synonym(data):
    docs, sections, pack = data
    assert [r.rule_id for r in rules.missing_chapters(docs, sections, pack).collect()] == ["SEC-3"]


def test_chapters_of_a_document_without_sections(data):
    docs, _, pack = data
    got = rules.missing_chapters_by_title(docs.where("doc_id = 2"), pack).collect()
    assert [r.rule_id for r in got] == ["SEC-2"] and got[0].risk_level == "high"


def test_keywords(data):
    docs, sections, pack = data
    got = {r.rule_id: r for r in rules.missing_keywords(docs.where("doc_id = 1"), sections, pack).collect()}
    assert {k: (v.risk_level, v.location) for k, v in got.items()} == {"KEY-1": ("high", "应在《招标公告》中"), "KEY-3": ("medium", "应在《知识产权》中")}


def test_keywords_in_fingerprint_mode_skip_fixed_spans(data, spark):
    docs, sections, pack = data
    spans = spark.createDataFrame([(1, "资格要求", 2, 0, "营业执照", "FIXED"), (1, "资格要求", 2, 1, "其他", "VARIABLE"), (1, "招标公告", 0, 0, " ", "VARIABLE")], "doc_id long, section_type string, ord int, span_no int, text string, label string")
    got = {r.rule_id for r in rules.missing_keywords(docs.where("doc_id = 1"), sections, pack, spans).collect()}
    assert "KEY-2" in got


def test_forbidden_offsets_lines_and_exclusions(data):
    _, sections, pack = data
    got = sorted((r.section_type, r.start, r.matched, r.line_no, r.rule_seq) for r in rules.forbidden_matches(sections, pack).collect())
    # a class in brackets is one character; the excluded context drops the last section's match; case does not matter
    assert got == [("资格要求", 10, "指定品牌", 3, 6), ("资格要求", 17, "唯一授", 3, 7), ("资格要求", 21, "cma", 3, 8)]


def test_span_labels_suppress_only_in_fingerprint_mode(data, spark):
    _, sections, pack = data
    spans = spark.createDataFrame([(1, "资格要求", 2, 0, "营业执照", "VARIABLE"), (1, "资格要求", 2, 1, "要求提供指定品牌产品，唯一授权cma报告", "FIXED")], "doc_id long, section_type string, ord int, span_no int, text string, label string")
    assert rules.forbidden(sections, pack, spans, fingerprint_mode=True).count() == 0
    kept = rules.forbidden(sections, pack, spans).collect()
    assert {r.span_label for r in kept} == {"FIXED"} and {r.template_confidence for r in kept} == {0.3}


def test_formats_and_run(data):
    docs, sections, pack = data
    assert [r.rule_id for r in rules.missing_formats(docs.where("doc_id = 1"), sections, pack).collect()] == ["FMT-2"]
    counts = {(r.doc_id, r.rule_type): r["count"] for r in rules.run(docs, sections, pack).groupBy("doc_id", "rule_type").count().collect()}
    assert counts[1, "forbidden"] == 3 and counts[2, "chapter_required"] == 1 and counts[2, "keyword_required"] == 3


def test_bad_patterns_are_rejected(spark):
    pack = packs.rules_from(spark, [{"rule_id": "A", "type": "forbidden", "target": "t", "pattern": "("}, {"rule_id": "B", "type": "forbidden", "target": "t", "pattern": "a*"}, {"rule_id": "C", "type": "odd", "target": "t"}, {"rule_id": "D", "type": "forbidden", "target": "t", "pattern": "a+"}])
    ok, bad = packs.checked(pack)
    assert [r.rule_id for r in ok.collect()] == ["D"]
    assert {r.rule_id: r.reason for r in bad.collect()} == {"A": "does not compile", "B": "matches the empty string", "C": "unknown type"}


def test_platform_codes_once_each(data, spark):
    _, sections, pack = data
    m = spark.createDataFrame([("FORB-1", "p", "c", "d"), ("FORB-1", "p", "c", "e"), ("FORB-1", "q", None, "")], "rule_id string, platform string, platform_code string, description string")
    got = rules.platform_codes(rules.forbidden(sections, pack), m).where("rule_id = 'FORB-1'").collect()
    assert len(got) == 2 and all([(p.platform, p.code) for p in r.platform_codes] == [("p", "c"), ("q", "")] for r in got)


def test_scores(spark):
    docs = spark.range(1, 4).toDF("doc_id")
    found = spark.createDataFrame([(1, "forbidden", 25.0), (1, "forbidden", 20.0), (1, "forbidden", 10.0)] + [(2, "forbidden", 25.0)] * 40, "doc_id long, rule_type string, weight double")
    got = {r.doc_id: r for r in scores.rule_scores(docs, found).collect()}
    assert (got[1].forbidden_score, got[1].total_score, got[1].section_score) == (55.1, 55.1, 100.0)
    assert got[2].total_score == 5.0 and got[3].total_score == 100.0


def test_total_score_and_critical_counts_as_low(spark):
    docs = spark.range(1, 4).toDF("doc_id")
    r = spark.createDataFrame([(1, "high", 25.0), (1, "medium", 10.0), (2, "critical", 25.0)], "doc_id long, risk_level string, weight double")
    m = spark.createDataFrame([(1, "low", 10.0)], "doc_id long, risk_level string, weight double")
    got = {x.doc_id: x.total_score for x in scores.total_scores(docs, r, m).collect()}
    assert got == {1: 88.1, 2: 98.0, 3: 100.0}


@pytest.mark.parametrize(("budget", "method", "light", "tasks"), [(500_000.0, "公开招标", "green", 0), (10_000_000.0, "单一来源", "red", 17), (3_000_000.0, "邀请招标", "yellow", 6), (2_000_000.0, "?", "yellow", 6), (None, "", "green", 0), (1_000_000.0, "", "green", 0), (5_000_000.0, "", "yellow", 6), (None, None, "green", 0)])
def test_routing(spark, budget, method, light, tasks):
    r = routing.routed(spark.createDataFrame([(budget, method)], "budget double, method string")).first()
    assert (r.traffic_light, len(r.llm_tasks), r.skip_llm) == (light, tasks, light == "green")


def test_bias(spark):
    every = list(bias.FIELDS)
    rx = bias.patterns_of(spark, [{"pattern_id": k, "check_fields": every} for k in bias.DEDICATED] + [{"pattern_id": "g", "check_fields": ["technical_params"], "keywords": ["没有", "售后*服务"], "severity": "medium"}])
    sections = spark.createDataFrame([(1, "技术要求", "汇聚交换机须与核心交换机为同一品牌。售后及时服务"), (2, "资格要求", "须提供原厂授权函及原厂售后服务承诺函"), (3, "资格要求", "须提供国家检测中心出具的CMA检测报告"), (4, "资格要求", "具有独立法人资格"), (5, "其他", "同一品牌")], "doc_id long, section_type string, content string")
    got = sorted((r.doc_id, r.pattern_id, r.severity, r.confidence, r.matched_text) for r in bias.findings(sections, rx).collect())
    assert got == [(1, "brand_lock_series", "critical", 0.85, "须与核心交换机为同一品牌"), (1, "g", "medium", 0.7, "售后*服务"), (2, "manufacturer_authorization", "high", 0.8, "原厂授权"), (3, "detection_report_lock", "high", 0.75, "CMA")]
    s = {r.doc_id: r.risk_score for r in bias.scores(spark.range(1, 6).toDF("doc_id"), bias.findings(sections, rx)).collect()}
    assert s == {1: 30.0, 2: 12.0, 3: 12.0, 4: 0.0, 5: 0.0}


def test_cross_engine_dedup(spark):
    r = spark.createDataFrame([(1, "评审办法 ~第1行", "d", "high", "指定品牌XXXX作为唯一授权产品", 25.0)], "doc_id long, location string, description string, risk_level string, text string, weight double")
    m = spark.createDataFrame([(1, 1, "评审办法", "high", "指定品牌"), (1, 2, "其他", "high", "指定品牌"), (1, 3, "评审办法", "medium", "指定品牌"), (1, 4, "评审办法", "high", "别的"), (1, 5, "", "high", "指定品牌"), (2, 6, "评审办法", "high", "指定品牌")], "doc_id long, seq int, section string, risk_level string, text string")
    assert sorted(x.seq for x in fuse.deduplicated(r, m).collect()) == [2, 3, 4, 5, 6]


def test_section_names(spark):
    rows = [("应在《资格要求》中", "资格要求"), ("评审办法 ~第1行", "评审办法"), ("资格要求：投标人条件", "资格要求"), ("招标公告: 项目概况", "招标公告"), ("缺少《招标公告》章节", "招标公告"), ("评审办法章节内容缺失", ""), ("", ""), (None, "")]
    got = spark.createDataFrame(rows, "x string, want string").select("want", fn.section_name("x").alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_model_answers(spark):
    rows = [(1, '[{"type":"bias","text":"a"}]'), (2, '```json\n[{"type":"bias","text":"a","confidence":1.7,"evidence_text":"e","basis":"b","risk_level":"xx"}]\n```'), (3, 'so [{"type":"odd","text":"a"},{"type":"bias","text":""}] end'), (4, "none"), (5, '```\n[{"type":"bias","text":"a","confidence":"x"}]\n```'), (6, "[]")]
    ok, bad = fuse.parsed(spark.createDataFrame(rows, "doc_id long, response string").withColumn("chunk_no", F.lit(0)))
    got = {r.doc_id: (r.confidence, r.evidence, r.law_ref, r.risk_level) for r in ok.collect()}
    assert got == {1: (0.5, "", None, "medium"), 2: (1.0, "e", "b", "medium"), 5: (0.5, "", None, "medium")}
    assert sorted((r.doc_id, r.reason) for r in bad.collect()) == [(3, "text"), (3, "type"), (4, "no JSON array")]


def test_four_way_merge(spark):
    docs = spark.range(1, 6).toDF("doc_id")
    r = spark.createDataFrame([(1, "F1", "forbidden", "critical", "d", "t"), (1, "F1", "forbidden", "critical", "d", "t"), (2, "F1", "forbidden", "low", "d", "t"), (3, "K", "keyword_required", "low", "d", None)], "doc_id long, rule_id string, rule_type string, risk_level string, description string, text string")
    b = spark.createDataFrame([(1, "F1", "p", "critical", "m", 0.8), (4, None, "p", "medium", "m", 0.7)], "doc_id long, rule_id string, pattern_id string, severity string, matched_text string, confidence double")
    m = spark.createDataFrame([], "doc_id long, type string, risk_level string, text string")
    items = fuse.risk_items(r, b, m)
    got = {x.doc_id: (x.risk_level, x.final_passed, x.review_status) for x in fuse.verdicts(docs, items).collect()}
    assert got == {1: ("critical", False, "auto_failed"), 2: ("high", False, "needs_review"), 3: ("low", True, "auto_passed"), 4: ("medium", True, "needs_review"), 5: ("low", True, "auto_passed")}
    up = {x.doc_id: (x.risk_level, x.risk_level_original) for x in fuse.verdicts(docs, items, "ocr").collect()}
    assert up[4] == ("high", "medium") and up[5] == ("medium", "low")


def test_reviewer_takes_the_first_keyword_and_a_snippet(spark):
    s = spark.createDataFrame([(1, "资格要求", "一二三四五六七八九十一二三四五六七须为本市注册的本地企业，注册资本不限")], "doc_id long, section_type string, content string")
    got = sorted((r.seq, r.keyword, r.type) for r in fuse.reviewed(s).collect())
    assert got == [(0, "本地企业", "exclusivity"), (3, "注册资本", "hidden_barrier")]


def test_one_pass_equals_the_four_checks(spark):
    from auditlake.plans import demo, tender

    d = "/root/testdata/sf0.001"
    docs, sections, pack, spans = (f(spark, d) for f in (demo.docs, demo.sections, lambda s, _: demo.pack(s), tender.spans))
    docs = docs.union(spark.createDataFrame([(-1,)], "doc_id long")).withColumn("text", F.lit("第一章 scope\n二、公告"))
    sections, spans = sections.cache(), spans.cache()
    for own, mode in ((None, False), (spans, False), (spans, True)):
        args = (docs, sections, pack, own, mode, demo.SYNONYMS, demo.FORMATS)
        one, four = (sorted(map(repr, x.collect())) for x in (rules.run(*args), rules.run_apart(*args)))
        assert len(one) > 200 and one == four
    lines = packs.rules_from(spark, [{"rule_id": "K", "type": "keyword_required", "target": "k", "keyword": "a\nb"}])
    sections.unpersist()
    spans.unpersist()
    assert rules.run(docs.drop("text"), sections, lines).count() == docs.count()
    assert rules.run(docs, sections, pack.limit(0)).count() == 0 and rules.run(docs.limit(0), sections.limit(0), pack).count() == 0


def test_rule_run_scans_once(spark):
    from auditlake.plans import demo

    plan = demo.found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") <= 3 and "BroadcastNestedLoopJoin" not in plan


def test_quick_check_looks_for_near_fingerprints(spark):
    from auditlake.operators import label

    text = "投标人应当在投标截止时间之前将投标文件送达开标地点并签字盖章"
    prints = spark.createDataFrame([("h1", text)], "hash_id string, text string").withColumn("hash_id", fn.text_hash("text"))
    rows = [(1, text), (2, text.replace("之前", "以前")), (3, "本项目采用综合评分法评审"), (4, "项目名称为（项目名称）")]
    got = {r.sid: (r.label, r.confidence) for r in label.quick_checked(spark.createDataFrame(rows, "sid long, text string"), prints).collect()}
    assert got[1] == ("FIXED", 0.95) and got[2] == ("FIXED", 0.8) and got[4] == ("VARIABLE", 0.9) and got[3][1] not in (0.95, 0.8)
    known = {r.sid: (r.is_fixed, r.confidence) for r in label.is_known_fixed(spark.createDataFrame(rows, "sid long, text string"), prints).collect()}
    assert known == {1: (True, 0.95), 2: (True, 0.8), 3: (False, 0.0), 4: (False, 0.0)}


def test_near_fingerprints_equal_a_plain_comparison(spark):
    import random

    from auditlake.operators import label

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 40))) for _ in range(25)]
    near = ["".join(c if rng.random() > 0.04 else rng.choice("abcdefgh") for c in x) for x in base for _ in range(3)] + ["common ending of all"] * 2
    texts, prints = [x + " the end" for x in near], [x + " the end" for x in base] + ["ab", ""]
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    norm = lambda x: x.replace(" ", "")
    want = {}
    for i, x in enumerate(texts):
        a = grams(norm(x))
        all_ = [len(a & b) / min(len(a), len(b)) for y in prints if (b := grams(norm(y))) and a and abs(len(norm(x)) - len(norm(y))) <= max(0.3 * len(norm(x)), 10)]
        if max(all_, default=0) >= 0.85:
            want[i] = round(max(all_), 9)
    p = spark.createDataFrame([(x,) for x in prints], "text string").withColumn("hash_id", fn.text_hash("text"))
    got = {r.sid: round(r.score, 9) for r in label.fuzzy(spark.createDataFrame(list(enumerate(texts)), "sid long, text string"), p).collect()}
    assert len(want) > 20 and got == want


def test_jobs_are_tried_again_and_remembered(spark, tmp_path):
    from auditlake.operators import sync

    waits, calls = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no answer")

    assert sync.run_job(spark, "rules", action, str(tmp_path / "h"), wait=waits.append) and waits == [1.0, 2.0]
    assert not sync.run_job(spark, "rules", lambda: 1 / 0, str(tmp_path / "h"), tries=2, wait=waits.append)
    got = sync.job_history(spark, str(tmp_path / "h"), "rules").collect()
    assert [(r.tries, r.ok) for r in got] == [(2, False), (3, True)] and got[0].error.startswith("ZeroDivisionError")
    assert sync.job_history(spark, str(tmp_path / "h"), "other").count() == 0


def test_merge_of_fifty_and_fifty_findings(spark):
    import time

    r = spark.createDataFrame([(1, f"R{i}", "forbidden", "high", 20.0, "《a》", f"text {i}", "") for i in range(50)], "doc_id long, rule_id string, rule_type string, risk_level string, weight double, location string, text string, description string").cache()
    m = spark.createDataFrame([(1, "bias", "a", f"text {i}" if i % 2 else f"other {i}", "high", 10.0) for i in range(50)], "doc_id long, type string, section string, text string, risk_level string, weight double").cache()
    assert r.count() == m.count() == 50
    docs = spark.createDataFrame([(1,)], "doc_id long")
    fuse.reports(docs, r, m).collect()
    began = time.perf_counter()
    got = fuse.reports(docs, r, m).first()
    print(f"merge of 50 and 50 findings: {time.perf_counter() - began:.2f} s (the limit of 1 s is reported, not held: it is mostly the start of jobs)")
    assert got.dedup_cross_engine == 25 and got.violation_count == 75
