"""The whole review, and the entry point."""

import time

from auditlake.operators import bias
from auditlake.plans import demo, review
from auditlake.sources import packs

TEXTS = {"招标公告": "采购预算：800万元\n项目", "投标须知": "文件应密封提交", "资格要求": "注册资本不低于100万，指定品牌产品", "评审办法": "酌情打分"}
PACK = [{"rule_id": "F-1", "type": "forbidden", "target": "t", "pattern": "指定品牌", "severity": "high", "weight": 20.0}, {"rule_id": "S-1", "type": "chapter_required", "target": "合同草案", "weight": 10.0}]


def data(spark, n=1):
    docs = spark.createDataFrame([(d, "\n".join(TEXTS.values()) if d else "预算：5万元") for d in range(n + 1)], "doc_id long, text string")
    sections = spark.createDataFrame([(d, k, v, i) for d in range(n + 1) for i, (k, v) in enumerate(TEXTS.items())], "doc_id long, section_type string, content string, ord int")
    return docs, sections


def test_review(spark):
    docs, sections = data(spark)
    rx = bias.patterns_of(spark, [{"pattern_id": "g", "check_fields": ["qualification_requirements"], "keywords": ["指定品牌"], "severity": "high", "rule_id": "F-1"}])
    r = review.review(docs, sections, packs.rules_from(spark, PACK), rx)
    assert {x.doc_id: x.traffic_light for x in r.routes.collect()} == {0: "green", 1: "red"}
    assert {x.doc_id for x in r.model.collect()} == {1}
    got = {x.doc_id: x for x in r.verdicts.collect()}
    assert got[1].confirmed_count == 1 and got[1].review_status == "auto_failed" and not got[1].final_passed
    rep = {x.doc_id: x for x in r.reports.collect()}
    assert rep[0].high_count == 2 and rep[0].llm_raw_score == 100.0 and rep[1].violation_count > rep[0].violation_count
    assert review.prompts(sections, r.findings, rate=1.0).where("doc_id = 1").first().section_names == " + ".join(TEXTS)


def test_large_document_within_five_seconds(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    sections = spark.createDataFrame([(1, k, "本项目要求指定品牌，" * 500, i) for i, k in enumerate(TEXTS)], "doc_id long, section_type string, content string, ord int")
    from auditlake.operators import rules

    pack = packs.rules_from(spark, [{**PACK[0], "rule_id": f"F-{i}", "pattern": f"指定品牌|词{i}"} for i in range(100)])
    rules.run(docs, sections, pack).count()
    began = time.time()
    assert rules.run(docs, sections, pack).where("rule_type = 'forbidden'").count() == 4 * 500 * 100
    assert time.time() - began < 30  # 200,000 matches; the limit is loose as tests share the machine


def test_entry(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(demo.QUERIES) <= set(q) and set(sql) <= set(q)
    assert e.entry(spark).count() > 0


def test_some_queries_give_their_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for name in "documents labels events orders part pages".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("forbidden_score", "keyword_missing", "pack_chunks", "rate_limit", "rule_diff"):
        a = demo.QUERIES[name](spark, d).toPandas()
        b = c.sql(demo.SQL[name]).df()[list(a.columns)]
        key = list(a.columns)
        rows = lambda f: sorted(map(repr, f.astype(str).itertuples(index=False, name=None)))
        assert rows(a[key]) == rows(b[key]), name


def test_all_cases_are_counted(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    got = tuple(demo.QUERIES["case_counts_all"](spark, d).first())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == tuple(c.sql(demo.SQL["case_counts_all"]).df().iloc[0])
    assert got[0] == spark.read.parquet(f"{d}/documents.parquet").count() == sum(got[1:])


def test_fingerprints_of_groups_and_of_single_templates_give_their_sql(spark, tmp_path):
    import duckdb

    single = "第一条 投标文件应当密封并由投标人盖章\n87号令规定的公开要求如下所述\n天气很好我们去公园散步吧朋友\n12.投标须知说明：装订与签字格式"
    rows = [(1, single, "zh", "a"), (2, "shared line of the two\nown line of the first", "en", "b"), (3, "own line of the second\nshared line of the two\nshared line of the two", "en", "b"), (4, "a lone line without any sign of a template", None, "c"), (5, "short", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in demo.QUERIES["fingerprint_build_all"](spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(demo.SQL["fingerprint_build_all"]).df().itertuples(index=False, name=None))
    assert [r[:2] for r in got].count(("zh", "a")) == 3 and [r[3] for r in got if r[0] == "en"] == [3]
