"""SQL functions equal the column functions; stored reports are read by paths."""

from pyspark.sql import functions as F

from auditlake.functions import sql, text
from auditlake.operators import stats
from auditlake.sources import documents, packs


def test_sql_functions_equal_column_functions(spark):
    sql.register(spark)
    rows = [(" a，（b）\n c—d", 2, 84.9), ("", 0, 40.0), (None, 1, None), ("x\ny\nz", 4, 85.0), ("　全角", 1, 10.0)]
    df = spark.createDataFrame(rows, "t string, n int, s double")
    df.createOrReplaceTempView("surface")
    got = spark.sql("SELECT audit_normalized(t), audit_text_hash(t), audit_line_of(t, n), audit_risk_level(s), audit_tokens(t), audit_rule_id('UFB-', t) FROM surface").collect()
    want = df.select(text.normalized("t"), text.text_hash("t"), text.line_of("t", "n"), text.risk_of_score("s"), text.tokens_estimate("t"), text.short_id("UFB-", "t")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    lines = spark.sql("SELECT n, l.* FROM surface, LATERAL audit_lines(t) l WHERE n = 4 ORDER BY line_no").collect()
    assert [tuple(r) for r in lines] == [(4, 0, "x"), (4, 1, "y"), (4, 2, "z")]


def test_matches_of_a_pack_in_sql(spark):
    pack = packs.rules_from(spark, [{"rule_id": "A", "type": "forbidden", "target": "t", "pattern": "ab+|x"}, {"rule_id": "B", "type": "forbidden", "target": "a.b"}, {"rule_id": "K", "type": "keyword_required", "target": "k", "keyword": "a"}])
    assert sql.register(spark, pack)[-2:] == ["audit_matches", "audit_match_rows"]
    spark.createDataFrame([(1, "ABB a.b"), (2, None), (3, ""), (4, "xx")], "id long, t string").createOrReplaceTempView("surface")
    want = [(1, 0, "A", 0, "ABB"), (1, 1, "B", 4, "a.b"), (4, 0, "A", 0, "x"), (4, 0, "A", 1, "x")]
    assert sorted(map(tuple, spark.sql("SELECT id, m.* FROM surface, LATERAL inline(audit_matches(t)) m").collect())) == want
    assert sorted(map(tuple, spark.sql("SELECT * FROM audit_match_rows(TABLE(SELECT id, t FROM surface))").collect())) == want


def test_stored_reports_are_read_by_paths(spark, tmp_path):
    entry = F.struct(F.col("r").alias("rule_id"), F.lit("s").alias("section"), F.lit("high").alias("risk_level"), F.lit(7).alias("more"))
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, None)], "report_id long, r string").groupBy("report_id").agg(F.collect_list(entry).alias("rule_violations"))
    documents.write_reports(rows, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    assert stored.schema["report_data"].dataType.simpleString() == "variant"
    as_text = stored.select("report_id", F.to_json("report_data").alias("report_data")).unionByName(spark.createDataFrame([(4, "no json"), (5, None), (6, '{"rule_violations": 3}'), (7, '{"rule_violations": [{"rule_id": "A"}, 5]}')], "report_id long, report_data string"))
    got = {r.rule_id: (r.hit_count, r.total_reports) for r in stats.rule_effectiveness(stored).collect()}
    assert got == {"A": (2, 3), "B": (1, 3), "unknown": (1, 3)}
    got = {r.rule_id: (r.hit_count, r.total_reports) for r in stats.rule_effectiveness(as_text).collect()}
    assert got == {"A": (3, 7), "B": (1, 7), "unknown": (2, 7)}
    plan = stats.risk_heatmap(stats.violations_of(stored))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<report_data" in plan and "rule_violations:array" not in plan.split("ReadSchema")[1].split(">")[0].replace("report_data", "")


def test_fingerprints_of_many_sectors_are_few_folders(spark, tmp_path):
    own = spark.range(600).select(F.when(F.col("id") > 0, F.concat(F.lit("s "), (F.col("id") / 2).cast("int").cast("string"), F.lit("/a=b"))).alias("sector"), F.lit("m").alias("method"), F.lit("p").alias("project_type"), F.col("id").cast("string").alias("hash_id"), F.lit("n\n").alias("normalized"), F.lit("t").alias("text"), F.col("id").alias("frequency"), F.lit(2).alias("length"))
    documents.write_fingerprints(own, str(tmp_path / "p"))
    assert 1 < len([x for x in (tmp_path / "p").iterdir() if x.is_dir()]) <= documents.PRINT_BUCKETS
    back = documents.read_fingerprints(spark, str(tmp_path / "p"))
    assert back.columns == ["method", "project_type", "hash_id", "normalized", "text", "frequency", "length", "sector"]
    assert {tuple(r) for r in back.select(own.columns).collect()} == {tuple(r) for r in own.collect()} and back.count() == 600
    one = documents.read_fingerprints(spark, str(tmp_path / "p"), "s 7/a=b")
    assert sorted(r.hash_id for r in one.collect()) == ["14", "15"] and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
