"""Spans of matches: a sweep gives what meeting all spans gives, in time that follows their number."""

import random
import time

from pyspark.sql import functions as F

from auditlake.operators import rules
from auditlake.sources import packs


def test_sweep_equals_all_overlaps(spark):
    rng = random.Random(2)
    spans, found = [], []
    for d in range(8):
        for s in ("a", None):
            at = []
            for k in range(rng.randrange(12)):
                text = "x" * rng.choice([0, 1, 3, 9])
                start = at[-1][2] + 1 if at else 0
                at.append((k, start, start + len(text), rng.choice(["FIXED", "VARIABLE"])))
                spans.append((d, s, k, text, at[-1][3]))
            for r in range(15):
                a, n = rng.randrange(40), rng.choice([1, 2, 8])
                label = next((x[3] for x in at if a < x[2] and a + n > x[1]), "") if s else ""
                found += [(d, s, r, a, "y" * n, label)] * rng.choice([1, 1, 2])
    sp = spark.createDataFrame(spans, "doc_id long, section_type string, span_no int, text string, label string")
    df = spark.createDataFrame(found, "doc_id long, section_type string, rule_seq int, start int, matched string, want string")
    got = rules.with_span_label(df.where("section_type IS NOT NULL"), sp.where("section_type IS NOT NULL"))
    assert got.columns == [*df.columns, "span_label"] and got.count() == df.where("section_type IS NOT NULL").count()
    assert got.where("want <> span_label").count() == 0
    assert rules.with_span_label(df, sp.limit(0)).where("span_label <> ''").count() == 0 and rules.with_span_label(df.limit(0), sp).count() == 0
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_spans_and_matches_of_one_section(spark):
    n = 10_000
    sp = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("section_type"), F.col("id").cast("int").alias("span_no"), F.lit("word word").alias("text"), F.when(F.col("id") % 2 == 0, "FIXED").otherwise("VARIABLE").alias("label"))
    df = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("section_type"), F.lit(0).alias("rule_seq"), (F.col("id") * 10 + 3).cast("int").alias("start"), F.lit("d").alias("matched"))
    t = time.time()
    assert {r.span_label: r["count"] for r in rules.with_span_label(df, sp).groupBy("span_label").count().collect()} == {"FIXED": n // 2, "VARIABLE": n // 2}
    assert time.time() - t < 20
    m = 2000
    sections = spark.createDataFrame([(1, "a", " ".join(["word word"] * m), 0)], "doc_id long, section_type string, content string, ord int")
    pack = packs.rules_from(spark, [{"rule_id": "F", "type": "forbidden", "target": "t", "pattern": "d w"}])
    t = time.time()
    got = rules.run(sections.select("doc_id"), sections, pack, sp.where(F.col("span_no") < m)).groupBy("span_label").count().collect()
    assert sum(r["count"] for r in got) == 2 * m - 1 and time.time() - t < 60
