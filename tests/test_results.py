"""Results by content: a second run reads no text, a changed rule is evaluated alone, rows equal a full run."""

from pyspark.sql import functions as F

from auditlake.operators import rules
from auditlake.operators.results import Results
from auditlake.sources import packs

RULES = [{"rule_id": "A", "type": "forbidden", "target": "t", "pattern": "ab+"}, {"rule_id": "B", "type": "forbidden", "target": "t", "pattern": "cd", "exclude_contexts": ["x"]}, {"rule_id": "C", "type": "forbidden", "target": "a.b"}, {"rule_id": "A2", "type": "forbidden", "target": "t", "pattern": "ab+"}, {"rule_id": "K", "type": "keyword_required", "target": "k", "keyword": "ab"}]


def rows(df):
    return sorted(map(repr, df.collect()))


def test_only_what_is_new_is_computed(spark, tmp_path):
    first = spark.createDataFrame([(1, "s", "ab cd", 0), (1, "t", "x cd\nabb", 1), (2, "s", "ab cd", 0), (3, "s", None, 0), (4, "s", "", 0)], "doc_id long, section_type string, content string, ord int")
    more = spark.createDataFrame([(5, "s", "abbb a.b", 0), (6, "u", "ab cd", 0)], first.schema)
    pack = packs.rules_from(spark, RULES)
    store = Results(spark, str(tmp_path), 4)
    assert store.run(pack).count() == 0  # no texts yet
    store.put(first)
    assert rows(store.run(pack)) == rows(rules.forbidden_matches(first, pack)) and store.last == {"texts": 3, "rules": 3, "loads": [1]}
    assert rows(store.run(pack)) == rows(rules.forbidden_matches(first, pack)) and store.last == {"texts": 0, "rules": 0, "loads": []}

    store.put(more)  # one text is new, one stands at a new place
    every = first.unionByName(more)
    assert rows(store.run(pack)) == rows(rules.forbidden_matches(every, pack)) and store.last == {"texts": 1, "rules": 3, "loads": [2]}

    changed = packs.rules_from(spark, [*RULES[:1], RULES[1] | {"pattern": "c.", "severity": "high"}, RULES[2] | {"severity": "low"}])
    again = Results(spark, str(tmp_path), 4)  # another session would open it so
    assert rows(again.run(changed)) == rows(rules.forbidden_matches(every, changed)) and again.last == {"texts": 4, "rules": 1, "loads": [1, 2]}
    assert rows(again.run(pack)) == rows(rules.forbidden_matches(every, pack)) and again.last["texts"] == 0
    assert again.run(pack.limit(0)).count() == 0


def test_hashes_meet_without_an_exchange_and_without_texts(spark, tmp_path):
    store = Results(spark, str(tmp_path), 4)
    store.put(spark.range(50).select("id", F.concat(F.lit("ab "), F.col("id").cast("string")).alias("content")).select(F.col("id").alias("doc_id"), F.lit("s").alias("section_type"), "content"))
    pack = packs.rules_from(spark, RULES)
    store.run(pack)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = store.lacking(["x"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "content" not in plan and "SortMergeJoin" in plan


def test_a_broken_run_leaves_nothing_that_counts(spark, tmp_path, monkeypatch):
    sections = spark.createDataFrame([(1, "s", "ab cd", 0)], "doc_id long, section_type string, content string, ord int")
    pack = packs.rules_from(spark, RULES)
    store = Results(spark, str(tmp_path), 4)
    store.put(sections)
    whole = Results._append

    def breaks(self, df, name):
        whole(self, df, name)
        if name == "seen":
            raise RuntimeError("lost")

    monkeypatch.setattr(Results, "_append", breaks)
    try:
        store.run(pack)
    except RuntimeError:
        pass
    monkeypatch.setattr(Results, "_append", whole)
    assert rows(store.run(pack)) == rows(rules.forbidden_matches(sections, pack)) and store.last["texts"] == 1
