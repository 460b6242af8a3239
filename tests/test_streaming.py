"""Streams give what the batch operators give."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from auditlake.operators import state as batch
from auditlake.streaming import state as stream


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of state is a Python worker and a store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EVENTS = "/root/testdata/sf0.001/events.parquet"


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def files(spark, tmp_path):
    from pyspark.sql import Window

    e = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    cut = e.withColumn("part", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for k in (1, 2, 3):
        cut.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))


def test_rate_limit(spark, tmp_path):
    e, s = files(spark, tmp_path)
    got = {tuple(r) for r in run(spark, stream.rate_limited(s, most=2, seconds=864_000).where("not late").drop("late"), "limited", "append").collect()}
    assert got == {tuple(r) for r in batch.rate_limited(e, most=2, seconds=864_000).collect()}


def test_feedback(spark, tmp_path):
    e, s = files(spark, tmp_path)
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "false_positive").otherwise("missed")
    as_feedback = lambda df: df.select(F.col("user_id").cast("string").alias("rule_id"), "ts", "event_id", kind.alias("feedback_type"))
    rows = run(spark, stream.feedback_state(as_feedback(s)), "feedback", "update").collect()
    last = {}
    for r in rows:  # of each key the state with most feedbacks is the last
        if r.rule_id not in last or r.total_feedbacks > last[r.rule_id].total_feedbacks:
            last[r.rule_id] = r
    want = {r.rule_id: (round(r.current_confidence, 9), r.total_feedbacks, r.needs_review) for r in batch.feedback_state(as_feedback(e)).collect()}
    assert {k: (round(r.current_confidence, 9), r.total_feedbacks, r.needs_review) for k, r in last.items()} == want


def test_quota_counters(spark, tmp_path):
    e, s = files(spark, tmp_path)
    usage = lambda df: df.withColumn("tokens", F.lit(2))
    got = {tuple(r) for r in run(spark, stream.monthly_quota(usage(s)), "quota", "complete").collect()}
    assert got == {tuple(r) for r in stream.monthly_quota(usage(e)).collect()}


def test_mining_runs_once_per_case(spark, tmp_path):
    c = spark.createDataFrame([(1, "upheld", "品牌", "", 0), (2, "upheld", "业绩", "", 0)], "case_id long, decision_type string, raw_content string, summary string, is_analyzed int")
    folder, out, mark = (str(tmp_path / x) for x in ("cases", "out", "mark"))
    for k in (1, 2):
        c.where(F.col("case_id") == k).write.mode("append").parquet(folder)
        stream.mine_cases(spark.readStream.schema(c.schema).parquet(folder), out, mark).awaitTermination(120)
    assert sorted(r.rule_id for r in spark.read.parquet(out).collect()) == ["R104", "R107"]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


class Feed:
    """Files that come one after another, and runs over what is there, with one checkpoint."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, f, mode="append"):
        """The rows that this run gives, and its query."""
        self.n += 1
        out, s = f"{self.path}/out{self.n}", self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        q = stream.run_available(f(s), lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}"), f"{self.path}/checkpoint", mode)
        q.awaitTermination(120)
        return [r for r in self.spark.read.parquet(out).drop("batch").collect()], q

    def state(self, name=None):
        return stream.state_of(self.spark, f"{self.path}/checkpoint", name)


def test_limits_after_a_restart_with_late_rows_and_timers(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id string, ts timestamp, event_id long")
    limited = lambda s: stream.rate_limited(s, most=2, seconds=60, late="10 seconds")
    feed.put(("a", at(0), 1), ("a", at(1), 2), ("a", at(2), 3), (None, at(1), 4), ("c", at(1), 5))
    assert sorted(map(tuple, feed.run(limited)[0])) == [("a", 1, True, False), ("a", 2, True, False), ("a", 3, False, False), ("c", 5, True, False)]
    assert {r.key.user_id: r.value.event_id for r in feed.state("newest").collect()} == {"a": 3, "c": 5}
    feed.put(("a", at(0), 6), ("a", at(59), 7), ("a", at(60), 8), ("b", at(500), 9))  # a new query goes on with the state
    assert sorted(map(tuple, feed.run(limited)[0])) == [("a", 6, None, True), ("a", 7, False, False), ("a", 8, True, False), ("b", 9, True, False)]
    assert {r.key.user_id for r in feed.state("newest").collect()} == {"b"}  # a and c are out of every window
    feed.put(("a", at(100), 10), ("a", at(501), 11))
    got, q = feed.run(limited)
    assert [tuple(r) for r in got] == [("a", 11, True, False)] and stream.late_rows(q) == 1


def test_feedback_keeps_types_counts_late_rows_and_leaves_null_keys_out(spark, tmp_path):
    feed = Feed(spark, tmp_path, "rule_id long, ts timestamp, event_id long, feedback_type string")
    feed.put((1, at(5), 1, "confirm"), (1, at(6), 2, "false_positive"), (None, at(1), 3, "confirm"), (1, at(7), 4, "other"), (2, at(1), 5, "missed"))
    got = {r.rule_id: r for r in feed.run(stream.feedback_state, "update")[0]}
    assert set(got) == {1, 2} and got[1].current_confidence == 0.95 and got[2].total_feedbacks == 1 and got[1].late_count == 0
    feed.put((1, at(4), 6, "false_positive"), (1, at(9), 7, "false_positive"))
    got = {r.rule_id: r for r in feed.run(stream.feedback_state, "update")[0]}
    assert set(got) == {1} and got[1].current_confidence == 0.85 and got[1].late_count == 1 and got[1].needs_review and got[1].alert
    counts = {(r.user_map_key.kind, r.key.rule_id): r.user_map_value.n for r in feed.state("counts").collect()} if "user_map_key" in feed.state("counts").columns else None
    assert counts is None or counts["false_positive", 1] == 3


def test_a_hot_key_of_feedback_equals_batch(spark, tmp_path):
    rows = [(1 if i % 3 else i, at(i % 50), i, ["confirm", "false_positive", "missed", "confirm"][i % 4]) for i in range(900)]
    feed = Feed(spark, tmp_path, "rule_id long, ts timestamp, event_id long, feedback_type string")
    feed.put(*rows)
    got = {r.rule_id: (r.current_confidence, r.total_feedbacks, r.alert) for r in feed.run(stream.feedback_state, "update")[0]}
    assert got == {r.rule_id: (r.current_confidence, r.total_feedbacks, r.alert) for r in batch.feedback_state(spark.createDataFrame(rows, feed.schema)).collect()}


def test_feedback_has_a_time_to_live(spark, tmp_path):
    feed = Feed(spark, tmp_path, "rule_id long, ts timestamp, event_id long, feedback_type string")
    kept = lambda s: stream.feedback_state(s, keep=dt.timedelta(seconds=2))
    feed.put((1, at(5), 1, "false_positive"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # by the clock there is always one more
    try:
        assert feed.run(kept, "update")[0][0].current_confidence == 0.95
        time.sleep(3)
        feed.put((1, at(6), 2, "false_positive"))
        got = feed.run(kept, "update")[0]
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [(r.current_confidence, r.total_feedbacks) for r in got] == [(0.95, 1)]


def test_quotas_of_closed_months_leave_no_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, ts timestamp, tokens long")
    day = lambda n: at(86_400 * n)
    feed.put((1, day(0), 5), (1, day(3), 6), (2, day(4), None), (None, day(1), 9), (1, day(40), 7))
    got = feed.run(stream.closed_quotas)[0]
    assert sorted(map(tuple, got)) == [(1, "2024-01", 2, 11), (2, "2024-01", 1, 0)]
    assert feed.state("months").count() == 1  # January is forgotten
    feed.put((1, day(2), 100), (1, day(41), 1), (3, day(70), 1))
    got, q = feed.run(stream.closed_quotas)
    assert [tuple(r) for r in got] == [(1, "2024-02", 2, 8)] and stream.late_rows(q) == 1
    assert feed.state("months").count() == 1


def test_windows_and_sessions_close_and_shrink(spark, tmp_path):
    schema = "user_id long, ts timestamp, model string, tokens long, success boolean"
    feed = Feed(spark, tmp_path / "w", schema)
    counted = lambda s: stream.usage_counts(s, "1 hour", "10 minutes")
    feed.put(*((k, at(60 * k), "m", 2, k % 2 == 0) for k in range(50)))
    assert feed.run(counted)[0] == [] and feed.state().count() == 1
    feed.put((1, at(7200), "m", 1, True))
    assert [tuple(r)[1:] for r in feed.run(counted)[0]] == [("m", 50, 100, 25)] and feed.state().count() == 1
    feed.put((1, at(10), "m", 1, True), (1, at(7300), "m", 1, True))
    got, q = feed.run(counted)
    assert got == [] and stream.late_rows(q) == 1
    feed = Feed(spark, tmp_path / "s", schema)
    sessions = lambda s: stream.usage_sessions(s, "30 minutes", "10 minutes")
    feed.put((1, at(0), "m", 1, True), (1, at(1000), "m", 2, True), (1, at(5000), "m", 4, True), (None, at(1), "m", 4, True))
    assert [(r.user_id, r.calls, r.tokens) for r in feed.run(sessions)[0]] == [(1, 2, 3)]
    feed.put((1, at(20_000), "m", 1, True))
    assert [(r.user_id, r.calls, r.tokens) for r in feed.run(sessions)[0]] == [(1, 1, 4)] and feed.state().count() == 1


def test_queries_stream_tables_that_are_folders(spark, tmp_path):
    from auditlake.plans import feeds

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    got, want = ({tuple(r) for r in feeds.stream_cases(spark, x).collect()} for x in (f"{tmp_path}/folder", "/root/testdata/sf0.001"))
    assert got == want and len(want) > 1
