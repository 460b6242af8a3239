"""Folds in parts equal folds in one go; prefixes are found by equality."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.operators import fold, state, stats


@given(st.lists(st.sampled_from([20_000, -50_000, None]), min_size=1, max_size=60), st.data())
@settings(max_examples=200, deadline=None)
def test_runs_fold_as_single_steps_do(steps, data):
    cut = sorted(data.draw(st.sets(st.integers(1, max(1, len(steps) - 1)), max_size=4)) | {0})
    cut = np.array([c for c in cut if c < len(steps)])
    add = np.array([s or 0 for s in steps])
    low = np.array([-fold.FREE if s is None else 500_000 for s in steps])
    high = np.array([fold.FREE if s is None else 1_000_000 for s in steps])
    parts = zip(*fold.fold_runs(cut, add, low, high), strict=True)
    start = got = data.draw(st.integers(0, 1_500_000))
    for a, lo, hi in parts:
        got = min(hi, max(lo, got + a))
    want = start
    for s in steps:
        want = want if s is None else min(1_000_000, max(500_000, want + s))
    assert got == want


def _feedback(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.02 else "hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.randrange(n // 3), i, rng.choice(["confirm", "confirm", "confirm", "false_positive", "missed", "other", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "rule_id string, ts long, event_id long, feedback_type string").repartition(7)


def test_a_hot_key_is_folded_by_many_tasks(spark):
    rows, df = _feedback(spark, 4000)
    want = {}
    for k, _, _, kind in sorted(rows, key=lambda r: r[1:3]):
        if k is None or kind not in ("confirm", "false_positive", "missed"):
            continue
        c, n, yes, no = want.get(k, (1.0, 0, 0, 0))
        c = min(1.0, max(0.5, c + 0.02)) if kind == "confirm" else min(1.0, max(0.5, c - 0.05)) if kind == "false_positive" else c
        want[k] = (round(c, 9), n + 1, yes + (kind == "confirm"), no + (kind == "false_positive"))
    got = {r.rule_id: (r.current_confidence, r.total_feedbacks, r.confirm_count, r.false_positive_count) for r in state.feedback_state(df, tasks=16).collect()}
    assert got == want
    parts = fold.clamped_parts(df, "rule_id", ["ts", "event_id"], F.lit(0.02), 0.5, 1.0, {"n": F.lit(1)}, 16)
    pieces = {r.piece: r.n for r in parts.where("rule_id = 'hot'").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    assert len(pieces) >= 6 and max(pieces.values()) < 800


@pytest.mark.parametrize("kind", ["string", "long", "date"])
def test_keys_keep_their_type_and_empty_tables_give_none(spark, kind):
    df = spark.createDataFrame([("2020", 1, 1, "confirm"), (None, 1, 2, "confirm")], "rule_id string, ts long, event_id long, feedback_type string").withColumn("rule_id", F.col("rule_id").cast(kind))
    got = state.feedback_state(df)
    assert got.schema["rule_id"].dataType.simpleString() == ("bigint" if kind == "long" else kind) and got.count() == 1
    assert state.feedback_state(df.limit(0)).count() == 0


def test_prefix_join_keeps_every_row(spark):
    limits = spark.createDataFrame([(1, "/api", 60, 30), (0, "/api/check", 10, 60), (2, "/api/check/x", 1, 1), (5, "/z", 9, 9), (3, "/z", 7, 7), (4, None, 1, 1)], "ord int, prefix string, most int, seconds int")
    rows = [("/api/check/x", 1), ("/api/check/x", 1), ("/api", 2), ("/ap", 3), (None, 4), ("/zz", 5), ("", 6)]
    out = state.longest_prefix_limits(spark.createDataFrame(rows, "path string, n int"), limits)
    got = sorted(((r.path, r.n, r.most) for r in out.collect()), key=repr)
    assert got == sorted([("/api/check/x", 1, 10), ("/api/check/x", 1, 10), ("/api", 2, 60), ("/ap", 3, None), (None, 4, None), ("/zz", 5, 7), ("", 6, None)], key=repr)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert state.longest_prefix_limits(spark.createDataFrame(rows, "path string, n int"), limits.limit(0)).where("most IS NULL").count() == 7


def test_prices_by_prefix(spark):
    rows = [("qwen-plus-latest", 1000, 1000, 0.0, None), ("qwen-plusX", 0, 500, None, None), ("other", 5, 5, 0.0, 0.0), (None, 5, 5, None, None), ("other", 1000, 0, 2.0, 0.0)]
    got = [round(r.cost, 9) for r in stats.priced(spark.createDataFrame(rows, "model string, prompt_tokens long, completion_tokens long, price_in double, price_out double")).orderBy("prompt_tokens", "completion_tokens", "model").collect()]
    assert sorted(got) == sorted([0.008, 0.003, 0.0, 0.0, 2.0])
