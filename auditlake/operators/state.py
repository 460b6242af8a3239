"""State that depends on order (AGG-9..12, STR-1/2).

Events are dealt out and sorted by key and time, and a task streams them with the state of one key, which is bounded: no key's events are gathered, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.fold import clamped_fold
from auditlake.session import ship

# fixed values: steps and bounds of a rule's confidence; limits of plans
BOOST, PENALTY, FLOOR, CAP = 0.02, 0.05, 0.5, 1.0
REVIEW_FROM, ALERT_RATE = 3, 0.3
PLANS = {"free": (5, 50_000), "pro": (100, 1_000_000), "enterprise": (999_999, 10_000_000)}
# end of the fixed values


def _folded(events: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], dict], step: Callable[[dict, pd.DataFrame], pd.DataFrame | None], end: Callable[[object, dict], dict] | None = None) -> DataFrame:
    """Streams events by key in order. step(state, rows of one key) changes the state, and may give rows; end(key, state) gives a row when a key is over."""
    ship(events.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, seen = None, start(), False
        for frame in frames:
            cut = frame[key].ne(frame[key].shift()).cumsum()
            for _, rows in frame.groupby(cut, sort=False):
                k = rows[key].iloc[0]
                if not seen or k != now:
                    if seen and end:
                        yield pd.DataFrame([end(now, state)])
                    now, state, seen = k, start(), True
                out = step(state, rows)
                if out is not None:
                    yield out
        if seen and end:
            yield pd.DataFrame([end(now, state)])

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def feedback_state(feedback: DataFrame, key: str = "rule_id", tasks: int | None = None) -> DataFrame:
    """AGG-9: feedback(key, ts, event_id, feedback_type): confidence from 1, +.02 for confirm (cap 1), -.05 for false_positive (floor .5), in order of (ts, event_id); counts; needs_review from three
    false positives on; alert from a rate of .3 on. Rows without a key are left out. One key's events are folded by many tasks (operators.fold)."""
    kind = F.col("feedback_type")
    one = lambda x: F.when(kind == x, 1).otherwise(0)
    own = feedback.where(kind.isin("confirm", "false_positive", "missed"))
    add = F.when(kind == "confirm", F.lit(BOOST)).when(kind == "false_positive", F.lit(-PENALTY))
    got = clamped_fold(own, key, ["ts", "event_id"], add, 1.0, FLOOR, CAP, {"total_feedbacks": F.lit(1), "confirm_count": one("confirm"), "false_positive_count": one("false_positive")}, "current_confidence", tasks)
    n = F.col("false_positive_count")
    return got.withColumn("needs_review", n >= REVIEW_FROM).withColumn("alert", n / F.col("total_feedbacks") >= ALERT_RATE)


def rules_to_review(state: DataFrame) -> DataFrame:
    """AGG-10"""
    return state.where("needs_review").orderBy("current_confidence")


def rate_limited(events: DataFrame, key: str = "user_id", most: int = 10, seconds: int = 60, at: str = "ts", order: str = "event_id") -> DataFrame:
    """STR-1/2: adds accepted: fewer than `most` accepted events of the key in the seconds before. Refused events do not count. The state of the fold is the last `most`
    accepted times: an event is refused if the oldest of them is still inside the window. Rows without a key are left out."""
    kind = events.schema[key].dataType.simpleString()
    own = events.where(F.col(key).isNotNull()).select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(order).cast("long").alias(order))

    def step(s: dict, rows: pd.DataFrame) -> pd.DataFrame:
        last, ok = s["last"], []
        for t in rows["_t"].tolist():
            yes = len(last) < most or last[0] <= t - seconds * 1_000_000
            if yes:
                last = (last if len(last) < most else last[1:]) + [t]
            ok.append(yes)
        s["last"] = last
        return pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), "accepted": ok})

    return _folded(own, key, ["_t", order], f"`{key}` {kind}, `{order}` long, accepted boolean", lambda: {"last": []}, step)


def by_prefix(rows: DataFrame, name: str, prefixes: DataFrame, prefix: str, order: Column, fields: list[str]) -> DataFrame:
    """JOI-10: each row with the fields of the first of the prefixes, by order, that its name begins with; null without one. The lengths of prefixes that occur are few: a row is looked up once for each, by
    equality. No rows are merged, and none vanish; a null name begins with nothing."""
    kept = prefixes.where(F.col(prefix).isNotNull()).groupBy(F.col(prefix).alias("_p")).agg(F.min(F.struct(order.alias("o"), *fields)).alias("_f"))
    lengths = sorted(r[0] for r in kept.select(F.length("_p")).distinct().collect())
    own = rows
    for k, n in enumerate(lengths):
        some = kept.where(F.length("_p") == n).select(F.col("_p").alias(f"_p{k}"), F.col("_f").alias(f"_f{k}"))
        # a shorter name is no candidate: left() would give it whole
        own = own.join(some, F.when(F.length(name) >= n, F.left(F.col(name), F.lit(n))) == F.col(f"_p{k}"), "left")
    found = [F.col(f"_f{k}") for k in range(len(lengths))]
    first = F.array_min(F.array_compact(F.array(*found))) if found else F.lit(None).cast(kept.schema["_f"].dataType)
    return own.withColumn("_first", first).select(*rows.columns, *(F.col(f"_first.{f}").alias(f) for f in fields))


def longest_prefix_limits(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """STR-2: each request with the limit (most, seconds) of the first prefix (by ord) of its path; null for a path without one."""
    return by_prefix(requests, "path", limits, "prefix", F.col("ord"), ["most", "seconds"])


def quota_status(usage: DataFrame, users: DataFrame, month: Column) -> DataFrame:
    """AGG-11: users(user_id, plan), usage(user_id, ts, files, tokens) -> used and remaining in the month; a user without usage has a full quota."""
    plans = F.broadcast(users.sparkSession.createDataFrame([(p, f, t) for p, (f, t) in PLANS.items()], "plan string, files_limit long, tokens_limit long"))
    own = usage.where(F.date_trunc("month", "ts") == F.date_trunc("month", month)).groupBy("user_id").agg(F.sum("files").alias("files_used"), F.sum("tokens").alias("tokens_used"))
    out = users.join(plans, "plan").join(own, "user_id", "left").na.fill(0, ["files_used", "tokens_used"])
    left = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col(b))
    out = out.withColumn("files_remaining", left("files_limit", "files_used")).withColumn("tokens_remaining", left("tokens_limit", "tokens_used"))
    return out.withColumn("exhausted", (F.col("files_remaining") <= 0) | (F.col("tokens_remaining") <= 0))


def files_accepted(requests: DataFrame, limit: Column | int, key: str = "user_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """AGG-12: file requests of a month in order: accepted up to the limit."""
    w = Window.partitionBy(key, F.date_trunc("month", F.col(at))).orderBy(at, order)
    return requests.withColumn("accepted", F.row_number().over(w) <= limit)


def tokens_accepted(requests: DataFrame, limit: int, tokens: str = "tokens", key: str = "user_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """AGG-12: token requests of a month in order: accepted while the sum before is under the limit, so it may be exceeded once; from then on none is."""
    w = Window.partitionBy(key, F.date_trunc("month", F.col(at))).orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("accepted", F.coalesce(F.sum(tokens).over(w), F.lit(0)) < limit)
