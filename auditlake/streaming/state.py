"""State over streams (STR-*): the batch operators' semantics per key, kept between micro-batches; batch and stream results are compared in the tests.

Keyed state is typed state of transformWithState in RocksDB: it lives on the executors' disks with a change log in the checkpoint, is read back by the state data source (`state_of`), and each kind of it
has an end: event-time timers (limits, quotas), time to live (feedback) or the watermark (windows, sessions). Rows without a key are left out, as in batch, and keys keep their type. Rows that are older
than the watermark are not taken; `late_rows` counts them. Rows of a key in a micro-batch are sorted as numbers, 24 bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from auditlake.operators import mine
from auditlake.operators.fold import FREE, UNIT, fold_runs, units
from auditlake.operators.state import ALERT_RATE, BOOST, CAP, FLOOR, PENALTY, REVIEW_FROM
from auditlake.session import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONG = lambda *names: StructType([StructField(n, LongType()) for n in names])


def stateful(df: DataFrame) -> DataFrame:
    """What typed state needs: the RocksDB store for queries started from now on, and this package on the workers."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(df.sparkSession)
    return df


def _sorted(frames: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """The columns of all rows of a key, sorted by the first two."""
    parts = [[f[c].to_numpy() for c in columns] for f in frames]
    whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((whole[1], whole[0]))
    return [x[order] for x in whole]


class _Limiter(StatefulProcessor):
    """State of a key: the newest event decided, and the times of the last accepted ones, which a timer takes away once they are out of every window."""

    def __init__(self, key: str, most: int, seconds: int):
        self.key, self.most, self.span = key, most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _LONG("t", "event_id"))
        self.last = handle.getListState("last", _LONG("t"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t, event, _ = _sorted(rows, "t", "event_id", "event_id")
        seen = self.newest.get() if self.newest.exists() else None
        last = [r[0] for r in self.last.get()] if self.last.exists() else []
        late = np.zeros(len(t), bool) if seen is None else (t < seen[0]) | ((t == seen[0]) & (event < seen[1]))
        ok: list[bool | None] = []
        for at, behind in zip(t.tolist(), late.tolist(), strict=True):
            if behind:  # newer events of the key are decided already
                ok.append(None)
                continue
            yes = len(last) < self.most or last[0] <= at - self.span
            if yes:
                last = (last if len(last) < self.most else last[1:]) + [at]
            ok.append(yes)
        if not late.all():
            self.newest.update((int(t[-1]), int(event[-1])))
            self.last.put([(x,) for x in last])
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((int(t[-1]) + self.span) // 1000 + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(t), "event_id": event, "accepted": pd.array(ok, dtype="boolean"), "late": late})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.newest.clear()
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, key: str = "user_id", most: int = 10, seconds: int = 60, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """STR-1/2: events(key, at, event_id) -> (key, event_id, accepted, late), append mode. Events of a micro-batch are taken in order of (at, event_id), micro-batches as they come: an event that is older than
    one of its key that an earlier micro-batch decided is marked late and not decided. A key's state goes when the watermark is `seconds` past its last event."""
    kind = events.schema[key].dataType.simpleString()
    ts = F.col(at).cast("timestamp")
    own = stateful(events).where(F.col(key).isNotNull() & ts.isNotNull()).select(F.col(key), ts.alias("ts"), F.unix_micros(ts).alias("t"), F.col("event_id").cast("long").alias("event_id")).withWatermark("ts", late)
    return own.groupBy(key).transformWithStateInPandas(_Limiter(key, most, seconds), f"`{key}` {kind}, event_id long, accepted boolean, late boolean", "Append", "EventTime")


class _Feedback(StatefulProcessor):
    """State of a key: its confidence in millionths, the newest event, and a map of how often each kind came; all with one time to live."""

    KINDS = ("confirm", "false_positive", "missed")

    def __init__(self, key: str, keep: timedelta | None):
        self.key, self.keep = key, None if keep is None else int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", _LONG("confidence", "t", "event_id", "late"), self.keep)
        self.counts = handle.getMapState("counts", StructType([StructField("kind", StringType())]), _LONG("n"), self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t, event, kind = _sorted(rows, "t", "event_id", "kind")
        c, seen, seen_event, late = self.value.get() if self.value.exists() else (units(1.0), -FREE, -FREE, 0)
        late += int(((t < seen) | ((t == seen) & (event < seen_event))).sum())
        add = np.array([units(BOOST), -units(PENALTY), 0])[kind]
        low, high = (np.where(kind == 2, free, bound) for free, bound in ((-FREE, units(FLOOR)), (FREE, units(CAP))))
        step = [int(x[0]) for x in fold_runs(np.zeros(1, np.int64), add, low, high)]
        c = min(step[2], max(step[1], c + step[0]))
        newest = max((seen, seen_event), (int(t[-1]), int(event[-1])))
        self.value.update((c, *newest, late))
        n = []
        for k, name in enumerate(self.KINDS):
            there = self.counts.getValue((name,))[0] if self.counts.containsKey((name,)) else 0
            n.append(there + int((kind == k).sum()))
            self.counts.updateValue((name,), (n[-1],))
        yes, no = n[:2]
        yield pd.DataFrame({self.key: [key[0]], "current_confidence": [c / UNIT], "total_feedbacks": [sum(n)], "confirm_count": [yes], "false_positive_count": [no], "needs_review": [no >= REVIEW_FROM], "alert": [no / sum(n) >= ALERT_RATE], "late_count": [late]})

    def close(self) -> None:
        pass


def feedback_state(feedback: DataFrame, key: str = "rule_id", keep: timedelta | None = None) -> DataFrame:
    """STR-4: feedback(key, ts, event_id, feedback_type) -> the state of each key that a micro-batch changed (update mode). Events count when they come; late_count tells those that
    were older than one before. keep: a key that hears nothing for so long (by the clock) begins anew; a run over
    what is available then ends only with spark.sql.streaming.noDataMicroBatches.enabled off, as by the clock there is always one more batch."""
    kind = feedback.schema[key].dataType.simpleString()
    code = F.array_position(F.array(*map(F.lit, _Feedback.KINDS)), F.col("feedback_type")) - 1
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    own = stateful(feedback).where(F.col("feedback_type").isin(*_Feedback.KINDS) & F.col(key).isNotNull()).select(key, F.coalesce(t, F.lit(0)).alias("t"), F.col("event_id").cast("long").alias("event_id"), code.cast("long").alias("kind"))
    out = f"`{key}` {kind}, current_confidence double, total_feedbacks long, confirm_count long, false_positive_count long, needs_review boolean, alert boolean, late_count long"
    return own.groupBy(key).transformWithStateInPandas(_Feedback(key, keep), out, "Update", "None" if keep is None else "ProcessingTime")


class _Quota(StatefulProcessor):
    """State of a key: a map from month to (end in milliseconds, requests, tokens). A month is handed out, and forgotten, when the watermark passes its end."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", StructType([StructField("month", StringType())]), _LONG("end", "files", "tokens"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for (month, end), n in frame.groupby(["month", "end"], sort=True):
                _, files, tokens = self.months.getValue((month,)) if self.months.containsKey((month,)) else (0, 0, 0)
                self.months.updateValue((month,), (int(end), files + len(n), tokens + int(n["tokens"].sum())))
                self.handle.registerTimer(int(end))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        over = expiredTimerInfo.getExpiryTimeInMs()
        done = [(m[0], v) for m, v in self.months.iterator() if v[0] == over]
        for m, _ in done:
            self.months.removeKey((m,))
        if done:
            yield pd.DataFrame({self.key: [key[0]] * len(done), "period_key": [m for m, _ in done], "files_used": [v[1] for _, v in done], "tokens_used": [v[2] for _, v in done]})

    def close(self) -> None:
        pass


def closed_quotas(usage: DataFrame, key: str = "user_id", late: str = "1 day") -> DataFrame:
    """STR-6: usage(key, ts, tokens) -> requests and tokens of each key and month (append mode), once, when the watermark has passed the month's end; nothing is kept of it then."""
    kind = usage.schema[key].dataType.simpleString()
    ts = F.col("ts").cast("timestamp")
    end = F.unix_millis(F.date_trunc("month", F.add_months(F.date_trunc("month", ts), 1)))
    own = stateful(usage).where(F.col(key).isNotNull() & ts.isNotNull()).select(F.col(key), ts.alias("ts"), F.date_format(ts, "yyyy-MM").alias("month"), end.alias("end"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).withWatermark("ts", late)
    return own.groupBy(key).transformWithStateInPandas(_Quota(key), f"`{key}` {kind}, period_key string, files_used long, tokens_used long", "Append", "EventTime")


def _timed(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def usage_counts(usage: DataFrame, every: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    """AGG-1 over a stream: usage(ts, model, tokens, success) by model (or keys) and window; in append mode a window is given once, when the watermark passes it."""
    keys = keys or ("model",)
    own = _timed(usage, late).groupBy(F.window("ts", every), *keys).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.count_if(F.col("success")).alias("ok"))
    return own.select(F.col("window.start").alias("start"), *keys, "calls", "tokens", "ok")


def usage_sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """AGG-1 by sessions: a key's requests with pauses under the gap; in append mode a session is given once, when the watermark passes its end."""
    own = _timed(usage.where(F.col(key).isNotNull()), late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return own.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "calls", "tokens")


def monthly_quota(usage: DataFrame) -> DataFrame:
    """STR-6 as it stands: tokens and requests of each user and month, for update or complete mode; its state is one row for each. closed_quotas forgets what is over."""
    return usage.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("period_key")).agg(F.count("*").alias("files_used"), F.sum("tokens").alias("tokens_used"))


def state_of(spark: SparkSession, checkpoint: str, name: str | None = None, operator: int = 0) -> DataFrame:
    """The state that a checkpoint holds, by the state data source: key, value, partition_id. name: of a typed state ("newest", "last", "value", "counts", "months")."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    return (reader if name is None else reader.option("stateVarName", name)).load(checkpoint)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query left out as older than its watermark, in the progress that is still kept."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def mine_cases(stream: DataFrame, out: str, checkpoint: str, known: list[tuple[str, str]] | None = None, decided: list[str] | None = None):
    """STR-5: mines the cases that are new since the last run (Trigger.AvailableNow): each is analysed once, as the checkpoint remembers what was read. A micro-batch that is
    repeated after a failure overwrites its own folder, so nothing is counted twice."""

    def sink(batch: DataFrame, number: int) -> None:
        mine.known_patterns(batch, known, decided).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """SYN-6: a scheduled job is one run over what is available; the schedule is outside."""
    return df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
