"""Folds with a floor and a cap that can be done in parts (AGG-9, STR-4).

A step x -> min(cap, max(floor, x + d)) and any row of such steps is x -> min(high, max(low, x + d)) for three numbers; two of these after one another are a third. So a sorted run of events folds to three
numbers whatever came before it, runs are cut anywhere, and a key with most of the events is the work of many tasks: events are range-partitioned by key and order, each task folds its runs pairwise, batch
by batch, and a key's few parts are put together in order. Numbers are whole units of a millionth, so the cuts do not change the last digit of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import ship

UNIT = 1_000_000
#: No bound: what a step that changes nothing has.
FREE = 1 << 62
PART = "piece int, part int, add long, low long, high long"


def units(x: float) -> int:
    return round(x * UNIT)


def compose(add: np.ndarray, low: np.ndarray, high: np.ndarray, more: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First one, then the other. A free bound stays free until a bound is met."""
    moved = lambda x: np.where(np.abs(x) >= FREE, x, x + more)
    return add + more, np.minimum(high2, np.maximum(low2, moved(low))), np.minimum(high2, np.maximum(low2, moved(high)))


def fold_runs(starts: np.ndarray, add: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps in runs that begin at `starts` -> one step per run: neighbours of a run in pairs, again and again."""
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(add))))
    while len(run) > len(starts):
        first = np.append(True, run[1:] != run[:-1])
        place = np.arange(len(run)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        left = np.flatnonzero(place % 2 == 0)
        paired = np.append(place[1:] % 2 == 1, False)[left] & np.append(run[1:] == run[:-1], False)[left]
        right = left[paired] + 1
        a, lo, hi = add[left], low[left], high[left]
        a[paired], lo[paired], hi[paired] = compose(a[paired], lo[paired], hi[paired], add[right], low[right], high[right])
        run, add, low, high = run[left], a, lo, hi
    return add, low, high


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, add, low, high, counters ...), sorted -> one row per key of a batch; part numbers keep the batches of a task in order."""
    context = TaskContext.get()
    piece = context.partitionId() if context else 0
    for number, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        key = batch.column(0)
        codes = key.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        folded = fold_runs(starts, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))
        counted = [np.add.reduceat(batch.column(k).to_numpy(zero_copy_only=False), starts) for k in range(4, batch.num_columns)]
        n = len(starts)
        arrays = [key.take(pa.array(starts)), pa.array(np.full(n, piece, np.int32)), pa.array(np.full(n, number, np.int32)), *map(pa.array, folded), *map(pa.array, counted)]
        yield pa.RecordBatch.from_arrays(arrays, [batch.schema.names[0], "piece", "part", "add", "low", "high", *batch.schema.names[4:]])


def clamped_parts(events: DataFrame, key: str, order: list[str], add: Column, floor: float, cap: float, counters: dict[str, Column], tasks: int | None = None) -> DataFrame:
    """(key, PART, counters): the steps of each key, folded as far as one batch of one task goes. add: what a step adds; null leaves the value as it is, bounds and all."""
    ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    step = F.round(add * UNIT).cast("long")
    bound = lambda x: F.when(step.isNull(), F.lit(FREE if x == cap else -FREE)).otherwise(F.lit(units(x)))
    own = events.where(F.col(key).isNotNull()).select(key, *order, F.coalesce(step, F.lit(0)).alias("add"), bound(floor).alias("low"), bound(cap).alias("high"), *(c.cast("long").alias(n) for n, c in counters.items()))
    dealt = own.repartitionByRange(tasks, key, *order) if tasks else own.repartitionByRange(key, *order)
    schema = f"`{key}` {kind}, {PART}" + "".join(f", `{n}` long" for n in counters)
    return dealt.sortWithinPartitions(key, *order).drop(*order).mapInArrow(_parts, schema)


def clamped_fold(events: DataFrame, key: str, order: list[str], add: Column, start: float, floor: float, cap: float, counters: dict[str, Column], value: str = "value", tasks: int | None = None) -> DataFrame:
    """(key, value, counters): the value of each key after all its events in order, and sums of the counters. Rows without a key are left out."""
    parts = clamped_parts(events, key, order, add, floor, cap, counters, tasks)
    steps = F.array_sort(F.collect_list(F.struct("piece", "part", "add", "low", "high")))
    each = parts.groupBy(key).agg(steps.alias("_s"), *(F.sum(n).alias(n) for n in counters))
    last = F.aggregate("_s", F.lit(units(start)).cast("long"), lambda x, s: F.least(s["high"], F.greatest(s["low"], x + s["add"])))
    return each.select(key, (last / UNIT).alias(value), *counters)
