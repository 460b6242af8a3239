"""What the operators of this subpackage share: the shared folder, tables cut out of the lineage, hashing of words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import shared_dir, ship

#: White space in UTF-8 bytes: words are `[^\x20\x09-\x0D]+`.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Whatever is not in words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: of ASCII only digits and a-z are.
NOT_ALNUM = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) for b in range(256)])
LINE_FEED = np.arange(256) == 0x0A
#: A-Z to lower case, all other bytes as they are; no byte of a longer UTF-8 sequence is in A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes looked at in one step; temporaries take about 60 bytes for each.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: From so many partitions on they grow before their number does, up to so many bytes.
PARTITIONS, LARGEST = 10_000, 512 << 20

_made: list[Scratch] = []


@contextmanager
def passing() -> Iterator[None]:
    """Whatever operators keep inside the block goes at its end: for steps whose result is written inside it."""
    first = len(_made)
    try:
        yield
    finally:
        for scratch in _made[first:]:
            scratch.drop()
        del _made[first:]


class Scratch:
    """Tables of one call in the shared folder. A written table cuts the lineage: what is read back survives lost executors and is never computed again."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/auditlake/{what}-{uuid.uuid4().hex}"
        _made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def written_bytes(self, name: str) -> int:
        fs, p = self._at(f"{self.path}/{name}")
        return fs.getContentSummary(p).getLength()

    def partitions(self, name: str, size: int = 16 << 20) -> int:
        """How many partitions a kept table makes at about so many written bytes each; as many as there are cores at least. A table of more than PARTITIONS of them has larger ones, up to LARGEST, as each is
        an entry of every map task's list: what is done in a partition is streamed, so its size is no matter of memory."""
        total = self.written_bytes(name)
        size = max(size, min(LARGEST, total // PARTITIONS))
        return max(self.spark.sparkContext.defaultParallelism, -(-total // size))

    def drop(self, *names: str) -> None:
        """Removes tables of this call (all of it without names) by Spark's own file system."""
        for path in [f"{self.path}/{x}" for x in names] or [self.path]:
            fs, p = self._at(path)
            fs.delete(p, True)


#: Rows of a table of two hashes and two numbers a row, about, that may be broadcast: 64 MB.
SENT_ROWS = 1_000_000


def sent_if_small(short: DataFrame) -> DataFrame:
    """The table, marked to be broadcast if a count of its rows allows it; beyond that Spark joins it by a shuffle. It is counted, so it should be cheap to make."""
    return F.broadcast(short) if short.limit(SENT_ROWS + 1).count() <= SENT_ROWS else short


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names near the wanted ones that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1024, size: int = 4 << 20) -> DataFrame:
    """mapInArrow by slices of a batch of at most so many rows and about so many bytes (one row at least): a worker's memory follows a few rows and
    not the batch size of the session."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
            for k in range(0, batch.num_rows, step):
                out = f(batch.slice(k, step))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one after another, and where each value begins (one more at the end). Null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Tokens:
    """The words of a batch of texts: hash (64 bits), start and end (in the batch's bytes), and first[i]: the first word of text i (one more at the end)."""

    __slots__ = ("end", "first", "hash", "start")

    def __init__(self, raw: np.ndarray, at: np.ndarray, apart: np.ndarray):
        """apart: for each byte value, whether it separates words."""
        hashes, starts, ends = [], [], []
        a, n = 0, len(raw)
        while a < n:
            b = min(n, a + PIECE)
            if b < n:  # cut where no word is cut
                gap = np.flatnonzero(apart[raw[a:b]])
                edge = at[np.searchsorted(at, b, "right") - 1]
                cut = max(a + int(gap[-1]) + 1 if len(gap) else a, int(edge))
                if cut <= a:  # one word longer than a piece
                    cut = b
                    stop = int(at[np.searchsorted(at, a, "right")])
                    while cut < stop and not apart[raw[cut]]:
                        more = np.flatnonzero(apart[raw[cut : cut + PIECE]])
                        cut = min(stop, cut + (int(more[0]) if len(more) else PIECE))
                b = cut
            seg = raw[a:b]
            inside = ~apart[seg]
            new = np.zeros(b - a + 1, bool)
            new[at[np.searchsorted(at, a) : np.searchsorted(at, b, "right")] - a] = True
            before = np.concatenate(([False], inside[:-1]))
            after = np.concatenate((inside[1:], [False]))
            start = np.flatnonzero(inside & (~before | new[:-1]))
            if len(start):
                end = np.flatnonzero(inside & (~after | new[1:])) + 1
                size = end - start
                first = np.cumsum(size) - size
                where = np.flatnonzero(inside)
                place = np.arange(len(where)) - np.repeat(first, size)
                z = BYTE_HASH[((place & 63) << 8) | seg[where]]
                if size.max() > 64:
                    z = z * (2 * (place >> 6) + 1).astype(np.uint64)
                hashes.append(mix(np.add.reduceat(z, first) + size.astype(np.uint64)))
                starts.append(start + a)
                ends.append(end + a)
            a = b
        none = np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.first = np.searchsorted(self.start, at)

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]


class Texts:
    """A batch of texts as bytes, with what several operators look at: made once, when first asked for."""

    def __init__(self, column: pa.Array):
        self.raw, self.at = utf8(column)
        self.docs = len(column)

    @cached_property
    def spaced(self) -> Tokens:
        return Tokens(self.raw, self.at, SPACE)

    @cached_property
    def counts(self) -> np.ndarray:
        """(texts, 256): how often each byte value stands in each text."""
        out = np.empty((self.docs, 256), np.int64)
        for i, (a, b) in enumerate(zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)):
            out[i] = np.bincount(self.raw[a:b], minlength=256)
        return out

    def count(self, of: np.ndarray) -> np.ndarray:
        """How many bytes of the values marked in `of` each text has."""
        return self.counts @ of.astype(np.int64)


def first_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, twice): whether a key equals one before it, and whether it equals any other one."""
    n = len(keys)
    later, twice = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        start = np.flatnonzero(np.concatenate(([True], ~same)))
        later[:] = True
        later[np.minimum.reduceat(order, start)] = False
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return later, twice


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte at each of 64 places of a word; a word's hash is their sum, so it is that of the whole word.
BYTE_HASH = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes, order told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out) + h[j : n + j]
    return mix(out + np.uint64(k))


def words_of(column: str | Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` as an array, empty for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def binary_array(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def bounded_sample(labelled: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n of the rows, the first by a hash of the keys: the same rows on every call, independent of partitions. The rows (ids and labels, no texts) pass
    through the driver, so what comes back is small enough to broadcast, and is marked so."""
    first = labelled.orderBy(F.xxhash64(*keys), *keys).limit(n).collect()
    return F.broadcast(labelled.sparkSession.createDataFrame(first, labelled.schema))


def one_each(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Of rows that repeat the keys one: that with the least hash of its text. So a sample bounded by ids is bounded in rows."""
    others = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.xxhash64(text)).alias("_one"))
    return one.select(*(F.col(c) if c in keys else F.col(f"_one.{c}") for c in rows.columns))


def fold_of(column: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % folds


def doc_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches [first[i], first[i + 1])."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[first[1:]] - total[first[:-1]]
