"""Line dedup without moving text: hashes of lines, range-partitioned and sorted, streamed once; the result is a compressed keep bitmap per document.

A row per document and distinct key (128-bit hash, doc_id, places of its lines) is range-partitioned by hash and doc_id and sorted by hash, then doc_id
from the largest. So the rows of a hash stand in a run whose first document is the one that keeps its lines, and a task streams its run with a constant
state. A very frequent hash is cut by its doc_ids into several partitions like anything else: what a partition cannot settle alone are the runs at its two edges, which
come out as they are and are joined with the first document and the number of documents (3 are enough) of those hashes, two rows per partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, free_name, map_batches, sent_if_small, table
from auditlake.session import ship

MIN_CHARS, MIN_DOCS = 20, 3
LINES = "h1 long, h2 long, doc_id long, row long, places array<int>"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped of `[\\x20\\x09-\\x0D]`, A-Z lower-cased; None if it has fewer code points."""
    key = line.strip().lower()
    return key if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars) else None


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs(doc_id, row, text) -> LINES: a row for each distinct key of a row."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, which, places = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            own: dict[bytes, list[int]] = {}
            for p, line in enumerate(text.encode("utf-8", "replace").split(b"\n")):
                key = line_key(line, min_chars)
                if key is not None:
                    own.setdefault(xxhash.xxh3_128_digest(key), []).append(p)
            keys += own
            places += own.values()
            which += [i] * len(own)
        h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        ids = batch.select([0, 1]).take(pa.array(which, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *ids.columns, pa.array(places, pa.list_(pa.int32()))], ["h1", "h2", "doc_id", "row", "places"])

    return map_batches(docs, f, LINES)


def ids_of(column: pa.Array) -> np.ndarray:
    """Null counts as one document, below all others."""
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


GONE = f"{LINES}, documents int"


def judged(min_docs: int):
    """Streams the sorted rows of a partition (LINES) -> GONE, in one pass and with constant state.

    A run that begins in the partition has its largest document first, so its rows are settled as they come once min_docs documents were seen: those whose lines go come
    out without a hash. The first run of a partition may have begun in an earlier one and the last run may go on: their rows come out with their hash wherever they are
    not settled, as does a row for each of the two (no places) with the largest document and the number of documents here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the rows of the open run, while it has too few documents to be settled
        first: tuple[int, int] | None = None  # hash of the partition's first run
        now: list | None = None  # the open run: hash, hash, largest, documents, last document

        def out(batch: pa.RecordBatch, at: np.ndarray, named: bool) -> pa.RecordBatch:
            rows = batch.take(pa.array(at))
            none = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([*(rows.columns[:2] if named else (none, none)), *rows.columns[2:], pa.nulls(len(at), pa.int32())], [*batch.schema.names, "documents"])

        def summary(x: list) -> pa.RecordBatch:
            largest = None if x[2] == np.iinfo(np.int64).min else int(x[2])
            return pa.RecordBatch.from_pydict({"h1": pa.array([x[0]], pa.int64()), "h2": pa.array([x[1]], pa.int64()), "doc_id": pa.array([largest], pa.int64()), "row": pa.nulls(1, pa.int64()), "places": pa.nulls(1, pa.list_(pa.int32())), "documents": pa.array([x[3]], pa.int32())})

        for batch in batches:
            if held is not None:
                batch, now, held = pa.concat_batches([held, batch]), None, None
            if not batch.num_rows:
                continue
            h1, h2, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy(), ids_of(batch.column(2))
            start = np.concatenate(([0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1))
            run_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h1))))
            goes_on = now is not None and (now[0], now[1]) == (h1[0], h2[0])
            new_doc = np.concatenate(([not goes_on or now[4] != doc[0]], (doc[1:] != doc[:-1]) | (run_of[1:] != run_of[:-1])))
            n = np.add.reduceat(new_doc.astype(np.int64), start)
            largest = doc[start].copy()
            if goes_on:
                largest[0], n[0] = now[2], now[3] + n[0]
            if first is None:
                first = (int(h1[0]), int(h2[0]))
            leading = (h1 == first[0]) & (h2 == first[1])
            if now is not None and not goes_on and tuple(now[:2]) == first:
                yield summary(now)
            if leading[0] and len(start) > 1:
                yield summary([*first, largest[0], min(min_docs, int(n[0]))])
            end = len(start) - 1
            now = [int(h1[-1]), int(h2[-1]), largest[end], min(min_docs, int(n[end])), doc[-1]]
            stop = len(h1)
            if n[end] < min_docs and not leading[-1]:
                stop = int(start[end])
                held = batch.slice(stop)
            if leading.any():
                yield out(batch, np.flatnonzero(leading), True)
            go = np.flatnonzero((n[run_of] >= min_docs) & (doc != largest[run_of]) & ~leading)
            go = go[go < stop]
            if len(go):
                yield out(batch, go, False)
        if now is not None:
            yield summary(now)
            if held is not None:
                yield out(held, np.arange(held.num_rows), True)

    return run


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """For each document that loses lines: doc_id, row (xxhash64 of its text, so that rows repeating a doc_id are told apart), n_dropped, keep (a bit per line in
    order, first line in the lowest bit, compressed with zlib). Documents that are not in it keep everything.

    Null or empty text is one empty line, which is no key. Rows that repeat a doc_id are one document. A null doc_id counts as one document below all others.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "line-dedup")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # written first: a range partitioner samples its input, which would else hash every text twice
    lines = scratch.keep(keyed_lines(text.select("doc_id", F.xxhash64("text").alias("row"), "text"), min_chars), "lines")
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    ordered = lines.repartitionByRange(scratch.partitions("lines"), *order).sortWithinPartitions(*order, "row")
    found = scratch.keep(ordered.mapInArrow(judged(min_docs), GONE), "judged")
    # two hashes of a partition at most, so a table as short as the list of partitions
    edges = found.where("documents IS NOT NULL").groupBy("h1", "h2").agg(F.max("doc_id").alias("largest"), F.sum("documents").alias("n")).where(F.col("n") >= min_docs)
    open_ = found.where("h1 IS NOT NULL AND documents IS NULL").join(sent_if_small(edges), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    gone = found.where("h1 IS NULL").select("doc_id", "row", "places").union(open_.select("doc_id", "row", "places"))
    gone = gone.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        maps, sizes = [], []
        for places in batch.column(2).to_pylist():
            bits = np.ones((max(places) + 8) // 8 * 8, np.uint8)
            bits[places] = 0
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            sizes.append(len(places))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "row", "n_dropped", "keep"])

    out = scratch.keep(map_batches(gone, pack, "doc_id long, row long, n_dropped long, keep binary"), "bitmaps")
    scratch.drop("lines", "judged")
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines dropped from the text, and n_lines, n_dropped added (under names that docs has not). Lines after the end of a bitmap stay."""
    row, keep, n_lines, n_dropped, own_id, own_row = free_name(docs, "_row", "_keep", "n_lines", "n_dropped", "_id", "_of")
    left = docs.withColumn(row, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    right = bitmaps.select(F.col("doc_id").alias(own_id), F.col("row").alias(own_row), F.col("n_dropped").alias(n_dropped), F.col("keep").alias(keep))
    both = left.join(right, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_row)), "left").drop(own_id, own_row)
    both = both.withColumn(n_lines, F.length(F.coalesce(F.col(text_col), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"), F.lit(""))) + F.lit(1).cast("long")).withColumn(n_dropped, F.coalesce(n_dropped, F.lit(0).cast("long")))
    place = both.columns.index(text_col)
    names = [*docs.columns, n_lines, n_dropped]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, bits in zip(batch.column(place).to_pylist(), batch.column(keep).to_pylist(), strict=True):
            if bits is not None:
                flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little")
                lines = text.split("\n")
                text = "\n".join(x for p, x in enumerate(lines) if p >= len(flags) or flags[p])
            texts.append(text)
        columns = [pa.array(texts, batch.column(place).type) if c == text_col else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(both, f, ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in names))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, o.largest IS NOT NULL AND o.largest <> l.doc_id AS gone FROM lines l LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
