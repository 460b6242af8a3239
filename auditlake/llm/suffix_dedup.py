"""Suffix-array dedup of repeated byte strings (SPAN bytes, by default 200), exact over the whole corpus.

1. Each window of SPAN bytes is dealt out to an anchor: its smallest 51-byte gram by hash. Equal windows have the same gram at the same place, so they meet under
   its hash; consecutive windows with one anchor are a segment (about 60 windows), so all windows are in segments, each once.
2. Segments are range-partitioned and sorted by (anchor hash, 128-bit hash of the bytes). A segment equal to a neighbour is repeated whole: its bytes go and need not
   be fetched. A segment with another one under its anchor may share some windows only: its bytes are fetched. Each decision needs the two neighbours only, so
   partitions stream, a very frequent anchor is cut like anything else, and what the first and the last row of a partition lack comes from a join of these rows.
3. The fetched segments are dealt out by anchor into shards. A shard's text goes to a file as it comes, and its suffix array is made by induced sorting over disk-backed queues that carry
   common prefixes (suffix_sort.py): neighbours in it that share SPAN symbols are repeated. What a task keeps in memory is the queues' share, a few blocks, and ids and sizes of the
   pieces (about a tenth of the text). An anchor with more than MAX_BYTES of different segments would still be one task's work: its windows are dealt out again to finer anchors, by
   the place of the gram in the window (in 2, then 10, then REACH parts) and the bytes that all windows with it there share, and go through 2 and 3 like the first ones. The finest anchor is
   a window itself, so whatever a text holds, no anchor stays large.
4. The intervals of a document are applied to its text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, map_batches, mix, sent_if_small, table, utf8
from auditlake.llm.suffix_sort import suffixes
from auditlake.session import ship

SPAN = 200
GRAM = 51
REACH = SPAN - GRAM + 1  # grams of a window
STEP = 1 << 20
#: Bytes of different segments under one anchor that one task sorts; an anchor with more is split into finer ones.
MAX_BYTES = 64 << 20
#: Parts of the places of a gram in its window, for finer anchors; with REACH of them a part is one place, and its anchor the whole window.
FINER = (2, 10, REACH)
#: Bytes of text a shard gathers before it is sorted.
SHARD = 4 << 20
SEGMENT = "a long, d1 long, d2 long, doc_id long, row long, lo int, hi int"
FOUND = "doc_id long, row long, lo int, hi int"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))))


_UP, _DOWN = None, None


def segments(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Deals the windows (SPAN bytes inside one text) out to anchors: text, first window, last window, anchor, and hash of each anchor."""
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers(_BASE, STEP + 2 * SPAN), _powers(_INVERSE, STEP + 2 * SPAN)
    parts = []
    for a in range(0, max(0, len(raw) - SPAN + 1), STEP):
        seg = raw[a : a + STEP + SPAN - 1]
        n = len(seg)
        total = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[seg] * _UP[:n])))
        m = n - GRAM + 1
        h = mix((total[GRAM:] - total[:m]) * _DOWN[:m])
        key = (h & np.uint64(~0x1FFFFF & (2**64 - 1))) | np.arange(m, dtype=np.uint64)
        full = -(-m // REACH) * REACH
        padded = np.full(full, 2**64 - 1, np.uint64)
        padded[:m] = key
        rows = padded.reshape(-1, REACH)
        ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        windows = n - SPAN + 1
        best = (np.minimum(back[:windows], ahead[REACH - 1 : REACH - 1 + windows]) & np.uint64(0x1FFFFF)).astype(np.int64)
        start = np.arange(windows)
        text = np.searchsorted(at, start + a, "right") - 1
        ok = start + a + SPAN <= at[text + 1]
        start, text, best = start[ok], text[ok], best[ok]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1]))))
        last = np.append(new[1:], len(start)) - 1
        parts.append((text[new], start[new] + a - at[text[new]], start[last] + a - at[text[new]], best[new] + a - at[text[new]], h[best[new]]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def digests(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    whole = raw.tobytes()
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def all_segments(text: DataFrame) -> DataFrame:
    """text(doc_id, row, text) -> SEGMENT; [lo, hi) in bytes of the text."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8(batch.column(2))
        which, first, last, _, h = segments(raw, at)
        d = digests(raw, at[which] + first, at[which] + last + SPAN)
        ids = batch.select([0, 1]).take(pa.array(which))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), *ids.columns, pa.array(first.astype(np.int32)), pa.array((last + SPAN).astype(np.int32))], ["a", "d1", "d2", "doc_id", "row", "lo", "hi"])

    return map_batches(text, f, SEGMENT, size=STEP)


JUDGED = f"{SEGMENT}, whole boolean, part boolean, edge boolean"


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the sorted segments of a partition (SEGMENT) -> JUDGED: whole (equal to a neighbour), part (beside another one of its anchor); others go. The first and the last row come
    out anyhow, as edges: what they lack is their neighbour in another partition."""
    held: pa.RecordBatch | None = None
    before: list[int] | None = None

    def judge(batch: pa.RecordBatch, nxt: list[int] | None) -> pa.RecordBatch:
        nonlocal before
        k = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        none = np.zeros((1, 3), np.int64)
        up = np.concatenate((none if before is None else np.array([before]), k[:-1]))
        down = np.concatenate((k[1:], none if nxt is None else np.array([nxt])))
        whole, part, edge = (np.zeros(len(k), bool) for _ in range(3))
        for other, missing in ((up, 0 if before is None else None), (down, len(k) - 1 if nxt is None else None)):
            anchor = other[:, 0] == k[:, 0]
            if missing is not None:
                anchor[missing], edge[missing] = False, True
            same = anchor & (other[:, 1:] == k[:, 1:]).all(axis=1)
            whole |= same
            part |= anchor & ~same
        before = k[-1].tolist()
        go = pa.array(np.flatnonzero(whole | part | edge))
        out = batch.take(go)
        return pa.RecordBatch.from_arrays([*out.columns, *(pa.array(x).take(go) for x in (whole, part, edge))], [*batch.schema.names, "whole", "part", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield judge(held, [batch.column(c)[0].as_py() for c in range(3)])
        held = batch
    if held is not None:
        yield judge(held, None)


def with_edges(found: DataFrame) -> DataFrame:
    """JUDGED with the neighbours of the edges in other partitions: two rows a partition, so a table as short as the list of partitions, looked at by anchor."""
    key = ["a", "d1", "d2", "doc_id", "row", "lo"]
    order = Window.partitionBy("a").orderBy(*key[1:])  # neighbours of interest share the anchor
    near = lambda f: f(F.struct("d1", "d2")).over(order)
    edge = found.where("edge").select(*key, near(F.lag).alias("up"), near(F.lead).alias("down"))
    same = lambda x: F.coalesce((F.col(x)["d1"] == F.col("d1")) & (F.col(x)["d2"] == F.col("d2")), F.lit(False))
    other = lambda x: F.col(x).isNotNull() & ~same(x)
    names = {k: f"_{k}" for k in key}
    edge = edge.groupBy(*key).agg(F.bool_or(same("up") | same("down")).alias("_whole"), F.bool_or(other("up") | other("down")).alias("_part")).withColumnsRenamed(names)
    both = found.join(sent_if_small(edge), F.col("edge") & reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]), "left")
    both = both.withColumns({x: F.col(x) | F.coalesce(f"_{x}", F.lit(False)) for x in ("whole", "part")})
    return both.where(F.col("whole") | F.col("part")).drop("_whole", "_part", "edge", *names.values())


def fetched(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Bytes of the segments: (a, doc_id, row, lo, piece)."""
    wanted = parts.groupBy("doc_id", "row").agg(F.collect_set(F.struct("a", "lo", "hi")).alias("wanted")).withColumnsRenamed({"doc_id": "_id", "row": "_of"})
    both = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_of"))).select("doc_id", "row", "text", "wanted")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8(batch.column(2))
        wanted = batch.column(3)
        which = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
        flat = wanted.flatten()
        a, lo, hi = flat.flatten()
        whole = raw.tobytes()
        begin = at[which]
        pieces = [whole[x:y] for x, y in zip((begin + lo.to_numpy()).tolist(), (begin + hi.to_numpy()).tolist(), strict=True)]
        ids = batch.select([0, 1]).take(pa.array(which))
        return pa.RecordBatch.from_arrays([a, *ids.columns, lo, pa.array(pieces, pa.binary())], ["a", "doc_id", "row", "lo", "piece"])

    return map_batches(both, f, "a long, doc_id long, row long, lo int, piece binary")


class Shard:
    """Pieces of text on disk, one after another with an end mark (0) each; in memory are their sizes and ids only."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory()
        self.path = f"{self.folder.name}/text"
        self.file = open(self.path, "wb")  # noqa: SIM115
        self.rows: list[pa.RecordBatch] = []
        self.sizes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """batch: (a, doc_id, row, lo, piece)."""
        for k in range(0, batch.num_rows, 4096):
            own = batch.slice(k, 4096)
            raw, at = utf8(own.column(4))
            size = np.diff(at)
            t = np.zeros(len(raw) + len(size), np.uint16)
            t[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw.astype(np.uint16) + 1
            t.tofile(self.file)
            self.sizes.append(size)
            self.bytes += len(raw)
        self.rows.append(batch.select([1, 2, 3]))

    def repeated(self) -> Iterator[pa.RecordBatch]:
        """FOUND: the runs of windows that stand at another place too: suffixes that share SPAN symbols with a neighbour in the suffix array."""
        self.file.close()
        size = np.concatenate(self.sizes)
        n = int(size.sum()) + len(size)
        with self.folder:
            t = np.memmap(self.path, np.uint16, "r", shape=(n,))
            again = np.memmap(f"{self.folder.name}/again", bool, "w+", shape=(n,))
            before = None
            for p, shared in suffixes(t, SPAN, self.folder.name):
                hit = np.flatnonzero(shared >= SPAN)
                again[p[hit]] = True
                again[p[hit[hit > 0] - 1]] = True
                if len(hit) and hit[0] == 0:
                    again[before] = True
                before = p[-1]
            rows = pa.Table.from_batches(self.rows)
            begin = np.cumsum(size + 1) - size - 1
            for k in range(0, len(size), 4096):
                first, own = begin[k], size[k : k + 4096]
                part = np.asarray(again[first : first + own.sum() + len(own)])
                hit = np.flatnonzero(part)
                piece = np.searchsorted(begin[k : k + 4096] - first, hit, "right") - 1
                at = hit - (begin[k : k + 4096] - first)[piece]
                inside = at <= own[piece] - SPAN  # what shares an end mark, too, is no window
                piece, at = piece[inside], at[inside]
                if not len(at):
                    continue
                new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1]))))
                last = np.append(new[1:], len(at)) - 1
                out = rows.take(pa.array(piece[new] + k)).combine_chunks().to_batches()[0]
                lo = out.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array((lo + at[new]).astype(np.int32)), pa.array((lo + at[last] + SPAN).astype(np.int32))], ["doc_id", "row", "lo", "hi"])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, doc_id, row, lo, piece) sorted by a -> FOUND. An anchor is in one shard; a shard ends with the anchor that fills it."""
    shard: Shard | None = None
    last = None
    for batch in batches:
        a = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), batch.num_rows] if len(a) else []
        begin = 0
        for k, end in zip(cuts[:-1], cuts[1:], strict=True):
            if shard is not None and a[k] != last and shard.bytes + sum_bytes(batch, begin, k) >= SHARD:
                if k > begin:
                    shard.add(batch.slice(begin, k - begin))
                yield from shard.repeated()
                shard, begin = None, k
            shard = shard or Shard()
            last = a[k]
        if len(a) and begin < len(a):
            shard.add(batch.slice(begin))
    if shard is not None:
        yield from shard.repeated()


def sum_bytes(batch: pa.RecordBatch, begin: int, end: int) -> int:
    """Bytes of the pieces [begin, end)."""
    _, offsets, _ = batch.column(4).buffers()
    at = np.frombuffer(offsets, np.int32)[batch.column(4).offset :]
    return int(at[end]) - int(at[begin])


def finer(pieces: DataFrame, parts: int) -> DataFrame:
    """The windows of the pieces (a, doc_id, row, lo, piece) under finer anchors -> SEGMENT, each window once.

    A window's smallest gram begins `off` bytes into it. Windows of one part of the offsets share the bytes from the latest begin to the earliest end of such windows: these and the part are the new
    anchor. Equal windows have equal offsets, so they meet again."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, at = utf8(batch.column(4))
        which, first, last, gram, _ = segments(raw, at)
        if not len(which):
            return None
        own = last - first + 1
        seg = np.repeat(np.arange(len(own)), own)
        start = first[seg] + np.arange(own.sum()) - (np.cumsum(own) - own)[seg]
        part = (gram[seg] - start) * parts // REACH
        new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (part[1:] != part[:-1]))))
        end = start[np.append(new[1:], len(start)) - 1] + SPAN
        seg, start, part = seg[new], start[new], part[new]
        least, most = -(-part * REACH // parts), -(-(part + 1) * REACH // parts) - 1
        text, middle = at[which[seg]], gram[seg]
        core = digests(raw, text + middle - least, text + middle - most + SPAN)[:, 0] ^ part
        d = digests(raw, text + start, text + end)
        rows = batch.select([1, 2, 3]).take(pa.array(which[seg]))
        lo = rows.column(2).to_numpy()
        found = [pa.array((lo + start).astype(np.int32)), pa.array((lo + end).astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(core), pa.array(d[:, 0]), pa.array(d[:, 1]), rows.column(0), rows.column(1), *found], ["a", "d1", "d2", "doc_id", "row", "lo", "hi"])

    return map_batches(pieces, f, SEGMENT, size=1 << 18)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs -> doc_id, text (binary: the remaining bytes), n_bytes, spans (maximal removed runs, [start, end) in bytes), for each row.

    Null text is empty. A text shorter than SPAN keeps all. Rows that repeat a doc_id are separate texts, so a repeated row loses all that is in a window. The
    remaining bytes may cut a character in two, as strings are bytes here. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix-dedup")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text")
    order = ["a", "d1", "d2", "doc_id", "row", "lo"]  # down to the place, so that equal segments of one text are cut, too
    spans = []
    # written first: a range partitioner samples its input, which would else look at every byte twice
    every = scratch.keep(all_segments(text), "segments")
    for level, parts in enumerate((*FINER, None)):
        ordered = every.repartitionByRange(scratch.partitions("segments"), *order).sortWithinPartitions(*order)
        first = scratch.keep(ordered.mapInArrow(neighbours, JUDGED), "first")
        scratch.drop("segments")
        judged = scratch.keep(with_edges(first), f"judged{level}")
        scratch.drop("first")
        pieces = scratch.keep(fetched(text, judged.where("part")), "pieces")
        large = pieces.groupBy("a").agg(F.sum(F.length("piece")).alias("size")).where(F.col("size") > max_bytes).select("a")
        hot = sent_if_small(scratch.keep(large, "hot"))
        own = pieces.join(hot, "a", "left_anti") if parts else pieces
        sorted_ = own.repartition(scratch.partitions("pieces", SHARD), "a").sortWithinPartitions("a").mapInArrow(shards, FOUND)
        spans += [judged.where("whole").select("doc_id", "row", "lo", "hi"), scratch.keep(sorted_, f"some{level}")]
        again = parts is not None and not hot.isEmpty()
        if again:
            every = scratch.keep(finer(pieces.join(hot, "a", "left_semi"), parts), "segments")
        scratch.drop("pieces", "hot")
        if not again:
            break
    found = reduce(DataFrame.union, spans)
    found = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("found")).withColumnsRenamed({"doc_id": "_id", "row": "_of"})
    both = text.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_of")), "left").select("doc_id", "text", "found")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8(batch.column(1))
        kept, spans = [], []
        found = batch.column(2)
        at_found = found.offsets.to_numpy()
        lo, hi = (x.to_numpy() for x in found.values.flatten())
        for i in range(batch.num_rows):
            own = raw[at[i] : at[i + 1]]
            a, b = at_found[i], at_found[i + 1]
            if b > a:
                mark = np.zeros(len(own) + 1, np.int32)
                np.add.at(mark, lo[a:b], 1)
                np.add.at(mark, hi[a:b], -1)
                gone = np.cumsum(mark[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                own = own[~gone]
            else:
                spans.append([])
            kept.append(own.tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(np.diff(at)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "text", "n_bytes", "spans"])

    return map_batches(both, cut, "doc_id long, text binary, n_bytes long, spans array<struct<start:int,end:int>>")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
cut AS (SELECT doc_id, o, b[o + 1:o + 1223] AS piece FROM (SELECT doc_id, b, unnest(generate_series(0, greatest(n - 200, 0), 1024)) AS o FROM d)),
w AS (SELECT doc_id, o + i AS s, md5(piece[i + 1:i + 200]) AS h FROM (SELECT doc_id, o, piece, unnest(generate_series(0, least(octet_length(piece) - 200, 1023))) AS i FROM cut)),
often AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM w SEMI JOIN often USING (h)),
run AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS z, row_number() OVER (PARTITION BY doc_id ORDER BY min(s)) AS k FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM run) GROUP BY doc_id, g),
keep AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY k) UNION ALL SELECT doc_id, max(z), NULL FROM span GROUP BY doc_id),
kept AS (SELECT k.doc_id, string_agg(hex(b[k.a + 1:coalesce(k.z, n)]), '' ORDER BY k.a) AS h FROM keep k JOIN d USING (doc_id) WHERE coalesce(k.z, n) > k.a GROUP BY k.doc_id),
t AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
