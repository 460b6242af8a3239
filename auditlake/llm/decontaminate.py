"""Benchmark decontamination by winnowing.

A window is 10 consecutive words of a benchmark item (an item of fewer words, but not none, is one window). Fingerprints are the 5-word hashes that are
smallest in some run of 6 consecutive ones, chosen alike in documents and items: two texts that share 10 words share such a run, so they share a fingerprint.
A shared fingerprint is extended: every 10-word stretch of the document around it is looked up among the windows, and its words are compared one by one
(64 bits each). Words inside found windows are hit. Items shorter than a window have their own length looked up everywhere, so they need no winnowing.

A benchmark of up to BROADCAST_WORDS words (counted first) goes to every task: windows, fingerprints and word hashes of so many words; documents then stream past it and are never shuffled.
A larger one stays on the executors. Its fingerprints and windows set bits in two filters of a fixed size (FILTER_BITS), whatever their number; documents stream past the filters, and
the windows around fingerprints that pass are joined with the benchmark's by their 128-bit hash. The join is by window, a window being a row once on the benchmark's side, so a very
frequent one is split like any skewed join; what a document gets from it is its spans and its items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import LOWER, NOT_ALNUM, Scratch, Tokens, map_batches, mix, table, utf8, windows

SPAN = 10
GRAM, RUN = 5, 6  # GRAM + RUN - 1 = SPAN: every shared span of SPAN words is seen
BROADCAST_WORDS = 1_000_000
FILTER_BITS = 26
#: Words of a part of a long item.
PART = 100_000
_OTHER = np.uint64(0xA0761D6478BD642F)


def winnowed(grams: np.ndarray, run: int = RUN) -> np.ndarray:
    """Places of the hashes that are smallest in some run of so many (all of equal ones)."""
    if len(grams) < run:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(grams, run).min(axis=1)
    padded = np.concatenate((np.zeros(run - 1, np.uint64), least, np.zeros(run - 1, np.uint64)))
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(padded, run).max(axis=1) == grams)


class Windows:
    """Windows of one length: hash -> where one of them begins, and the items that have it."""

    def __init__(self, word: np.ndarray, begin: np.ndarray, item: np.ndarray, span: int):
        rows = word[begin[:, None] + np.arange(span)]
        key = row_hash(rows)
        order = np.lexsort((item, key))
        self.span, self.word, item = span, word, item[order]
        self.hash, first = np.unique(key[order], return_index=True)
        self.begin, self.first, self.item = begin[order][first], np.append(first, len(order)), item

    def find(self, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places at, those where a window stands, and which."""
        rows = word[at[:, None] + np.arange(self.span)]
        key = row_hash(rows)
        k = np.minimum(np.searchsorted(self.hash, key), len(self.hash) - 1)
        same = np.flatnonzero(self.hash[k] == key)
        whole = (rows[same] == self.word[self.begin[k[same]][:, None] + np.arange(self.span)]).all(axis=1)
        return at[same[whole]], k[same[whole]]

    def items(self, k: int) -> np.ndarray:
        return self.item[self.first[k] : self.first[k + 1]]


def row_hash(rows: np.ndarray) -> np.ndarray:
    """windows() of each row of so many words."""
    out = rows[:, 0]
    for j in range(1, rows.shape[1]):
        out = mix(out) + rows[:, j]
    return mix(out + np.uint64(rows.shape[1]))


class Block:
    """What is looked up of some items: (id or None, word hashes)."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        word = np.concatenate([w for _, w in items])
        size = np.array([len(w) for _, w in items])
        first = np.cumsum(size) - size
        self.by_span: dict[int, Windows] = {}
        for span in sorted(set(np.minimum(size, SPAN).tolist())):
            own = np.flatnonzero(size == span) if span < SPAN else np.flatnonzero(size >= SPAN)
            begin = np.concatenate([np.arange(first[i], first[i] + size[i] - span + 1) for i in own])
            self.by_span[span] = Windows(word, begin, np.repeat(own, size[own] - span + 1), span)
        prints = [g[winnowed(g)] for g in (windows(w, GRAM) for _, w in items if len(w) >= SPAN)]
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)

    def hits(self, t: Tokens) -> list[tuple[int, np.ndarray, set[int]]]:
        """(text, its hit words as flags, its items) for the texts of a batch that have any."""
        n, word = len(t.hash), t.hash
        last = np.repeat(t.first[1:], np.diff(t.first))  # where the text of each word ends
        marks, found = np.zeros(n + 1, np.int64), []
        for span, known in self.by_span.items():
            if n < span:
                continue
            if span < SPAN:
                at = np.arange(n - span + 1)
                key = windows(word, span)
                at = at[known.hash[np.minimum(np.searchsorted(known.hash, key), len(known.hash) - 1)] == key]
            else:
                grams = windows(word, GRAM)
                own = winnowed(grams)
                own = own[self.prints[np.minimum(np.searchsorted(self.prints, grams[own]), len(self.prints) - 1)] == grams[own]]
                at = np.unique((own[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
            at = at[(at >= 0) & (at + span <= n)]
            at = at[at + span <= last[at]]
            at, k = known.find(word, at)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + span, -1)
            found.append((np.searchsorted(t.first, at, "right") - 1, k, known))
        hit = np.cumsum(marks[:n]) > 0
        items: dict[int, set[int]] = {}
        for text, k, known in found:
            for i, x in np.unique(np.stack((text, k), axis=1), axis=0) if len(text) else ():
                items.setdefault(int(i), set()).update(known.items(x).tolist())
        return [(i, hit[t.first[i] : t.first[i + 1]], {self.ids[x] for x in own} - {None}) for i, own in sorted(items.items())]


def item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item long, n long, word array<long>): items with words; a long item in parts that overlap by SPAN - 1 words, which have the same windows."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8(batch.column(1))
        t = Tokens(LOWER[raw], at, NOT_ALNUM)
        which, parts = [], []
        for i in range(batch.num_rows):
            word = t.of(i)
            for a in range(0, max(1, len(word) - SPAN + 1), PART):
                if len(word):
                    which.append(i)
                    parts.append(word[a : a + PART + SPAN - 1].view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(list(map(len, parts)), pa.int64()), pa.array(parts, pa.list_(pa.int64()))], ["item", "n", "word"])

    return map_batches(benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL"), f, "item long, n long, word array<long>")


def twice(word: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """(places, 2): two independent hashes of the windows that begin there."""
    rows = word[at[:, None] + np.arange(span)]
    return np.stack((row_hash(rows), row_hash(mix(rows ^ _OTHER))), axis=1)


def bits_of(h: np.ndarray) -> np.ndarray:
    """Two bits of the filter for each hash."""
    return np.concatenate((h >> np.uint64(64 - FILTER_BITS), mix(h) >> np.uint64(64 - FILTER_BITS)))


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    two = bits_of(h).astype(np.int64)
    ok = (bits[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok[: len(h)] & ok[len(h) :]


def lookup(words: DataFrame) -> tuple[DataFrame, list[int], np.ndarray, np.ndarray]:
    """item_words() -> windows (w1, w2, span, item), the spans there are, and the filters of fingerprints and of windows. What the driver gets is bounded by the filters' size."""

    def all_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, keys, spans = [], [], []
        for i in range(batch.num_rows):
            word = batch.column(2)[i].values.to_numpy().view(np.uint64)
            span = min(SPAN, len(word))
            keys.append(twice(word, np.arange(len(word) - span + 1), span))
            which.append(np.full(len(keys[-1]), i))
            spans.append(np.full(len(keys[-1]), span, np.int32))
        w, k = np.concatenate(which), np.concatenate(keys).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(np.concatenate(spans)), batch.column(0).take(pa.array(w))], ["w1", "w2", "span", "item"])

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, cells, masks = [], [], []
        for i in range(batch.num_rows):
            word = batch.column(2)[i].values.to_numpy().view(np.uint64)
            span = min(SPAN, len(word))
            grams = windows(word, GRAM)
            for kind, h in ((0, grams[winnowed(grams)] if span == SPAN else grams[:0]), (1, twice(word, np.arange(len(word) - span + 1), span)[:, 0])):
                b = bits_of(h).astype(np.int64)
                kinds.append(np.full(len(b), kind, np.int32))
                cells.append(b >> 6)
                masks.append((np.uint64(1) << (b & 63).astype(np.uint64)).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, cells, masks)], ["kind", "cell", "mask"])

    every = map_batches(words, all_windows, "w1 long, w2 long, span int, item long", 256).distinct()
    cells = map_batches(words, marked, "kind int, cell long, mask long", 256).groupBy("kind", "cell").agg(F.bit_or("mask").alias("mask")).toPandas()
    bits = np.zeros((2, 1 << (FILTER_BITS - 6)), np.uint64)
    bits[cells["kind"], cells["cell"]] = cells["mask"].to_numpy(np.int64).view(np.uint64)
    spans = sorted(r[0] for r in words.select(F.least("n", F.lit(SPAN))).distinct().collect())
    return every, spans, bits[0], bits[1]


def flags_to_spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


HITS = "spans array<struct<start:int,end:int>>, items array<long>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, row (xxhash64 of the text, empty for null), n_words, spans (runs of hit words, [start, end) by number of word), items (sorted ids of the items with windows in it).

    Null or empty text has no words and no hits. An item without words is nothing; a null item id marks words but is in no list; a repeated one counts once.
    Rows that repeat a doc_id stay rows of their own. An empty benchmark hits nothing. Columns with other names are ignored, as are clashing ones.
    """
    spark = docs.sparkSession
    words = item_words(benchmark, item_col, item_text_col)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    if (words.agg(F.sum("n")).first()[0] or 0) > broadcast_words:
        return by_join(text, words)
    items = [(r["item"], np.array(r.word, np.int64).view(np.uint64)) for r in words.select("item", "word").collect()]
    block = spark.sparkContext.broadcast(Block(items) if items else None)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8(batch.column(1))
        t = Tokens(LOWER[raw], at, NOT_ALNUM)
        found = {i: (flags_to_spans(hit), sorted(own)) for i, hit, own in block.value.hits(t)} if block.value is not None else {}
        rows = range(batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(t.first)), pa.array([found.get(i, ([], []))[0] for i in rows], SPANS), pa.array([found.get(i, ([], []))[1] for i in rows], pa.list_(pa.int64()))], ["doc_id", "row", "n_words", "spans", "items"])

    return map_batches(text, scan, f"doc_id long, row long, n_words long, {HITS}")


def by_join(text: DataFrame, words: DataFrame) -> DataFrame:
    """contamination() for a benchmark of any size. text(doc_id, text, row); words as item_words()."""
    spark = text.sparkSession
    scratch = Scratch(spark, "decontamination")
    words = scratch.keep(words, "words")
    known, spans, *filters = lookup(words)
    sent = spark.sparkContext.broadcast((spans, *filters))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, prints, wins = sent.value
        raw, at_text = utf8(batch.column(1))
        t = Tokens(LOWER[raw], at_text, NOT_ALNUM)
        n, word, last = len(t.hash), t.hash, np.repeat(t.first[1:], np.diff(t.first))
        found = []
        for span in spans:
            if span < SPAN:
                at = np.arange(max(0, n - span + 1))
            else:
                grams = windows(word, GRAM)
                own = winnowed(grams)
                own = own[passes(prints, grams[own])]
                at = np.unique((own[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
            at = at[(at >= 0) & (at + span <= n)]
            at = at[at + span <= last[at]]
            for k in range(0, len(at), 1 << 16):
                part = at[k : k + (1 << 16)]
                key = twice(word, part, span)
                ok = passes(wins, key[:, 0])
                found.append((part[ok], np.full(ok.sum(), span), key[ok].view(np.int64)))
        where, size, key = (np.concatenate([x[i] for x in found]) if found else np.zeros((0, 2)[: 1 + (i == 2)], np.int64) for i in range(3))
        doc = np.searchsorted(t.first, where, "right") - 1
        order = np.argsort(doc, kind="stable")
        doc, where, size, key = doc[order], where[order], size[order], key.reshape(-1, 2)[order]
        hits = pa.StructArray.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(size.astype(np.int32)), pa.array((where - t.first[doc]).astype(np.int32))], ["w1", "w2", "span", "at"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()), hits)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(t.first)), lists], ["doc_id", "row", "n_words", "hits"])

    every = scratch.keep(map_batches(text, scan, "doc_id long, row long, n_words long, hits array<struct<w1:long,w2:long,span:int,at:int>>"), "scanned")
    hits = every.select("doc_id", "row", F.explode("hits").alias("h")).select("doc_id", "row", "h.*")
    key = ["w1", "w2", "span"]
    marks = hits.join(known.select(key).distinct(), key, "left_semi").groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "span")).alias("marks"))
    items = hits.select("doc_id", "row", *key).distinct().join(known.where("item IS NOT NULL"), key).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item")).alias("found"))
    out = every.select("doc_id", "row", "n_words")
    for more in (marks, items):
        more = more.withColumnsRenamed({"doc_id": "_id", "row": "_of"})
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_of")), "left").drop("_id", "_of")

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for n, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            flag = np.zeros(n + 1, np.int64)
            for m in marks or []:
                flag[m["at"]] += 1
                flag[m["at"] + m["span"]] -= 1
            spans.append(flags_to_spans(np.cumsum(flag[:n]) > 0))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, SPANS), batch.column(4)], ["doc_id", "row", "n_words", "spans", "items"])

    out = out.select("doc_id", "row", "n_words", "marks", F.coalesce("found", F.array().cast("array<long>")).alias("found"))
    return map_batches(out, joined, f"doc_id long, row long, n_words long, {HITS}")


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS n, array_to_string(w[i:i + least(len(w), {SPAN}) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {SPAN} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
