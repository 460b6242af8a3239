"""Spelling variants: words of a corpus that differ in one code point, by two-dimensional range reporting.

Two words differ in one code point at position p exactly if they share what is before p and what is after it. In a class of words sorted forwards, and sorted by their reversals, each of the two is an
interval, so the words near w at p are the points of a rectangle: forward rank in the one, reverse rank in the other. A wavelet matrix over the reverse ranks in forward order reports them. A class holds
the words of one length (replaced code points) and, as virtual entries that only ask, the words one shorter (inserted ones; deletions are these read backwards). Of a word only positions are asked at which
both intervals hold another word: p reaches as far as its longest common prefix with a neighbour, and what is after p as far as the longest common suffix.

Classes are made small enough for a task without losing a pair: a class answers positions lo to hi, so all its pairs share the first lo code points and the last l - 1 - hi, which is its key. A class of
more than CLASS entries is split in two at the middle of its positions, where keys are longer; a class of one position has as many entries as there are letters. What is dealt out is the dictionary; texts
are only read to count words, in pieces, and counts are added up before and after the shuffle.

Nulls: a null text has no words, a null id counts as no text before the colon. Rows that repeat an id are counted each. Ties: the smallest word in code-point order. Very long words and texts are whole. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, ship, table
from auditlake.llm.merkle import CRC32_SQL

#: Maximal runs of letters, where A-Z are lower-cased already. A shorter run cannot become a word.
LEAST_LETTERS, LEAST_COUNT, TIMES, DROPPED = 6, 5, 5, 199
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
#: Code points of a text that are looked at in one step.
PIECE = 1 << 20
#: Words counted in a task before they are handed on.
HELD = 1 << 18
#: Entries of a class beyond which it is split, and entries that a task looks at together.
CLASS, TOGETHER = 8192, 32_768


def runs_of(text: str) -> Iterator[list[str]]:
    """The runs of a text, lower-cased, in pieces of which none cuts a run."""
    low = text.encode("utf-8", "replace").lower().decode()
    if len(low) <= PIECE:
        yield RUN.findall(low)
        return
    at, n = 0, len(low)
    letter = re.compile("[^a-zÀ-ÿ]")
    while at < n:
        end = n
        if at + PIECE < n:
            gap = letter.search(low, at + PIECE)
            end = gap.start() if gap else n
        yield RUN.findall(low, at, end)
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (word, n): a run whose CRC with the id is divisible loses a code point."""
    total: Counter[str] = Counter()
    seen: dict[str, tuple[int, int]] = {}  # run -> CRC, bytes

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_py()
            if not raw:
                continue
            own: Counter[str] = Counter()
            for part in runs_of(raw):
                own.update(part)
            k = i.as_py()
            start = zlib.crc32(b"%s:" % ("" if k is None else str(k)).encode())
            shifts: dict[int, int] = {}  # CRC of the id, moved on by so many bytes
            for w, n in own.items():
                crc = seen.get(w)
                if crc is None:
                    b = w.encode()
                    crc = seen[w] = (zlib.crc32(b), len(b))
                shift = shifts.get(crc[1])
                if shift is None:
                    zeros = bytes(crc[1])
                    shift = shifts[crc[1]] = zlib.crc32(zeros, start) ^ zlib.crc32(zeros)
                h = shift ^ crc[0]
                if h % DROPPED:
                    total[w] += n
                else:
                    at = h % len(w)
                    total[w[:at] + w[at + 1 :]] += n
            if len(total) > HELD or sum(map(len, own)) > PIECE:
                yield flush()
            if len(seen) > HELD:
                seen.clear()
    yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    ship(docs.sparkSession)
    counted = docs.select(F.col("doc_id"), F.col("text").cast("string")).mapInArrow(_counted, "word string, n long")
    return counted.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class WaveletMatrix:
    """A sequence of numbers under 2^levels: bits of each level, and how many zeros are before each place."""

    __slots__ = ("levels", "zeros")

    def __init__(self, values: np.ndarray, top: int):
        self.levels, self.zeros = [], max(1, int(top - 1).bit_length())
        v = values
        for k in range(self.zeros - 1, -1, -1):
            bit = (v >> k) & 1
            before = np.concatenate(([0], np.cumsum(1 - bit)))
            self.levels.append(before)
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def report(self, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the values in [low, high) at places [start, end): (query, value), once for each such value."""
        q, v = np.arange(len(start)), np.zeros(len(start), np.int64)
        live = (start < end) & (low < high)
        q, v, a, b = q[live], v[live], start[live], end[live]
        for k, before in zip(range(self.zeros - 1, -1, -1), self.levels, strict=True):
            za, zb = before[a], before[b]
            n0 = before[-1]
            # zeros go to the left half, ones behind all zeros
            q = np.concatenate((q, q))
            a, b = np.concatenate((za, n0 + a - za)), np.concatenate((zb, n0 + b - zb))
            v = np.concatenate((v, v | (1 << k)))
            live = (a < b) & (v < high[q]) & (v + (1 << k) > low[q])
            q, v, a, b = q[live], v[live], a[live], b[live]
        return q, v


def _lcp(words: list[str], group: list[int]) -> np.ndarray:
    """Longest common prefix with the word before, -1 where the class changes; one more at the end."""
    out = np.full(len(words) + 1, -1, np.int64)
    for k in range(1, len(words)):
        if group[k] == group[k - 1]:
            out[k] = len(commonprefix((words[k - 1], words[k])))
    return out


class _Minima:
    """Sparse table of minima: how far a value of at least p reaches from a place."""

    def __init__(self, lcp: np.ndarray):
        self.table = [lcp]
        while 2 ** len(self.table) <= len(lcp):
            last, step = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def interval(self, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of the words that share the first p code points with the word at each place. Where p is 0 the class ends it, as its edges are -1."""
        start, end, n = at.copy(), at + 1, len(self.table[0])
        for k in range(len(self.table) - 1, -1, -1):
            step, minima = 2**k, self.table[k]
            back = start - step + 1
            ok = (back >= 0) & (minima[np.clip(back, 0, len(minima) - 1)] >= p)
            start = np.where(ok, start - step, start)
            ok = (end + step <= n) & (minima[np.clip(end, 0, len(minima) - 1)] >= p)
            end = np.where(ok, end + step, end)
        return start, end


def near_in_classes(entries: list[tuple[int, str, bool, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """entries: (class, word, real, l, lo, hi). (i, j): real entry j is near entry i, found from i at a position of the class."""
    n = len(entries)
    forward = sorted(range(n), key=lambda k: (entries[k][0], entries[k][1]))
    backward = sorted(range(n), key=lambda k: (entries[k][0], entries[k][1][::-1]))
    lcp = _lcp([entries[k][1] for k in forward], [entries[k][0] for k in forward])
    lcs = _lcp([entries[k][1][::-1] for k in backward], [entries[k][0] for k in backward])
    forward, backward = np.array(forward), np.array(backward)
    f_rank, b_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    f_rank[forward], b_rank[backward] = np.arange(n), np.arange(n)
    size, lo, hi = (np.array([e[k] for e in entries], np.int64) for k in (3, 4, 5))
    most = np.maximum(lcp[f_rank], lcp[f_rank + 1])
    behind = np.maximum(lcs[b_rank], lcs[b_rank + 1])
    first, last = np.maximum(lo, size - 1 - behind), np.minimum(hi, most)
    count = np.maximum(0, last - first + 1)
    i = np.repeat(np.arange(n), count)
    p = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]
    tree, ahead, back = WaveletMatrix(b_rank[forward], n), _Minima(lcp), _Minima(lcs)
    start, end = ahead.interval(f_rank[i], p)
    low, high = back.interval(b_rank[i], size[i] - 1 - p)
    q, v = tree.report(start, end, low, high)
    i, j = i[q], backward[v]
    real = np.array([e[2] for e in entries], bool)
    keep = real[j] & (i != j)
    return i[keep], j[keep]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams entries sorted by class, as many whole classes together as make TOGETHER entries."""
    held: list[tuple] = []
    counts: list[int] = []
    now, number = None, 0

    def settle() -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        i, j = near_in_classes(held)
        a, b = i.tolist(), j.tolist()
        pairs = {(x, y) for x, y in zip(a, b, strict=True)}
        rows = [(held[x][1], held[y][1], counts[y]) for x, y in pairs] + [(held[y][1], held[x][1], counts[x]) for x, y in pairs if not held[x][2]]
        if not rows:
            return None
        w, near, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        for size, lo, hi, key, word, real, n in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if now != (size, lo, hi, key):
                now, number = (size, lo, hi, key), number + 1
                if len(held) >= TOGETHER:
                    out = settle()
                    held, counts = [], []
                    if out is not None:
                        yield out
            held.append((number, word, real, size, lo, hi))
            counts.append(n)
    out = settle()
    if out is not None:
        yield out


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n): both directions of each pair that differs in one code point, once. words: (word, n)."""
    spark = words.sparkSession
    ship(spark)
    n = F.length("word")
    entries = words.select("word", "n", F.explode(F.array(F.struct(n.alias("l"), F.lit(True).alias("real")), F.struct((n + 1).alias("l"), F.lit(False).alias("real")))).alias("_e")).select("word", "n", "_e.*")
    entries = entries.select("*", F.lit(0).alias("lo"), (F.col("l") - 1).alias("hi"))

    def halved(df: DataFrame) -> DataFrame:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        two = df.withColumn("_r", F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("hi").alias("b"))))).select("word", "n", "l", "real", F.col("_r.a").alias("lo"), F.col("_r.b").alias("hi"))
        return two.withColumn("key", F.concat(F.expr("substring(word, 1, lo)"), F.lit("\n"), F.expr("right(word, l - 1 - hi)")))

    now, done, key = halved(entries), None, ["l", "lo", "hi", "key"]
    for r in range(64):
        now = scratch.keep(now, f"entries{r}")
        full = scratch.keep(now.where("lo < hi").groupBy(*key).count().where(F.col("count") > CLASS).drop("count"), f"full{r}")
        if full.isEmpty():
            done = now if done is None else done.unionByName(now)
            break
        calm = now.join(full, key, "left_anti").select(now.columns)
        done = calm if done is None else done.unionByName(calm)
        now = halved(now.join(full, key, "left_semi").drop("key"))
    n = max(spark.sparkContext.defaultParallelism, scratch.partitions("entries0", 8 << 20))
    dealt = done.select(*key, "word", "real", "n").repartition(n, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_near, "word string, near string, near_n long").distinct()


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.keep(vocabulary(docs), "words")
    pairs = near_words(words, scratch)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_b"))
    own = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("_b.m") >= TIMES * F.col("n"), F.struct(F.col("_b.near").alias("form"), (-F.col("_b.m")).alias("form_n"))).alias("_f"))
    own = scratch.keep(own.select("word", "n", "n_near", "_f.form", "_f.form_n"), "forms")
    # each step doubles how far a word has been followed; a form is TIMES as frequent, so no chain is longer than the digits of a count to that base
    links, k, most = own.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0, words.agg(F.max("n")).first()[0] or 1
    while TIMES ** (2**k) <= most:
        links = scratch.keep(links, f"roots{k}")
        links = links.alias("a").join(links.alias("b"), F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"))
        k += 1
    return own.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frequent word of documents with its number of near words, its form and the last form of its chain."""
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = f"""WITH RECURSIVE runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, c, {CRC32_SQL.format(s="(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM runs),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN (SELECT min(encode(p.near)) FROM pairs p WHERE p.word = w.word AND p.m = b.m) END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
named AS (SELECT word, n, n_near, decode(form) AS form, form_n FROM forms),
chain AS (SELECT word, word AS root FROM named UNION ALL SELECT c.word, f.form FROM chain c JOIN named f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN named f ON c.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)"""
