"""Toxicity: gradient-boosted trees over dense features (lexicon densities, nearness to a second person, capitals, punctuation, obfuscation), with isotonic
calibration.

The lexicon is learned: words, and beginnings of words of 6 bytes, that stand in far more toxic than other labelled documents. It is learned on one half
of the labelled sample and the trees on the other half, so that the densities the trees see are those of unseen text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.boosting import Boosted, boost
from auditlake.llm.common import LOWER, NOT_ALNUM, SPACE, Texts, Tokens, bounded_sample, fold_of, map_batches, mix, one_each, table, utf8

#: Labelled rows of either label that a model is learned from, at most.
SAMPLE = 6_000
#: Entries of the lexicon, and the least number of toxic documents for one.
ENTRIES, LEAST = 5_000, 3
PREFIX = 6
# fixed values: pronouns and forms of address of the second person in English, German, French, Spanish
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen deiner euch euer eure ihr sie tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros os".split()
# fixed values: characters written for a letter
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
NEAR = 5

_PLAIN = LOWER.copy()
for _a, _b in WRITTEN_FOR.items():
    _PLAIN[ord(_a)] = ord(_b)
_JOINER = np.array([b < 0x80 and not SPACE[b] and NOT_ALNUM[LOWER[b]] and chr(b) not in WRITTEN_FOR for b in range(256)])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_ASCII_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_DIGIT_OR_SIGN = np.isin(np.arange(256), [ord(c) for c in WRITTEN_FOR])
_PUNCT = np.array([0x20 < b < 0x7F and NOT_ALNUM[LOWER[b]] for b in range(256)])
_SIGN = _DIGIT_OR_SIGN | _JOINER

FEATURES = ["words", "lexicon", "strong", "lexicon_kinds", "lexicon_most", "prefix", "prefix_strong", "prefix_kinds", "near_you", "you", "hidden", "obfuscated", "capitals", "capital_words", "punctuation", "exclamations", "questions", "longest_run"]


def hashes_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return Tokens(raw, np.array([0, len(raw)]), SPACE).hash


_YOU = np.sort(hashes_of(SECOND_PERSON))


def isin(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values if len(of) else np.zeros(len(values), bool)


_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(PREFIX + 1)], np.uint64)


def beginnings(raw: np.ndarray, t: Tokens) -> np.ndarray:
    """A number for the first PREFIX bytes of each word; of all its bytes if it has fewer."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw),), "<u8", padded, strides=(1,))
    out = eight[t.start] & _FIRST[np.minimum(t.end - t.start, PREFIX)]
    return mix(out ^ np.uint64(0x5F3759DF))


@dataclass
class Lexicon:
    entry: np.ndarray  # sorted hashes
    weight: np.ndarray  # log odds of each

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.entry):
            return np.zeros(len(h))
        k = np.minimum(np.searchsorted(self.entry, h), len(self.entry) - 1)
        return np.where(self.entry[k] == h, self.weight[k], 0.0)


def by_word(marked: np.ndarray, raw: np.ndarray, t: Tokens) -> np.ndarray:
    """How many marked bytes each word has; what is between words must not be marked."""
    return np.add.reduceat(marked[raw].view(np.uint8), t.start, dtype=np.int32) if len(t.start) else np.zeros(0, np.int32)


def features(column: pa.Array, lexicon: Lexicon, read: Texts | None = None) -> np.ndarray:
    """(texts, FEATURES)"""
    read = read or Texts(column)
    raw, at, docs = read.raw, read.at, read.docs
    lower = LOWER[raw]
    t = Tokens(lower, at, NOT_ALNUM)
    n = np.diff(t.first)
    of = np.repeat(np.arange(docs), n)
    begin = beginnings(lower, t) if len(raw) else t.hash
    w, p = np.maximum(lexicon.of(t.hash), 0), np.maximum(lexicon.of(begin), 0)
    toxic, toxic_p = np.flatnonzero(w), np.flatnonzero(p)
    per = lambda x: x / np.maximum(n, 1)
    total = lambda k, x=None: np.bincount(of[k], weights=x, minlength=docs)

    def kinds(k: np.ndarray, h: np.ndarray) -> np.ndarray:
        pairs = np.unique(np.stack((of[k].astype(np.uint64), h[k]), axis=1), axis=0) if len(k) else np.zeros((0, 2), np.uint64)
        return np.bincount(pairs[:, 0].astype(np.int64), minlength=docs)

    most = np.zeros(docs)
    np.maximum.at(most, of[toxic], w[toxic])
    about = np.flatnonzero(isin(t.hash, _YOU))
    near = np.zeros(docs)
    if len(toxic) and len(about):
        k = np.searchsorted(about, toxic)
        for side in (np.maximum(k - 1, 0), np.minimum(k, len(about) - 1)):
            close = (np.abs(about[side] - toxic) <= NEAR) & (of[about[side]] == of[toxic])
            near += total(toxic[close])

    # words written with other signs: signs for letters put back, all else inside a word taken out
    s = read.spaced
    of_spaced = np.repeat(np.arange(docs), np.diff(s.first))
    signs = by_word(_SIGN, raw, s)
    has = np.flatnonzero(signs)
    first, last = s.start[has], s.end[has] - 1
    letters = np.add.reduceat((_ASCII_LETTER | (np.arange(256) >= 0x80))[raw].view(np.uint8), np.minimum(s.start, max(0, len(raw) - 1)), dtype=np.int32)[has] if len(has) else signs[has]
    ends = _ASCII_LETTER[raw[last]] | (raw[last] >= 0x80)
    odd = has[(letters >= 2) & (signs[has] - _SIGN[raw[first]] - (_SIGN[raw[last]] & (last > first)) > 0) & ends]
    lettered = has[letters >= 2]
    hidden = np.zeros(docs)
    if len(lettered):
        size = s.end[lettered] - s.start[lettered] + 1
        begins = np.cumsum(size) - size
        where = np.repeat(s.start[lettered] - begins, size) + np.arange(size.sum())
        some = np.where(np.arange(size.sum()) == np.repeat(begins + size - 1, size), 0x20, raw[np.minimum(where, len(raw) - 1)]).astype(np.uint8)
        keep = ~_JOINER[some]
        plain = Tokens(_PLAIN[some[keep]], np.array([0, int(keep.sum())]), SPACE)
        word = np.searchsorted(begins, np.flatnonzero(keep)[plain.start], "right") - 1 if len(plain.start) else plain.start
        hidden += np.bincount(of_spaced[lettered[word]], weights=np.maximum(lexicon.of(plain.hash), 0), minlength=docs)
        inside = np.searchsorted(s.start, t.start[toxic], "right") - 1
        told = toxic[(signs[inside] > 0)] if len(toxic) else toxic
        hidden = np.maximum(hidden - total(told, w[told]), 0)

    upper, ascii_ = by_word(_UPPER, raw, t), by_word(_ASCII_LETTER, raw, t)
    shout = np.flatnonzero((upper == ascii_) & (ascii_ >= 2))
    size = np.maximum(np.diff(at), 1)
    share = lambda lut: read.count(lut) / size
    longest = (np.diff(at) > 0).astype(np.float64) * (read.count(_ASCII_LETTER) > 0)
    same = np.flatnonzero((raw[1:] == raw[:-1]) & _ASCII_LETTER[raw[1:]]) if len(raw) > 1 else np.zeros(0, np.int64)
    if len(same):  # runs of equal letters: consecutive places that equal the next one
        new = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1] + 1)))
        np.maximum.at(longest, np.searchsorted(at, same[new], "right") - 1, np.diff(np.append(new, len(same))) + 1.0)
    return np.stack([
        np.log1p(n), per(total(toxic, w[toxic])), per(total(np.flatnonzero(w > 3))), kinds(toxic, t.hash), most, per(total(toxic_p, p[toxic_p])), per(total(np.flatnonzero(p > 2))), kinds(toxic_p, begin), per(near), per(total(about)),
        per(hidden), per(np.bincount(of_spaced[odd], minlength=docs)), read.count(_UPPER) / np.maximum(read.count(_ASCII_LETTER), 1), per(total(shout)),
        share(_PUNCT), share(np.arange(256) == 33), share(np.arange(256) == 63), longest,
    ], axis=1).astype(np.float64)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted


def learned_lexicon(texts: DataFrame) -> Lexicon:
    """texts(doc_id, text, label): documents by entry are counted on the executors; ENTRIES of them reach the driver."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8(batch.column(1))
        raw = LOWER[raw]
        t = Tokens(raw, at, NOT_ALNUM)
        p = beginnings(raw, t)
        own = [np.unique(np.concatenate((t.of(i), p[t.first[i] : t.first[i + 1]]))) for i in range(batch.num_rows)]
        which = np.repeat(np.arange(len(own)), [len(x) for x in own])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else []), batch.column(2).take(pa.array(which))], ["entry", "label"])

    each = map_batches(texts.select("doc_id", "text", "label"), f, "entry long, label int")
    n = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    counts = each.groupBy("entry").agg(F.sum("label").alias("bad"), F.count("*").alias("all")).where(F.col("bad") >= LEAST)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (good + 1))
    # a cautious estimate: one standard error below
    odds = odds - F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("all") - F.col("bad") + 0.5))
    top = counts.withColumn("odds", odds).where("odds > 0.7").orderBy(F.col("odds").desc(), "entry").limit(ENTRIES).collect()
    entry, weight = np.array([r.entry for r in top], np.int64).view(np.uint64), np.array([r.odds for r in top], np.float64)
    order = np.argsort(entry)
    return Lexicon(entry[order], weight[order])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, folds: int = 5) -> Model | None:
    """From labelled rows whose fold is not 0: at most `sample` of each label, the first by a hash of the id, whole texts; weighted by how many of the label there
    are in all. Of texts that repeat an id one is seen. None without rows of both labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & (fold_of("label_id", folds) != 0)).distinct()
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    some = [bounded_sample(known.where(F.col("label") == c), sample, "label_id") for c in (0, 1)]
    some = F.broadcast(some[0].union(some[1]))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(some, F.col("doc_id") == F.col("label_id")).drop("label_id")
    own = one_each(own, "doc_id", "label")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    lexicon = learned_lexicon(own.where(half == 0))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(1), sent.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = map_batches(own.where(half == 1), f, "doc_id long, label int, x array<double>", size=1 << 20).toPandas()
    if not len(got) or got["label"].nunique() < 2:
        return None
    got["key"] = got["x"].map(tuple)
    got = got.sort_values(["doc_id", "label", "key"], kind="stable")
    y = got["label"].to_numpy()
    w = np.array([n[c] / max(1, (y == c).sum()) for c in (0, 1)])
    w = (w / w[1])[y]
    return Model(lexicon, boost(np.array(got["x"].tolist()), y, w))


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and FEATURES for each row of docs. Null text counts as empty; an empty text is scored like any other. Without a model every score is 0. Rows that repeat a
    doc_id, or have none, are rows of their own; equal texts score alike, and equal scores are one knot of the calibration. An empty table gives no rows; other columns are ignored.

    A text is looked at whole: a task holds its words and what is counted of them, about 30 bytes for each byte of the longest text (or of a batch of 1 MB of short ones)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        x = features(batch.column(1), m.lexicon if m else Lexicon(np.zeros(0, np.uint64), np.zeros(0)))
        score = m.trees.probability(x) if m else np.zeros(len(x))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *(pa.array(v) for v in x.T)], ["doc_id", "score", *FEATURES])

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(text, f, "doc_id long, score double, " + ", ".join(f"{c} double" for c in FEATURES), size=1 << 20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out and nothing is learned from it."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
