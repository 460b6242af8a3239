"""Learned decision lists: rules for bad documents, grown and pruned by sequential covering, applied as one ordered Spark conditional expression.

A rule is a conjunction of thresholds on statistics of the text. It is grown on two thirds of the labelled rows that are left, by the FOIL gain of each condition,
until it covers no good row (or nothing gains), and pruned on the other third: conditions are cut from the end while (p - n) / (p + n) does not fall. A rule
that is not precise enough on the pruning rows ends the list. Rows that a rule covers are taken out before the next one is grown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import LINE_FEED, SPACE, Texts, Tokens, bounded_sample, first_of_equal, map_batches, mix, one_each, table, windows

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "capitals", "punctuation", "digits", "distinct_words", "words_per_line", "lone_marks", "exclamations", "longest_run"]
FEATURES = [*BASE, *RATIOS]
#: Labelled rows that a list is learned from, at most.
SAMPLE = 10_000
MIN_PRECISION = 0.8
MOST_RULES, MOST_CONDITIONS = 24, 4

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_PUNCT = np.isin(np.arange(256), list(b".,;:!?|#*$%&<>()[]{}\"'-_/\\@+=~^`"))


def keyed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of (hash, text)."""
    return mix(h + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def repeated(h: np.ndarray, text: np.ndarray, n: int = 3) -> np.ndarray:
    """Which words stand in an n-word window that its text has twice or more."""
    out = np.zeros(len(h) + 1, np.int64)
    if len(h) >= n:
        at = np.flatnonzero(text[: len(h) - n + 1] == text[n - 1 :])
        twice = at[first_of_equal(keyed(windows(h, n)[at], text[at]))[1]]
        out[twice] += 1
        out[twice + n] -= 1
    return np.cumsum(out[:-1]) > 0


def statistics(column: pa.Array, read: Texts | None = None) -> dict[str, np.ndarray]:
    """BASE (long) and RATIOS (double) of each text."""
    read = read or Texts(column)
    raw, at, docs, t = read.raw, read.at, read.docs, read.spaced
    lines = Tokens(raw, at, LINE_FEED)
    n = np.diff(t.first)
    chars = read.count(~SPACE & ((np.arange(256) & 0xC0) != 0x80))
    symbols = read.count(_SYMBOL)
    of_word, of_line = np.repeat(np.arange(docs), n), np.repeat(np.arange(docs), np.diff(lines.first))
    worded = np.searchsorted(t.start, lines.end) > np.searchsorted(t.start, lines.start)
    dup = first_of_equal(keyed(lines.hash, of_line))[0] & worded
    dup_lines = np.bincount(of_line[dup], minlength=docs)
    repeat = np.bincount(of_word[repeated(t.hash, of_word)], minlength=docs)
    per = lambda a, b: a / np.maximum(b, 1)
    word_lines = np.bincount(of_line[worded], minlength=docs)
    lone = _PUNCT[raw[t.start]] & (t.end - t.start == 1) if len(t.start) else np.zeros(0, bool)
    upper = read.count(_UPPER)
    change = np.flatnonzero(np.concatenate(([True], (t.hash[1:] != t.hash[:-1]) | (of_word[1:] != of_word[:-1])))) if len(t.hash) else np.zeros(0, np.int64)
    run = np.diff(np.append(change, len(t.hash)))
    longest = (n > 0).astype(np.int64)
    many = np.flatnonzero(run > 1)
    np.maximum.at(longest, of_word[change[many]], run[many])
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "mean_word": per(chars, n), "symbols_per_word": per(symbols, n), "dup_line_share": per(dup_lines, word_lines), "repeat_share": per(repeat, n), "capitals": per(upper, upper + read.count(_LOWER)),
        "punctuation": per(read.count(_PUNCT), chars), "digits": per(read.count(_DIGIT), chars), "distinct_words": per(np.bincount(of_word[~first_of_equal(keyed(t.hash, of_word))[0]], minlength=docs), n), "words_per_line": per(n, word_lines),
        "lone_marks": per(np.bincount(of_word[lone], minlength=docs), n), "exclamations": per(read.count(np.arange(256) == 33), n), "longest_run": per(longest, n),
    }


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES for each row. Null or empty text: zeros."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[c].astype(np.int64 if c in BASE else np.float64)) for c in FEATURES)], ["doc_id", *FEATURES])

    kinds = ", ".join(f"{c} {'long' if c in BASE else 'double'}" for c in FEATURES)
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), f, f"doc_id long, {kinds}", size=1 << 20)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] < self.value

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.value) if self.above else F.col(self.feature) < F.lit(self.value)


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for c in rule:
        rows = rows[c.holds({c.feature: x[c.feature][rows]})]
    return rows


def grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        y = bad[rows]
        p, n = int(y.sum()), int((~y).sum())
        if not p or not n:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for f in FEATURES:
            order = np.argsort(x[f][rows], kind="stable")
            v, up = x[f][rows][order], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] != v[:-1]) + 1
            if not len(cut):
                continue
            below_p, below = up[cut - 1], cut
            for above, pos, all_ in ((False, below_p, below), (True, p - below_p, len(rows) - below)):
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / all_) - now), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], Condition(f, above, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = covered(rule[-1:], x, rows)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[Rule, int, int]:
    """The rule with its last conditions cut off where that does no harm, and the bad and good rows it covers."""
    best = None
    for size in range(1, len(rule) + 1):
        got = covered(rule[:size], x, rows)
        p, n = int(bad[got].sum()), int((~bad[got]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth > best[0]:
            best = (worth, rule[:size], p, n)
    return best[1:] if best else ((), 0, 0)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = MIN_PRECISION, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that cover bad rows; empty without rows of both kinds."""
    rows, rules = np.arange(len(bad)), []
    rng = np.random.default_rng(seed)
    while len(rules) < MOST_RULES and bad[rows].any() and not bad[rows].all():
        mixed = rng.permutation(rows)
        # a third of either kind prunes
        third = np.concatenate([own[: len(own) // 3] for own in (mixed[bad[mixed]], mixed[~bad[mixed]])])
        rule = grow(x, bad, np.setdiff1d(rows, third))
        if not rule:
            break
        rule, p, n = prune(rule, x, bad, third)
        got = covered(rule, x, rows)
        if p < 2 or p < min_precision * (p + n) or bad[got].mean() < min_precision:
            break
        rules.append(rule)
        rows = np.setdiff1d(rows, got)
    return rules


def as_column(rules: list[Rule], none: object = None) -> Column:
    """The list as CASE WHEN: the number of the first rule that holds (from 0), else `none`."""
    out = None
    for k, rule in enumerate(rules):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(k)) if out is None else out.when(both, F.lit(k))
    return F.lit(none).cast("int") if out is None else out.otherwise(F.lit(none).cast("int"))


def learned_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules for label 0, from at most `sample` rows with a label and an id (the first by a hash of the id); repeated and conflicting labels all count. Of texts that repeat an id one is seen."""
    some = bounded_sample(labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).dropna().distinct(), sample, "label_id", "label")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(some, F.col("doc_id") == F.col("label_id"))
    own = text_statistics(one_each(chosen.select("doc_id", "text"), "doc_id")).join(some, F.col("doc_id") == F.col("label_id")).drop("label_id").toPandas().sort_values(["doc_id", "label", "word_chars"], kind="stable")
    return learn({c: own[c].to_numpy() for c in FEATURES}, (own["label"] == 0).to_numpy()) if len(own) else []


def judged(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """doc_id, FEATURES, base_failed, rule (the rule that takes it out, else null), kept, for each row of docs.

    base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words; such rows are not kept whatever the rules say. Null or empty text has no words. Without
    labelled rows of both kinds there are no rules. Columns other than the id and the text are ignored.
    """
    rules = learned_rules(docs, labels, **names)
    x = text_statistics(docs, names.get("id_col", "doc_id"), names.get("text_col", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.withColumn("base_failed", failed).withColumn("rule", as_column(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op3_learned_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
