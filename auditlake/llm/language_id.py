"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams, trained by follow-the-regularised-leader with an elastic net, then calibrated
by temperature.

A feature is a hashed n-gram of 1 to 3 letters of the lower-cased text (anything that is no letter is a word's edge): its share of the text's n-grams times its
inverse document frequency, counted over all labelled rows that may be learned from. FTRL-proximal keeps a weight at zero until its summed gradient exceeds l1, with a rate of its own for each weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, fold_of, map_batches, one_each, table
from auditlake.session import ship

BITS = 16
ORDERS = 3
#: Labelled rows that a model is learned from: small languages whole, the others in equal parts, and LEAST of each at least.
SAMPLE = 4_000
LEAST = 50
UNKNOWN = "und"
SCALE = 20.0
#: Characters looked at in one step; temporaries take about 40 bytes for each.
PIECE = 1 << 20


def _letters() -> np.ndarray:
    """For code points below 2^16: whether it is a letter or belongs to one."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(1 << 16)])


_known: np.ndarray | None = None


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for what is no letter."""
    global _known
    if _known is None:
        _known = _letters()
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 1 << 16) | _known[np.minimum(c, 65535)], c, 0).astype(np.uint32)


def gram_pieces(text: str) -> Iterator[np.ndarray]:
    """Hashes (BITS wide) of all n-grams, with repeats, PIECE characters at a time: what stands across two pieces is carried over."""
    held = np.zeros(1, np.uint32)  # the last codes before the piece
    for a in range(0, max(1, len(text)), PIECE):
        c = np.concatenate((held, codes(text[a : a + PIECE]), np.zeros(int(a + PIECE >= len(text)), np.uint32)))
        c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]  # one edge between words
        parts = []
        for k in range(ORDERS):
            own = c[max(0, len(held) - k) :]  # n-grams that end in this piece
            if len(own) <= k:
                continue
            h = np.zeros(len(own) - k, np.uint32)
            for j in range(k + 1):
                h = h * np.uint32(0x01000193) + own[j : len(own) - k + j] * np.uint32(0x9E3779B1)
            parts.append((h if k else h[own != 0]) + np.uint32(k))
        held = c[-(ORDERS - 1) :]
        out = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        yield ((out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def grams(text: str) -> np.ndarray:
    return np.concatenate(list(gram_pieces(text)))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, how often each stands)"""
    n = np.zeros(0, np.int64)
    for g in gram_pieces(text):
        own = np.bincount(g, minlength=len(n))
        own[: len(n)] += n
        n = own
    at = np.flatnonzero(n)
    return at, n[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # (2^BITS, languages), times inverse document frequency
    bias: np.ndarray
    temperature: float = 1.0
    loss: list[float] = field(default_factory=list)

    def logits(self, text: str) -> np.ndarray:
        at, n = gram_counts(text)
        if not len(at):
            return self.bias
        return (n * (SCALE / n.sum())) @ self.weight[at] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 4, seed: int = 3) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights for rows of (indices, values); the last weight row is the bias."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))
    rng, losses = np.random.default_rng(seed), []

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        loss = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            loss -= np.log(max(p[y[i]], 1e-12))
            p[y[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
        losses.append(loss / max(1, len(rows)))
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1], w[-1], losses


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one that makes the held-out labels likeliest."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 10, 81):
        p = softmax(logits / t)[np.arange(len(y)), y]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    return best[1]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], df: np.ndarray, total: int) -> Model | None:
    """rows: (n-gram hashes, counts) of each text; df: in how many of `total` texts each n-gram stands. Every fifth row of a language calibrates."""
    if not rows:
        return None
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    idf = np.log((1 + total) / (1 + df)) + 0.1
    x = [(np.append(at, 1 << BITS), np.append(n * (SCALE / max(1, n.sum())) * idf[at], 1.0)) for at, n in rows]
    hold = np.zeros(len(rows), bool)
    for k in range(len(languages)):
        hold[np.flatnonzero(y == k)[4::5]] = True
    learn = np.flatnonzero(~hold)
    weight, bias, losses = ftrl([x[i] for i in learn], y[learn], len(languages))
    t = temperature(np.array([v[:-1] @ weight[at[:-1]] + bias for at, v in (x[i] for i in np.flatnonzero(hold))]), y[hold]) if hold.any() else 1.0
    return Model(languages, (weight * idf[:, None]).astype(np.float32), bias, t, losses)


def shares(held: dict[str, int], sample: int, least: int = LEAST) -> int:
    """How many rows a language may have so that all together have `sample`, `least` at least."""
    rest, left = sample, len(held)
    for n in sorted(held.values()):
        if n * left > rest:
            break
        rest, left = rest - n, left - 1
    return max(least, rest // left if left else sample)


def learnable(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> one pass over all texts: (doc_id, lang) of each row with a letter, and rows (at, n) whose sum by `at` is the document frequency."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)

        def out(n: int, *columns: pa.Array | None) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds, strict=True)], ["doc_id", "lang", "at", "n"])

        for batch in batches:
            keep = []
            for i, x in enumerate(batch.column(1)):
                text = x.as_py()
                if has_letter(text):
                    keep.append(i)
                    df[gram_counts(text)[0]] += 1
            own = batch.select([0, 2]).take(pa.array(keep, pa.int64()))
            yield out(len(keep), *own.columns, None, None)
        at = np.flatnonzero(df)
        yield out(len(at), None, None, pa.array(at.astype(np.int32)), pa.array(df[at]))

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, at int, n long")


def sampled(ids: DataFrame, sample: int) -> DataFrame:
    """ids(label_id, label) -> of each language the first rows by a hash of the id, as many as `shares` gives. Executors leave out most rows by the hash alone."""
    held = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    most = shares(held, sample)
    span = 1 << 30
    # a hash below `upto` has some more of a language than are wanted: six standard deviations and a few
    upto = {x: min(span, int(span * (most + 6 * most**0.5 + 20) / n) + 1) for x, n in held.items()}
    spark, order = ids.sparkSession, F.xxhash64("label_id")
    limit = F.broadcast(spark.createDataFrame(list(upto.items()), "of string, upto long"))
    rows = ids.withColumn("h", order).join(limit, F.col("label") == F.col("of")).where(F.pmod("h", F.lit(span)) < F.col("upto")).select("label_id", "label", "h").collect()
    taken: dict[str, int] = {}
    first = []
    for r in sorted(rows, key=lambda r: (r.h % span, r.label_id)):
        taken[r.label] = taken.get(r.label, 0) + 1
        if taken[r.label] <= most:
            first.append((r.label_id, r.label))
    return F.broadcast(spark.createDataFrame(first, "label_id long, label string"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, folds: int = 5) -> Model | None:
    """From rows with a language and a letter whose fold is not 0: about `sample` of them, whole texts; of each language the first by a hash of the id, all of a
    small language and equal parts of the others, LEAST at least (so more than `sample` in all if there are very many languages). Probabilities are those of
    languages in these parts. Document frequencies are of all such rows. Executors count the n-grams; the driver gets the frequencies and at most 2^BITS counts
    for each sampled row. None without such rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-id")
    usable = docs.where(F.col(lang_col).isNotNull() & (fold_of(id_col, folds) != 0)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null")
    seen = scratch.keep(learnable(usable), "seen")
    total = seen.where("at is null").count()
    if not total:
        scratch.drop()
        return None
    df = np.zeros(1 << BITS)
    for at, n in seen.where("at is not null").groupBy("at").agg(F.sum("n")).collect():
        df[at] = n
    some = sampled(seen.where("at is null").select(F.col("doc_id").alias("label_id"), F.col("lang").alias("label")).distinct(), sample)
    own = usable.join(some, (F.col("doc_id") == F.col("label_id")) & (F.col("lang") == F.col("label"))).select("doc_id", "text", "lang")
    own = one_each(own, "doc_id", "lang")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        keep = [i for i, x in enumerate(texts) if has_letter(x)]
        counted = [gram_counts(texts[i]) for i in keep]
        rows = batch.select([0, 2]).take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([a.astype(np.int32).tobytes() for a, _ in counted], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in counted], pa.binary())], ["doc_id", "lang", "at", "n"])

    got = map_batches(own, f, "doc_id long, lang string, at binary, n binary").toPandas().sort_values(["doc_id", "lang", "n"], kind="stable")
    scratch.drop()
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(n, np.int32)) for a, n in zip(got["at"], got["n"], strict=True)], got["lang"].tolist(), df, total)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language and its calibrated probability added (lang and score must be names that docs has not). Null, empty or letterless text, or no model: `und` and 0.

    Rows that repeat a doc_id, or have none, are rows of their own; equal texts get equal answers, and of equally likely languages the first by name. A very long text is read whole, PIECE characters at
    a time. An empty table gives no rows. Other columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        langs, scores = [], []
        for text in batch.column(place).to_pylist():
            if m is None or not has_letter(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = softmax(m.logits(text) / m.temperature)
            k = int(p.argmax())
            langs.append(m.languages[k])
            scores.append(float(p[k]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang, score])

    kinds = [f"`{c}` {t}" for c, t in docs.dtypes]
    return map_batches(docs, f, ", ".join([*kinds, f"`{lang}` string", f"`{score}` double"]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out and nothing is learned from it."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs))
    return out.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
