"""Soft-membership mixing: nonnegative rates of documents whose expected token totals by domain match target weights.

A document belongs to each domain with a probability: a softmax regression, learned from a labelled table, on dense statistics of the text. With n words and posteriors p of a
document, a rate r gives n * r * p[k] expected words of domain k. The rates minimise the least squares of (expected totals - targets), whitened by the second
moments M = sum n p p', over r >= 0, by projected gradient from r = 1: r <- max(0, r - p . M^-1 (totals - targets)), M taken over the documents that are not clipped. In this metric the step length is 1, a
step without a clipped rate is the solution, and of the many solutions it is the one nearest to r = 1.

A document's rate is a function of its posteriors and the steps so far (one short vector each). Each iteration is one pass over (words, posteriors, rate) that sums
on the executors and returns one row, whatever the number of partitions; every REPLAY steps the rates so far are written, so that a pass replays a bounded number of steps.
Sums are of decimals, so they do not depend on the order in which partitions come. The iteration ends when the totals are within CLOSE of the targets, or when it has come
hardly nearer (5 % of the gap) for STILL steps: targets that no nonnegative rates reach, or only rates of very few documents. The outcome says which, with the totals reached.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import quality_rules, toxicity
from auditlake.llm.common import Scratch, Texts, bounded_sample, free_name, map_batches, one_each, table

#: Labelled rows of each domain that the classifier is learned from, at most.
SAMPLE = 3_000
CLOSE, STILL, REPLAY = 1e-6, 8, 8
TARGETS = {"clean": 0.90, "poor": 0.07, "toxic": 0.03}


def domain() -> Column:
    """The domains of the labels table."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


@dataclass
class Classifier:
    domains: list[str]
    lexicon: toxicity.Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # (features + 1, domains)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight[:-1] + self.weight[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def dense(column: pa.Array, lexicon: toxicity.Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Words, and all statistics, of each text."""
    read = Texts(column)
    s = quality_rules.statistics(column, read)
    ratios = np.stack([s[c] for c in quality_rules.RATIOS], axis=1)
    return s["n_words"], np.concatenate((toxicity.features(column, lexicon, read), ratios), axis=1)


def softmax_regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, ridge: float = 1.0, steps: int = 400) -> np.ndarray:
    """Accelerated gradient descent on the penalised likelihood; the last row is the bias, which is not penalised."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = w / w.sum()
    penalty = np.full((x.shape[1], 1), ridge / len(x))
    penalty[-1] = 0
    rate = 1 / (0.5 * np.linalg.eigvalsh((x * w[:, None]).T @ x).max() + penalty.max())
    target = np.eye(classes)[y]
    b = ahead = np.zeros((x.shape[1], classes))
    for k in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (x.T @ (w[:, None] * (p - target)) + penalty * ahead)
        ahead, b = new + k / (k + 3) * (new - b), new
    return b


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier | None:
    """labelled(doc_id, domain): at most `sample` rows of each domain (the first by a hash of the id), weighted by how many there are in all. None without rows."""
    known = labelled.select(F.col("doc_id").cast("long").alias("label_id"), "domain").dropna().distinct()
    n = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    domains = sorted(n)
    some = None
    for d in domains:
        own = bounded_sample(known.where(F.col("domain") == d), sample, "label_id")
        some = own if some is None else some.union(own)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).drop("label_id")
    text = one_each(text, "doc_id", "domain")
    half = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(2))
    lexicon = toxicity.learned_lexicon(text.where(half == 0).withColumn("label", (F.col("domain") == "toxic").cast("int")))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, x = dense(batch.column(1), sent.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "domain", "x"])

    got = map_batches(text.where(half == 1), f, "doc_id long, domain string, x array<double>", size=1 << 20).toPandas()
    if not len(got):
        return None
    got["key"] = got["x"].map(tuple)
    got = got.sort_values(["doc_id", "domain", "key"], kind="stable")
    domains = sorted(set(got["domain"]))
    x, y = np.array(got["x"].tolist()), np.array([domains.index(d) for d in got["domain"]])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    w = np.array([n[d] / (y == k).sum() for k, d in enumerate(domains)])[y]
    return Classifier(domains, lexicon, mean, scale, softmax_regression(np.clip((x - mean) / scale, -8, 8), y, w, len(domains)))


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def memberships(docs: DataFrame, model: Classifier, text_col: str, n_words: str, posterior: str, columns: list[str] | None = None) -> DataFrame:
    """docs (or its `columns`) with the number of words and the posteriors (in the order of model.domains) added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    columns = docs.columns if columns is None else columns
    own = [docs.columns.index(c) for c in columns]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        n, x = dense(batch.column(place), m.lexicon)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(n.astype(np.int64)), as_lists(m.posteriors(x))], [*columns, n_words, posterior])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_batches(docs, f, f"{kinds}, `{n_words}` long, `{posterior}` array<double>", size=1 << 20)


def rates(p: np.ndarray, steps: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    r = np.ones(len(p)) if start is None else start
    for s in steps:
        r = np.maximum(0.0, r - p @ s)
    return r


def matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


@dataclass
class Mixture:
    """How a fit ended. steps: those of the projected gradient; reached and target: expected words by domain; close: whether the targets are reached."""

    domains: list[str]
    steps: np.ndarray
    reached: np.ndarray
    target: np.ndarray
    close: bool


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], n_words: str, posterior: str, scratch: Scratch | None = None) -> Mixture:
    """Projected gradient until the totals are close or stand still. The targets' weights are of the domains that exist, scaled to the words there are."""
    k = len(domains)
    scratch = scratch or Scratch(members.sparkSession, "rates")
    slim = members.select(F.col(n_words).alias("n"), F.col(posterior).alias("p"), F.lit(1.0).alias("r"))
    names = [f"v{i}" for i in range(k + k * k)]

    def totals(steps: np.ndarray):
        """Expected words by domain, and second moments of the posteriors over documents whose rate is not 0."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, moments = np.zeros(k), np.zeros((k, k))
            for b in batches:
                n, p = b.column(0).to_numpy(), matrix(b.column(1), k)
                r = rates(p, steps, b.column(2).to_numpy())
                total += (n * r) @ p
                moments += (p * (n * (r > 0))[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*total.tolist(), *moments.ravel().tolist()]], names)

        return run

    def gather(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = slim.mapInArrow(totals(steps), ", ".join(f"{x} double" for x in names))
        whole = own.agg(*(F.sum(F.col(x).cast("decimal(38,9)")).cast("double").alias(x) for x in names)).first()
        whole = np.array([x or 0.0 for x in whole])
        return whole[:k], whole[k:].reshape(k, k)

    def advanced(steps: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(rates(matrix(b.column(1), k), steps, b.column(2).to_numpy()))], ["n", "p", "r"])

        return run

    white = lambda m: np.linalg.pinv(m, rcond=1e-10, hermitian=True)
    steps, written = np.zeros((0, k)), 0
    now, m = gather(steps)
    every = white(m)
    weight = np.array([targets.get(d, 0.0) for d in domains])
    target = now.sum() * weight / weight.sum() if weight.sum() > 0 else now
    gap = lambda x: float((x - target) @ every @ (x - target))
    metric, least, size = every, gap(now), now.sum()
    still, plain, pause = 0, 0, 2
    while size > 0 and np.abs(now - target).max() > CLOSE * size and still < STILL:
        if len(steps) - written >= REPLAY:
            slim = scratch.keep(slim.mapInArrow(advanced(steps[written:]), "n long, p array<double>, r double"), f"rates-{len(steps)}")
            if written:
                scratch.drop(f"rates-{written}")
            written = len(steps)
        trial = np.concatenate((steps, (metric @ (now - target))[None]))
        then, moments = gather(trial[written:])
        short = metric is not every and gap(then) > 0.9 * least
        still = 0 if gap(then) < 0.95 * least else still + 1
        if gap(then) < least:
            steps, now, m, least = trial, then, moments, gap(then)
        # clipped documents do not move any more: without them the step is as long as it may be. A step that does not help is not taken, and a growing number of
        # steps then are of the metric of all documents, each of which brings the totals nearer
        plain = max(0, plain - 1)
        if short:
            pause *= 2
            plain = pause
        metric = every if plain else white(m)
    if written:
        scratch.drop(f"rates-{written}")
    return Mixture(domains, steps, now, target, bool(size == 0 or np.abs(now - target).max() <= CLOSE * size))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, Mixture]:
    """docs (or its `columns` only) with n_words, posterior and rate added (under names that docs has not), and how the fit ended.

    Null or empty text has no words; its rate follows from its posteriors and moves no total. Without labelled rows every rate is 1 and the posterior empty. A
    target for a domain that no labelled row has is left out; a domain without a target gets none. Targets that no rates reach give the nearest totals that
    the steps found, a warning, and close=False. Rows that repeat a doc_id, or have none, are rows of their own with equal rates for equal texts; an empty table gives no rows.
    Other columns stay as they are. All rows of docs are in it.
    """
    targets = TARGETS if targets is None else targets
    columns = docs.columns if columns is None else columns
    n_words, posterior, rate = free_name(docs, "n_words", "posterior", "rate")
    model = train(docs, labelled, id_col, text_col)
    if model is None:
        none = docs.withColumn(n_words, F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long"))
        empty = np.zeros(0)
        return none.select(*columns, n_words, F.array().cast("array<double>").alias(posterior), F.lit(1.0).alias(rate)), Mixture([], np.zeros((0, 0)), empty, empty, True)
    scratch = Scratch(docs.sparkSession, "mixing")
    plain = docs.withColumn(text_col, F.col(text_col).cast("string"))
    members = scratch.keep(memberships(plain, model, text_col, n_words, posterior, columns), "members")
    fit = fit_rates(members, model.domains, targets, n_words, posterior, scratch)
    if not fit.close:
        warnings.warn(f"mixing: targets {dict(zip(fit.domains, fit.target.tolist(), strict=True))}, reached {dict(zip(fit.domains, fit.reached.tolist(), strict=True))}", stacklevel=2)
    k, place = len(model.domains), members.columns.index(posterior)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(matrix(batch.column(place), k), fit.steps))], [*batch.schema.names, rate])

    kinds = ", ".join(f"`{c}` {t}" for c, t in members.dtypes)
    return map_batches(members, f, f"{kinds}, `{rate}` double"), fit


def op5_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, fit = mixed(docs, table(spark, sf_dir, "labels").select("doc_id", domain().alias("domain")), columns=["doc_id"])
    shares = [(F.get("posterior", F.lit(fit.domains.index(d))) if d in fit.domains else F.lit(None).cast("double")).alias(f"p_{d}") for d in TARGETS]
    return out.select("doc_id", "n_words", *shares, "rate")
