"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A bounded sample (SAMPLE rows, SAMPLE_BYTES) gives the cells' centroids, and how many cells a search must open for a recall of RECALL on the sample itself. Every row then goes to its nearest cell as the
residual from the centroid, padded to at least LEAST_BITS dimensions (short vectors have too few bits of their own), turned by a random rotation and kept as its signs, one bit each, with three correction
scalars: the residual's length, its inner product with the centroid, and that of the rotated direction with its signs. From these a search has an unbiased estimate of each inner product and a bound of
its error (EPSILON deviations). Rows of a cell lie in blocks by a hash, queries of a cell too, so a search is a table of tiles, block by block, however full a cell is. A tile first scores the best
estimates, which gives a limit, and then each vector whose bound reaches that limit, in double precision; the best of all tiles of a query are its answer.

Rows whose vector is null, empty, zero, or holds a null or a non-finite component take no part, nor do rows without id, nor those whose length is not the commonest one (of equally common ones the
shortest). A row is every other row's candidate, also rows of its own id; each row that repeats a query's id is a query, and its neighbours are returned under that id. Equal scores go by the smaller id.
Fewer candidates than asked for are all returned, but for those in cells that are not opened. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, ship, table

#: Bounds of the sample that the cells are fitted on.
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
#: Rows that a cell has on average, at most so many cells, and sample rows that a cell needs.
CELL, CELLS, PER_CELL = 4096, 512, 32
#: Recall on the sample that the number of opened cells must give.
RECALL = 0.99
LEAST_BITS = 256
#: Deviations that an estimate may err by: one in 15,000 errs more.
EPSILON = 4.0
#: Rows of a block (and their bytes), queries of a block.
BLOCK, BLOCK_BYTES, QUERIES = 16_384, 8 << 20, 256
#: Tiles of a task, about.
TILES = 4


@dataclass
class Model:
    """Centroids (cells, d) and a random rotation (d, bits), both of vectors divided by scale; probes: cells that a search opens."""

    centroids: np.ndarray
    rotation: np.ndarray
    scale: float
    probes: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]


def usable(c: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """(rows, d) in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def rotation(d: int, bits: int, seed: int) -> np.ndarray:
    """The first d rows of a random orthogonal matrix: padding with zeros and turning in one."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:d].astype(np.float32)


def centroids_of(x: np.ndarray, k: int, steps: int = 10) -> np.ndarray:
    """k-means of rows in random order."""
    c = x[:k].copy()
    for _ in range(steps if k > 1 else 1):
        own = nearest_cell(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest_cell(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """Cells to open, those of the largest inner product first, so that the k nearest of sample rows are found by so much."""
    q = x[:queries]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.empty((len(q), len(c)), np.int64)
    np.put_along_axis(place, np.argsort(-(q @ c.T), axis=1), np.arange(len(c))[None, :].repeat(len(q), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest_cell(x, c)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def encoded(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, packed signs (rows, bits / 8), scalars (rows, 3): length of the residual, its product with the centroid, cosine between direction and signs)."""
    x = (x / model.scale).astype(np.float32)
    cell = nearest_cell(x, model.centroids)
    c = model.centroids[cell]
    r = x - c
    n = np.sqrt((r * r).sum(1))
    turned = r @ model.rotation
    f = np.abs(turned).sum(1) / np.sqrt(model.bits) / np.where(n > 0, n, 1)
    return cell, np.packbits(turned > 0, axis=1), np.stack([n, (c * r).sum(1), np.where(n > 0, f, 1)], axis=1).astype(np.float32)


def estimates(q: np.ndarray, cell: int, codes: np.ndarray, scalars: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, bound of its error), both (queries, rows), of inner products divided by scale squared."""
    c = model.centroids[cell]
    rest = q - c
    n, cr, f = scalars.T
    signs = np.unpackbits(codes, axis=1, count=model.bits).astype(np.float32) * 2 - 1
    est = (rest @ model.rotation) @ signs.T
    est *= (n / f / np.sqrt(np.float32(model.bits)))[None, :]
    est += cr[None, :]
    est += (q @ c)[:, None]
    err = EPSILON * n * np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(model.bits - 1)
    size = np.sqrt((rest * rest).sum(1))
    rounding = 1e-5 * (1 + np.sqrt((q * q).sum(1)))[:, None] * (1 + n + np.sqrt((c * c).sum()))[None, :]
    return est, size[:, None] * err[None, :] + rounding


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of a[i] and b[j], summed in order of the components, so that equal vectors have equal scores wherever they lie."""
    out = np.zeros(len(i))
    for s in range(0, len(i), 1 << 18):
        x, y = a[i[s : s + (1 << 18)]], b[j[s : s + (1 << 18)]]
        part = out[s : s + (1 << 18)]
        for t in range(a.shape[1]):
            part += x[:, t] * y[:, t]
    return out


def rough(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same in any order of summing."""
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 14):
        out[s : s + (1 << 14)] = np.einsum("ij,ij->i", a[i[s : s + (1 << 14)]], b[j[s : s + (1 << 14)]])
    return out


def best_of_tile(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, cell: int, codes: np.ndarray, scalars: np.ndarray, model: Model, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of the block, score) of the k best of each query in a block, chosen by bounds and scored on the vectors."""
    est, err = estimates((q / model.scale).astype(np.float32), cell, codes, scalars, model)
    order = np.argsort(rows)
    at = np.minimum(np.searchsorted(rows, q_rows, sorter=order), len(rows) - 1)
    own = np.flatnonzero(rows[order[at]] == q_rows)
    est[own, order[at[own]]] = -np.inf
    limit = np.full(len(q), -np.inf)
    if len(ids) > k:
        first = np.argpartition(-est, k - 1, axis=1)[:, :k]
        seen = rough(q, np.repeat(np.arange(len(q)), k), x, first.ravel()).reshape(len(q), k)
        seen[np.isneginf(np.take_along_axis(est, first, axis=1))] = -np.inf
        limit = seen.min(axis=1)
    slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())  # of sums in another order
    with np.errstate(over="ignore"):
        bound = ((limit - slack) / model.scale / model.scale).astype(np.float32)
    out = est + err < np.nextafter(bound, -np.inf)[:, None]
    out[own, order[at[own]]] = True
    i, j = np.nonzero(~out)
    score = rough(q, i, x, j)
    if len(ids) > k:  # what cannot be among the k best goes before the exact sums
        every = np.full(est.shape, -np.inf)
        every[i, j] = score
        least = -np.partition(-every, k - 1, axis=1)[:, k - 1]
        near = score >= (least - slack)[i]
        i, j = i[near], j[near]
    score = products(q, i, x, j)
    order = np.lexsort((rows[j], ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    start = np.searchsorted(i, np.arange(len(q)))
    top = np.arange(len(i)) - start[i] < k
    return i[top], j[top], score[top]


class Index:
    """vectors: any table with an id and a vector column. Kept in the shared folder as blocks of codes, scalars and vectors by cell."""

    def __init__(self, vectors: DataFrame, id_column: str, column: str, k: int = 20, seed: int = 7):
        spark = vectors.sparkSession
        ship(spark)
        self.spark, self.scratch, self.k = spark, Scratch(spark, "ann"), k
        v = F.col(column)
        single = vectors.schema[column].dataType.simpleString() == "array<float>"
        self.type, self.kind = ("array<float>", "<f4") if single else ("array<double>", "<f8")
        kept = vectors.where(usable(v) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), v.cast(self.type).alias("v")).withColumn("row", F.monotonically_increasing_id())
        kept = self.scratch.keep(kept, "rows")
        sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.d, n = (sizes.d, sizes["count"]) if sizes else (1, 0)
        self.rows = kept.where(F.size("v") == self.d)
        self.model = self._fitted(n, seed)
        self._send()
        self.width = max(1, min(BLOCK, BLOCK_BYTES // (8 * self.d)))
        self.blocks = self._packed(self.rows, self._assigned(), "codes", "block", self.width)

    def _fitted(self, n: int, seed: int) -> Model:
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * self.d)))
        drawn = self.rows.orderBy(F.xxhash64("id", "row", F.lit(seed)), "row").limit(most).select("v").toArrow()
        x = matrix(drawn.column(0).combine_chunks(), self.d) if drawn.num_rows else np.zeros((0, self.d))
        scale = float(np.sqrt((x * x).sum(1)).max()) if len(x) else 1.0
        scale = scale if np.isfinite(scale) and scale > 0 else 1.0
        x = (x / scale).astype(np.float32)
        cells = max(1, min(CELLS, n // CELL, len(x) // PER_CELL))
        c = centroids_of(x, cells) if len(x) else np.zeros((1, self.d), np.float32)
        return Model(c, rotation(self.d, max(LEAST_BITS, -(-self.d // 64) * 64), seed), scale, probes_for(x, c, self.k, RECALL))

    def _send(self) -> None:
        self.sent = self.spark.sparkContext.broadcast(self.model)  # bounded: CELLS x d and d x bits numbers of four bytes

    def _assigned(self):
        sent, d = self.sent, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, codes, scalars = encoded(matrix(batch.column("v"), d), sent.value)
                raw = np.concatenate((codes, scalars.view(np.uint8).reshape(len(codes), 12)), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary()), batch.column("v")], ["row", "id", "cell", "code", "v"])

        return run

    def _opened(self):
        sent, d = self.sent, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = sent.value
                x = (matrix(batch.column("v"), d) / m.scale).astype(np.float32)
                cells = np.argpartition(-(x @ m.centroids.T), m.probes - 1, axis=1)[:, : m.probes].astype(np.int32)
                at = np.repeat(np.arange(len(x)), m.probes)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("id").take(take), pa.array(cells.ravel()), pa.array([b""] * len(at), pa.binary()), batch.column("v").take(take)], ["row", "id", "cell", "code", "v"])

        return run

    def _packed(self, rows: DataFrame, f, name: str, number: str, width: int) -> DataFrame:
        """One row for each block of a cell: (cell, number, ids, rows, codes, vectors) as bytes. A cell of n rows has n / width blocks, dealt by a hash of the row."""
        dealt = self.scratch.keep(rows.select("row", "id", "v").mapInArrow(f, f"row long, id long, cell int, code binary, v {self.type}"), f"{name}-dealt")
        counts = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count("*") / width).cast("int").alias("_n")))  # one row per cell, CELLS at most
        d, kind = self.d, self.kind

        def pack(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            as_bytes = lambda c: t.column(c).to_numpy().astype("<i8").tobytes()
            v = matrix(t.column("v").combine_chunks(), d).astype(kind).tobytes()
            return pa.table({"cell": t.column("cell").slice(0, 1), number: t.column(number).slice(0, 1), "ids": [as_bytes("id")], "rows": [as_bytes("row")], "codes": [b"".join(t.column("code").to_pylist())], "vectors": [v]}).cast(pa.schema([("cell", pa.int32()), (number, pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("codes", pa.binary()), ("vectors", pa.binary())]))

        placed = dealt.join(counts, "cell").select("row", "id", "cell", F.pmod(F.xxhash64("row"), F.col("_n")).cast("int").alias(number), "code", "v")
        return self.scratch.keep(placed.groupBy("cell", number).applyInArrow(pack, f"cell int, {number} int, ids binary, rows binary, codes binary, vectors binary"), name)

    def search(self, queries: Column | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest rows of each row that the condition (on id) holds for, itself left out."""
        own = self.rows if queries is None else self.rows.where(queries)
        asked = self._packed(own, self._opened(), "queries", "part", QUERIES)
        n_blocks, n_parts = (t.groupBy("cell").agg((F.max(number) + 1).alias("_n")) for t, number in ((self.blocks, "block"), (asked, "part")))
        tiles = n_blocks.join(n_parts.withColumnRenamed("_n", "_m"), "cell").agg(F.sum(F.col("_n").cast("long") * F.col("_m"))).first()[0] or 1
        n = max(self.spark.sparkContext.defaultParallelism, -(-tiles // TILES))
        every = lambda t, counts, name: t.join(F.broadcast(counts), "cell").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        left = every(self.blocks, n_parts, "part").repartition(n, "cell", "block", "part")
        right = every(asked.withColumnsRenamed({c: f"q_{c}" for c in ("ids", "rows", "vectors")}).drop("codes"), n_blocks, "block")
        both = left.join(right.repartition(n, "cell", "block", "part"), ["cell", "block", "part"])
        sent, d, k, kind = self.sent, self.d, self.k, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in range(batch.num_rows):
                    of = lambda c, t_: np.frombuffer(batch.column(c)[t].as_buffer(), t_)  # noqa: B023, E731
                    m, ids, q_ids, q_rows = sent.value, of("ids", "<i8"), of("q_ids", "<i8"), of("q_rows", "<i8")
                    raw = of("codes", np.uint8).reshape(len(ids), -1)
                    x, q = (of(c, kind).astype(np.float64).reshape(-1, d) for c in ("vectors", "q_vectors"))
                    scalars = np.ascontiguousarray(raw[:, -12:]).view("<f4")
                    i, j, score = best_of_tile(q, q_rows, x, ids, of("rows", "<i8"), batch.column("cell")[t].as_py(), raw[:, :-12], scalars, m, k)
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"q_row": q_rows[i], "query_id": q_ids[i], "vec_id": ids[j], "row": of("rows", "<i8")[j], "score": score}), preserve_index=False)

        found = both.mapInArrow(run, "q_row long, query_id long, vec_id long, row long, score double")
        w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, over all rows of embeddings."""
    return Index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20).search(F.col("id") % 20 == 0)


OP11_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20"""
