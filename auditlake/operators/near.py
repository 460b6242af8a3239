"""The nearest of a few texts by common 3-grams (LAB-5), looked for where the rows are: grams are numbers, and a block of rows meets the texts in one product of matrices, so nothing is shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import gram_codes
from auditlake.session import ship

FOUND = "struct<hash_id:string,score:double>"
#: Texts times their different grams: 16 MB in each worker.
MOST_CELLS = 4_000_000
CHARS, ROWS = 1_000_000, 512


def sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, number in it of each gram, row of each gram): the different 3-grams of each text, by row."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    codes, own = (points[:-2] << 42) + (points[1:-1] << 21) + points[2:], row[:-2] == row[2:]
    codes, row = codes[own], row[:-2][own]
    each = np.unique(codes)
    if not len(each):
        return each, codes, row
    row, number = np.divmod(np.unique(row * len(each) + np.searchsorted(each, codes)), len(each))
    return each, number, row


class Nearest:
    """texts: (hash_id, normalized text of three characters at least)."""

    def __init__(self, texts: list[tuple[str, str]], least: float):
        texts = sorted(texts, key=lambda x: len(x[1]))
        self.ids, self.least, self.cells, self.tie = [x for x, _ in texts], least, MOST_CELLS, np.array([-zlib.crc32(x.encode()) for _, x in texts])
        self.length = np.array([len(x) for _, x in texts])
        self.codes, number, row = sets([x for _, x in texts])
        self.size = np.bincount(row, minlength=len(texts))
        self.has = np.zeros((len(self.codes), len(texts)), np.float32)
        self.has[number, row] = 1

    def _block(self, length: np.ndarray, size: np.ndarray, row: np.ndarray, gram: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, text, score) of the rows that are near one; row and gram: of each gram that a text has, too."""
        reach = np.maximum(length * 0.3, 10.0)
        a, z = np.searchsorted(self.length, (length - reach).min(), "left"), np.searchsorted(self.length, (length + reach).max(), "right")
        if a == z or not len(row):
            return []
        mine = np.zeros((len(length), len(self.codes)), np.float32)
        mine[row, gram] = 1
        score = (mine @ self.has[:, a:z]).astype(np.float64) / np.minimum(size[:, None], self.size[a:z])
        score[np.abs(length[:, None] - self.length[a:z]) > reach[:, None]] = 0
        out = []
        for r in np.flatnonzero(score.max(axis=1) >= self.least):
            best = np.flatnonzero(score[r] == score[r].max())
            k = best[self.tie[a:z][best].argmax()]
            out.append((int(r), int(a + k), float(score[r, k])))
        return out

    def __call__(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(row, text, score) of texts of three characters at least."""
        each, number, row = sets(texts)
        length, size = np.array([len(x) for x in texts]), np.bincount(row, minlength=len(texts))
        at = np.searchsorted(self.codes, each).clip(max=len(self.codes) - 1)
        at[self.codes[at] != each] = -1
        gram = at[number]
        row, gram = row[gram >= 0], gram[gram >= 0]
        found = []
        step = max(1, min(ROWS, self.cells // len(self.codes)))
        for k in range(0, len(texts), step):
            a, z = np.searchsorted(row, (k, k + step))
            found += [(k + r, p, s) for r, p, s in self._block(length[k : k + step], size[k : k + step], row[a:z] - k, gram[a:z])]
        return found


def nearest(prints: DataFrame, least: float) -> Callable[[Column], Column] | None:
    """f(normalized text) -> FOUND, null if none is near: prints(hash_id, _norm). None if the prints, which are counted first, are too many to be sent."""
    n = prints.agg(F.count("*")).first()[0]
    if n * 3 > MOST_CELLS or n * prints.select(F.explode(gram_codes("_norm")).alias("g")).distinct().count() > MOST_CELLS:
        return None
    spark = prints.sparkSession
    ship(spark)
    finder = Nearest([tuple(r) for r in prints.select("hash_id", "_norm").collect()], least)
    sent = spark.sparkContext.broadcast(finder)

    @F.arrow_udf(FOUND)
    def near(text: pa.Array) -> pa.Array:
        f, texts, ids, scores = sent.value, text.to_pylist(), [None] * len(text), [None] * len(text)
        if f.ids:
            # a longer text's band has no length of the prints; rows of like length meet few of them
            low, high = f.length[0], f.length[-1]
            fits = lambda n: n > 2 and n - max(n * 0.3, 10.0) <= high and n + max(n * 0.3, 10.0) >= low
            rows = sorted((len(x), k) for k, x in enumerate(texts) if x is not None and fits(len(x)))
            own: list[int] = []
            chars = 0
            for j, (size, k) in enumerate(rows):
                own.append(k)
                chars += size
                if chars >= CHARS or j + 1 == len(rows):
                    for r, p, s in f([texts[i] for i in own]):
                        ids[own[r]], scores[own[r]] = f.ids[p], s
                    own, chars = [], 0
        return pa.StructArray.from_arrays([pa.array(ids, pa.string()), pa.array(scores, pa.float64())], ["hash_id", "score"], mask=pa.array([x is None for x in ids], pa.bool_()))

    return near
