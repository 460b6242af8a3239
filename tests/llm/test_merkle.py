"""The Merkle manifest against a tree built level by level in one list."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditlake.llm import merkle
from auditlake.llm.common import Scratch


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    """The root, and for each leaf its (left, right) siblings per level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = range(i // 3 * 3, min(len(level), i // 3 * 3 + 3))
            paths[k].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def fold(h, path):
    for left, right in path:
        h = sha(left + h + right)
    return h


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        own[g] = tree([leaf(*r) for r in groups[g]])
    root, above = tree([own[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, path in zip(groups[g], own[g][1], strict=True):
            whole = path + above[k]
            tampered = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            f = fold(leaf(*r[:4], r[4].replace("\n", "")) if tampered else leaf(*r), whole)
            out.append((r[0], leaf(*r), own[g][0], root, sha("".join(a + b for a, b in whole)), f, f == root))
    return sorted(out, key=repr)


def table_of(seed, n):
    rng = random.Random(seed)
    sources = ["s0"] * 5 + [None, "", "é", "z" * 40, "-", ":"]
    rows = [(rng.choice([None, *range(-5, n)]), rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 7]), rng.choice([None, "", "a\nb", "\n", "text " * rng.randrange(40), "line\nline é"])) for _ in range(n)]
    return rows + rows[: n // 10] + [(10**9, "lone", "en", 3, "a\nb")] * (n > 5)


@pytest.mark.parametrize(("n", "partitions", "merge", "span"), [(1, 4, 64, 6), (40, 7, 2, 1), (700, 23, 3, 2), (2500, 5, 64, 6)])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, n, partitions, merge, span):
    monkeypatch.setattr(Scratch, "partitions", lambda *_a, **_b: partitions)
    monkeypatch.setattr(merkle, "MERGE", merge)
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = table_of(n, n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, LEAF string, `Size` int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)


def test_manifest_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_very_long_text_and_other_columns(spark):
    rows = [(i, "g", "x\n" * (2_000_000 if i == 1 else 2)) for i in range(5)]
    docs = spark.createDataFrame(rows, "k int, grp string, body string").withColumnRenamed("body", "hash")
    got = merkle.manifest(docs, ["k", "hash"], "grp", "k").withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    root, _ = tree([leaf(*(r[0], r[2])) for r in rows])
    assert len(got) == 5 and all(r.root == r.again == r.subroot == root for r in got)


def test_mountain_range_completes_short_runs_and_leaves_edges_open():
    stack = merkle.MountainRange(5)
    for i in range(1, 5):  # the first leaf is in the piece before
        stack.add(0, i, str(i))
    stack.rest()
    assert [x[:2] for x in stack.done if x[3] == merkle.OPEN] == [(0, 1), (0, 2), (1, 1)]
    whole = merkle.MountainRange(5)
    for i in range(5):
        whole.add(0, i, sha(str(i)))
    assert whole.done[-1] == (2, 0, tree([sha(str(i)) for i in range(5)])[0], merkle.TOP)
