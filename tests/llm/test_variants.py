"""Words that differ in one code point: against all pairs, and against counting word by word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from auditlake.llm import variants
from auditlake.llm.common import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for k, text in rows:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, found = {}, {}
    for w, c in words.items():
        found[w] = [x for x in words if x != w and near(w, x)]
        best = min(found[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * c else None
    out = []
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(found[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def vocabulary(seed, n, letters="abcdeé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)}
    for w in list(words):
        for _ in range(3):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return sorted(w for w in words if len(w) >= 6)


def corpus(seed, n):
    rng = random.Random(seed)
    words = vocabulary(seed, n)
    out = []
    for w in words:
        out += [w] * rng.choice([1, 4, 5, 6, 30, 180])
    rng.shuffle(out)
    rows = [(i, " ".join(x.upper() if rng.random() < 0.1 else x for x in out[i * 50 : i * 50 + 50])) for i in range(len(out) // 50 + 1)]
    long = "q" * 3000
    return [*rows, (None, None), (None, "aaaaaa " * 6), (7, "aaaaab-aaaaab9aaaaab_aaaaab×aaaaab÷ aaaaab aaaaab"), (8, f"{long} {long}r " * 7), (9, ""), (10, "ÀÉÎÕÜß " * 9 + "àÉÎÕÜß " * 60)]


@pytest.mark.parametrize(("size", "together"), [(8192, 32_768), (40, 100), (1, 1)])
def test_variants_equal_brute_force(spark, monkeypatch, tmp_path, size, together):
    monkeypatch.setattr(variants, "CLASS", size)
    monkeypatch.setattr(variants, "TOGETHER", together)
    rows = corpus(3, 60 if size == 1 else 150)
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, WORD string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in variants.op12_spelling_variants(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)


def test_variants_of_an_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert variants.variants(spark.createDataFrame([(1, "one two"), (None, None)], "doc_id long, text string")).collect() == []


def test_pieces_cut_no_run(monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 10)
    text = "abcdefgh" * 5 + " short Élongé, abcdefg" + " x" * 30 + "yabcdefg"
    assert [w for part in variants.runs_of(text) for w in part] == [lower(w) for w in RUN.findall(text) if len(w) >= 6]


def test_a_very_long_text_is_counted_whole(spark):
    docs = spark.createDataFrame([(1, "abcdef ghijklm " * 400_000)], "doc_id long, text string")
    assert {r.word: r.n for r in variants.vocabulary(docs).collect()} == {"abcdef": 400_000, "ghijklm": 400_000}


def test_wavelet_matrix_reports_rectangles():
    rng = np.random.default_rng(1)
    v = rng.permutation(300)
    tree = variants.WaveletMatrix(v, 300)
    a, low = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    b, high = np.minimum(300, a + rng.integers(0, 120, 200)), np.minimum(300, low + rng.integers(0, 120, 200))
    q, got = tree.report(a, b, low, high)
    want = {(k, x) for k in range(200) for x in v[a[k] : b[k]].tolist() if low[k] <= x < high[k]}
    assert len(q) == len(want) and {(x, y) for x, y in zip(q.tolist(), got.tolist(), strict=True)} == want


def test_classes_are_split_until_they_are_small(spark, monkeypatch):
    monkeypatch.setattr(variants, "CLASS", 20)
    sizes = []
    held = variants.near_in_classes
    monkeypatch.setattr(variants, "near_in_classes", lambda entries: sizes.append(len(entries)) or held(entries))
    words = [f"prefix{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    scratch = Scratch(spark, "test")
    got = variants.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), scratch)
    pairs = {(r.word, r.near) for r in got.collect()}
    assert pairs == {(a, b) for a in words for b in words if near(a, b)}
    last = spark.read.parquet(*[f"{scratch.path}/entries{k}" for k in range(3)]).where("lo = hi")
    assert last.groupBy("l", "lo", "key").count().agg({"count": "max"}).first()[0] <= 17
