"""Near fingerprints: sent to the rows or joined, both as a plain comparison says; the sentences' grams are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text as fn
from auditlake.operators import label, near
from auditlake.plans import demo, tender

DATA = "/root/testdata/sf0.001"


def plain(texts, prints, least=0.85):
    g = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    out = {}
    for x in texts:
        if x is None or len(x) < 3:
            continue
        best = max((len(g(x) & g(p)) / min(len(g(x)), len(g(p))) for p in prints if len(p) > 2 and abs(len(x) - len(p)) <= max(0.3 * len(x), 10)), default=0)
        if best >= least:
            out[x] = round(best, 9)
    return out


def texts_and_prints():
    rng = random.Random(5)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    prints = [word("abcd", rng.randint(3, 60)) for _ in range(40)] + ["ab" * 12, "aaa", "中文字符" * 3, "a😀b😀c😀d😀e😀f", "xy", "", "p" * 300 + word("abc", 90)]
    texts = {"".join(c if rng.random() > 0.03 else rng.choice("abcdé中") for c in p)[rng.randint(0, 2) :] + word("abcd", rng.randint(0, 4)) for p in prints for _ in range(4)}
    return sorted(texts | {"ab" * 9, "ab" * 14, "aaaaaaaaaaaa", "zzzzz", "中文字符" * 2, "a😀b😀c😀d😀e😀", "q" * 5000, "p" * 350, "", "a"}), prints


@pytest.mark.parametrize("cells", [near.MOST_CELLS, 0])
def test_both_ways_equal_a_plain_comparison(spark, monkeypatch, cells):
    monkeypatch.setattr(near, "MOST_CELLS", cells)
    texts, prints = texts_and_prints()
    a = spark.createDataFrame([(x, x) for x in [*texts, None]], "sid string, text string")
    b = spark.createDataFrame([(x,) for x in [*prints, None]], "text string").withColumn("hash_id", fn.text_hash("text"))
    want = plain(texts, prints)
    got = {r.sid: round(r.score, 9) for r in label.fuzzy(a, b).collect()}
    assert got == want and len(want) > 60
    known = {r.sid: r.confidence for r in label.is_known_fixed(a, b).collect()}
    assert known == {x: 0.95 if x in prints else 0.8 if x in want else 0.0 for x in texts} | {None: 0.0}
    assert label.fuzzy(a, b.limit(0)).count() == 0 and label.fuzzy(a.limit(0), b).count() == 0


def test_gram_codes_are_the_grams(spark):
    rows = ["abc", "abcabcabcx", "a😀b😀c😀b😀", "é\u0000xyz\u0000", "￿￿￿a"]
    for r in spark.createDataFrame([(x,) for x in rows], "t string").select(fn.grams("t", 3).alias("g"), fn.gram_codes("t").alias("c")).collect():
        assert [(ord(x[0]) << 42) + (ord(x[1]) << 21) + ord(x[2]) for x in r.g] == r.c


@pytest.mark.parametrize("q", [demo.fixed_fuzzy, tender.sentences_known, tender.sentences_quick_checked])
def test_few_fingerprints_shuffle_no_grams(spark, q):
    plan = q(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Window" not in plan and "ArrowEvalPython" in plan


def test_texts_without_a_sign_need_no_look(spark):
    rng = random.Random(6)
    patterns = [*fn.PLACEHOLDERS, "（.*?）", "□", *(p for p, _ in label.FIXED_SIGNS + label.VARIABLE_SIGNS)]
    words = [w for p in patterns for w in p.replace("(?:", "|").replace(")", "|").split("|") if w] + ["x", "X", "_", "＿", "(", ")", "（", "）", "【", "】", "第3章", "٣", " ", "a", "\n"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(1500)] + ["xx", "a_＿", "()", "x_", "ax b_", "□", "注:", "本项目位于城东", "投标人的资格", "业绩的要求", "根据项目情况确定", "此处由人填写", "详见后面附件", "【】", "(项目名称)", "（金额）", "第一章"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    held = [F.col("t").rlike(fn.CASED + p) for p in patterns]
    seen = df.select(F.col("t").rlike(fn.SIGNED).alias("signed"), *(h.alias(f"h{k}") for k, h in enumerate(held))).collect()
    assert all(r.signed for r in seen if any(r[1:])) and all(any(r[k] for r in seen) for k in range(1, len(held) + 1))
