"""One pass for many patterns: candidates are never too few, results are those of one join per check, time hardly follows the number of rules."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from auditlake.operators import bias, mine, rules, scan
from auditlake.sources import packs


def test_required_literals():
    of = scan.required
    assert of("(?iudU)abc") == {"abc"} and of("a|bcd") == {"a", "bcd"} and of("ab+c?de") == {"de"} and of("x*") is None
    assert of("(?:须|必须).{0,10}(?:同一品牌|同品牌)") == {"一品牌", "品牌"}
    assert of("(foo|[0-9])bar") == {"bar"} and of("(foo|[0-9])") is None and of("(?:abc){2}") == {"abc"} and of("(?:abc)?") is None and of("[0-9]{3,}") is None
    for other in (r"\Qa.b\E", "[a[bc]]xyz", "[a-z&&[^b]]xyz", r"\p{L}abc", "(?x) a b c", r"\012abc", "abc(", r"(?<name>abc)\k<name>"):
        assert of(other) is None or all(x in other for x in of(other))
    assert of("[a[bc]]xyz") is None and of(r"\Qa.b\E") is None


def test_candidates_are_never_too_few():
    rng = random.Random(1)
    patterns = ["ab|cd", "a.?b", "(?:ab|c)+d", "b{2,}a", "[ab]c", "d(?=a)", "(?i)AB", "Straße", "ΣΑ", "k", "a(b|)c", "(ab)?c?", "ſt"]
    scanner = scan.Scanner([(0, "ab", None), (1, "b", "x"), (2, "", None)], list(enumerate(patterns)))
    for _ in range(3000):
        text = "".join(rng.choice("abcdABCD ßΣσςαΑKkſsSt") for _ in range(rng.randrange(9)))
        got = scanner(text, rng.choice(["x", "y"]))
        assert {k for k, p in enumerate(patterns) if re.search(p, text, re.I)} <= set(got["maybe"])
        assert (0 in got["exact"]) == ("ab" in text) and 2 in got["exact"]
    assert scanner("b", "x")["exact"] == [1, 2] and scanner("b", "y")["exact"] == [2] and scanner(None, None) == {"exact": [], "maybe": []}


def _pack(spark, n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    rows = []
    for k in range(n):
        kind = rng.choice(["forbidden", "forbidden", "keyword_required", "format_required", "chapter_required"])
        row = {"rule_id": f"R-{k}", "type": kind, "target": rng.choice(["s0", "s1", word()]), "weight": float(k % 30)}
        if kind == "keyword_required":
            row |= {"keyword": word()[:3], "target_section": rng.choice([None, "s0", "s1"])}
        if kind == "forbidden":
            row |= {"pattern": rng.choice([word(), f"{word()}|{word()}", f"{word()[:2]}.{{0,3}}{word()[:2]}", word().upper()]), "exclude_contexts": rng.choice([None, [word()[:2]]])}
        rows.append(row)
    return packs.rules_from(spark, rows)


def _texts(spark, n, seed=4):
    rng = random.Random(seed)
    text = lambda m: "".join(rng.choice("abcdefghijABC \n") for _ in range(m))
    sections = [(d, f"s{k}", text(rng.choice([0, 40, 400])) or None, k) for d in range(n) for k in range(rng.randint(1, 3))]
    docs = [(d, "一、s0\n二、other") for d in range(n + 2)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(sections, "doc_id long, section_type string, content string, ord int")


@pytest.mark.parametrize("by_print", [None, False, True])
def test_one_pass_equals_checks_apart(spark, by_print):
    docs, sections = _texts(spark, 6)
    pack = _pack(spark, 60)
    spans = None if by_print is None else sections.where("content IS NOT NULL").select("doc_id", "section_type", "ord", F.posexplode(F.split("content", " ")).alias("span_no", "text")).withColumn("label", F.element_at(F.array(*map(F.lit, ["FIXED", "VARIABLE", "UNCERTAIN"])), F.col("span_no") % 3 + 1))
    args = (docs, sections.where("content IS NOT NULL"), pack, spans, bool(by_print))
    one, apart = (sorted(map(repr, f(*args).collect())) for f in (rules.run, rules.run_apart))
    assert one == apart and len(one) > 100


def test_an_automaton_too_large_to_send_gives_the_same(spark, monkeypatch):
    docs, sections = _texts(spark, 4)
    pack = _pack(spark, 40)
    first = sorted(map(repr, rules.run(docs, sections.na.fill(""), pack).collect()))
    rx = bias.patterns_of(spark, [{"pattern_id": "p", "check_fields": ["general"], "keywords": ["ab", "c*d"]}], {})
    found = sorted(map(repr, bias.findings(sections, rx).collect()))
    cases = sections.select(F.col("doc_id").alias("case_id"), F.col("content").alias("raw_content"), F.lit("").alias("summary"), F.lit("upheld").alias("decision_type"))
    mined = sorted(map(repr, mine.known_patterns(cases, [("ab", "R"), ("cd", "S")]).collect() + mine.new_patterns(cases, [("n", "X", "ab|c.d", "high")]).collect()))
    monkeypatch.setattr(scan, "MOST_BYTES", 0)
    assert sorted(map(repr, rules.run(docs, sections.na.fill(""), pack).collect())) == first
    assert sorted(map(repr, bias.findings(sections, rx).collect())) == found and found
    assert sorted(map(repr, mine.known_patterns(cases, [("ab", "R"), ("cd", "S")]).collect() + mine.new_patterns(cases, [("n", "X", "ab|c.d", "high")]).collect())) == mined and mined


def test_five_thousand_rules(spark):
    """Forbidden rules whose words hardly occur: ten times the rules, nearly the same time, and no nested loop."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000))
    sections = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s0").alias("section_type"), F.concat(F.lit(text), F.col("id").cast("string"), F.lit(" forbidden7 ")).alias("content"), F.lit(0).alias("ord"))
    docs = sections.select("doc_id")

    def pack(n):
        own = [{"rule_id": f"R-{k}", "type": "forbidden", "target": "t", "pattern": f"(?:must|shall) .{{0,5}}word{k}x|forbidden{k} "} for k in range(n)]
        return packs.rules_from(spark, own + [{"rule_id": f"K-{k}", "type": "keyword_required", "target": "k", "keyword": f"{k} forbidden7"} for k in range(n // 10)])

    def timed(n):
        p = pack(n).cache()
        p.count()
        plan = rules.run(docs, sections, p).where("rule_type = 'forbidden'")
        assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
        times = []
        for _ in range(2):
            t = time.time()
            found = rules.run(docs, sections, p).where("rule_type = 'forbidden'")
            assert found.count() == 300
            times.append(time.time() - t)
        return min(times)

    few, many = timed(500), timed(5000)
    assert many < 4 * few + 5
