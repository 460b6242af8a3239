"""Segmentation, labels, chunks, cases, statistics, sync, sources."""

import io
import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import text as fn
from auditlake.operators import chunk, label, mine, segment, state, stats, sync
from auditlake.sources import documents, packs


@pytest.mark.parametrize(("title", "want"), [("第一章 招标公告", "招标公告"), ("评标办法", "评审办法"), ("投标人资格要求（供应商）", "资格要求"), ("采购需求及技术参数", "技术要求"), ("投标人须知前附表", "投标须知"), ("项目概况", None), ("关于进一步加强管理的通知", None), ("附件：技术规范", None)])
def test_section_types(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(segment.section_type("t").alias("x")).first().x == want


def lines(spark, rows):
    return spark.createDataFrame([(1, i, 1, x) for i, x in enumerate(rows)], "doc_id long, line_no int, page int, text string")


def test_sectionize(spark):
    rows = ["封面", "第一章 招标公告", "公告正文", "", "第二章 评审办法", "办法一", "第三章 评标办法", "办法二", "第四章 招标公告", "补充"]
    raw = segment.sections_of_lines(lines(spark, rows)).orderBy("sec_no").collect()
    assert [(r.section_type, r.content) for r in raw] == [("招标公告", "公告正文\n\n"), ("评审办法", "办法一\n\n【第三章 评标办法】\n办法二\n"), ("招标公告", "补充\n")]
    # the last raw section replaces an earlier one of its type
    got = {r.section_type: r.content for r in segment.section_map(segment.sections_of_lines(lines(spark, rows))).collect()}
    assert got == {"招标公告": "补充\n", "评审办法": "办法一\n\n【第三章 评标办法】\n办法二\n"}


def test_empty_sections_stay_only_before_another_heading(spark):
    raw = segment.sections_of_lines(lines(spark, ["第一章 招标公告", "第二章 评审办法", "x", "第三章 合同条款"])).orderBy("sec_no").collect()
    assert [(r.section_type, r.content) for r in raw] == [("招标公告", ""), ("评审办法", "x\n")]


def test_contents_page_has_no_headings(spark):
    raw = segment.with_headings(lines(spark, ["目录", "第一章 招标公告", "第二章 评审办法", "第三章 合同条款"])).collect()
    assert all(r.heading is None for r in raw)


def test_styled_sections(spark):
    rows = [(1, 0, 1, "招标公告", True, 1), (1, 1, 1, "正文", False, 3), (1, 2, 1, "采购公告", True, 2), (1, 3, 1, "更多", False, 3), (1, 4, 2, "空的章节", True, 1), (1, 5, 2, "评审办法", True, 1), (1, 6, 2, "打分", False, 1)]
    raw = segment.sections_of_styled_lines(spark.createDataFrame(rows, "doc_id long, line_no int, page int, text string, heading boolean, level int")).orderBy("sec_no").collect()
    assert [(r.section_type, r.content, r.headings) for r in raw] == [("招标公告", "正文\n\n【采购公告】\n更多", ["采购公告"]), ("评审办法", "打分", [])]


def test_font_statistics_and_scores(spark):
    spans = spark.createDataFrame([(1, 0, 30.0), (1, 1, 12.1), (1, 1, 11.9), (1, 1, 16.0), (1, 2, 9.0)], "doc_id long, page int, font_size double")
    assert {r.page: r.body_size for r in segment.font_stats(spans).collect()} == {0: 30.0, 1: 12.0, 2: 12.0}
    one = spark.createDataFrame([(18.0, 12.0, True, "评审")], "s double, b double, bold boolean, t string")
    r = one.select(segment.heading_score("s", "b", "bold", "t").alias("x"), segment.heading_level("s", "b").alias("l"), segment.style_level(F.lit("Heading 2")).alias("h")).first()
    assert r.x == pytest.approx(1.1) and r.l == 1 and r.h == 2


def test_missing_and_titles(spark):
    s = spark.createDataFrame([(1, "招标公告"), (1, "资格要求")], "doc_id long, section_type string")
    assert {r.section_type for r in segment.missing_required(s, s).collect()} == {"招标范围", "评审办法", "投标须知"}
    t = spark.createDataFrame([("第一章 总则\n二、 细则\n3. 细则\n",)], "t string").select(segment.chapter_titles("t").alias("x")).first().x
    assert t == ["总则", "细则"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="甲乙 ab\n，。（", max_size=12), min_size=1, max_size=6))
def test_grams_and_normalized(spark, texts):
    import re

    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", fn.normalized("t").alias("n"), fn.grams(fn.normalized("t")).alias("g")).collect()
    for r in got:
        n = re.sub(r"\s+", "", texts[r.i]).translate(str.maketrans("（）【】：，。；！？—–", "()[]:,.;!?--"))
        assert r.n == n and set(r.g) == {n[k : k + 3] for k in range(len(n) - 2)} and len(r.g) == len(set(r.g))


def test_match_offsets_with_wide_characters(spark):
    import re

    rng = random.Random(5)
    rows = [("".join(rng.choice("ab😀甲\n ") for _ in range(40)), p) for p in ("a+b", "😀.", "[甲b]{2,}") for _ in range(20)]
    got = spark.createDataFrame(rows, "t string, p string").select("t", "p", fn.matches("t", F.concat(F.lit("(?d)"), "p")).alias("m")).collect()
    for r in got:
        assert [(m.start, m.match) for m in r.m] == [(m.start(), m.group()) for m in re.finditer(r.p, r.t)]


@pytest.mark.parametrize(("text", "want"), [("采购预算：120万元整", 1_200_000.0), ("预算金额: 3,500元", 3500.0), ("项目预算人民币 20万元", 200_000.0), ("50万元，最高限价", 500_000.0), ("没有", None)])
def test_budget(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fn.budget("t").alias("x")).first().x == want


def test_small_functions(spark):
    r = spark.createDataFrame([("2024年3月5日 与 2025年12月1日", "指定品牌产品", "指定使用", "abc")], "d string, a string, b string, c string").select(
        fn.last_date("d").alias("d"), fn.similarity("a", "b").alias("s"), fn.similarity("c", "c").alias("one"), fn.similarity(F.lit(""), "c").alias("none"), fn.decision_type(F.lit("驳回投诉，部分成立")).alias("t"), fn.valid_rule_id(F.lit("AB-1")).alias("v"), fn.valid_rule_id(F.lit("a")).alias("w"),
        fn.procurement_method(F.lit("竞争性磋商--服务类")).alias("m"), fn.is_placeholder(F.lit("（项目名称）")).alias("p"), fn.is_placeholder(F.lit("□"), "marker").alias("q"), fn.labelled_field(F.lit("项目名称：学校\n一、其他"), "项目名称").alias("f"), fn.tags(F.lit("品牌与参数")).alias("g"), packs.rendered(F.lit("{a}{b}"), {"a": "{b}", "b": "1"}).alias("r"),
    ).first()
    assert (r.d, r.s, r.one, r.none, r.t, r.v, r.w, r.m, r.p, r.q, r.f, r.g, r.r) == ("2025-12-01", 0.6, 1.0, 0.0, "rejected", True, False, "竞争性磋商", True, True, "学校", ["参数", "品牌"], "11")


def test_labels_and_smoothing(spark):
    s = spark.createDataFrame([(1, "x", "前附表第一章不得变更。短句在此处多写些字才行。前附表第二章不得变更。本项目位于某地，技术参数如下。□选项", 0)], "doc_id long, section_type string, content string, ord int")
    got = [(r.span_no, r.label, round(r.confidence, 2)) for r in label.marked(s).orderBy("span_no").collect()]
    assert got == [(0, "FIXED", 0.9), (1, "FIXED", 0.55), (2, "FIXED", 0.9), (3, "VARIABLE", 0.9), (4, "VARIABLE", 0.65)]
    tagged = label.tagged_text(label.marked(s)).first().text
    assert tagged.startswith("<<TEMPLATE>>\n") and tagged.count("<<REVIEW>>") == 1


def test_fingerprints(spark):
    t = spark.createDataFrame([(1, "a", "投标文件必须密封。某某公司填写内容。"), (2, "a", "投标文件必须密封。另外的公司内容。"), (3, "b", "根据招标投标法投标人须知评标办法，应当密封盖章。随便写的内容。")], "doc_id long, g string, text string")
    got = {(r.g, r.text, r.frequency) for r in label.fingerprints(t, ["g"]).collect()}
    assert got == {("a", "投标文件必须密封。", 2), ("b", "根据招标投标法投标人须知评标办法，应当密封盖章。", 1)}


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(3)
    prints = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 40))) for _ in range(30)]
    own = [p[: rng.randint(3, len(p))] + "".join(rng.choice("abcde") for _ in range(rng.randint(0, 3))) for p in prints] + ["ab", "zzzzz"]
    g = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    want = {}
    for x in set(own):
        best = max((len(g(x) & g(p)) / min(len(g(x)), len(g(p))) for p in prints if g(x) and g(p) and abs(len(x) - len(p)) <= max(0.3 * len(x), 10)), default=0)
        if best >= 0.85:
            want[x] = best
    a = spark.createDataFrame([(x, x) for x in set(own)], "sid string, text string")
    b = spark.createDataFrame([(p,) for p in prints], "text string").withColumn("hash_id", fn.text_hash("text"))
    got = {r.sid: r.score for r in label.fuzzy(a, b).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_fingerprint_marking(spark):
    prints = spark.createDataFrame([("投标文件必须按照要求密封并加盖公章。",)], "text string").withColumn("hash_id", fn.text_hash("text"))
    s = spark.createDataFrame([(1, "x", "（项目名称）采购。投标文件必须按照要求密封并加盖公章。投标文件必须按照要求密封并加盖公章了。", 0)], "doc_id long, section_type string, content string, ord int")
    got = [(r.label, r.confidence) for r in label.marked_by_fingerprint(s, prints).orderBy("span_no").collect()]
    assert got == [("VARIABLE", 0.9), ("FIXED", 0.95), ("FIXED", 0.8)]
    quick = {r.sid: (r.label, r.confidence) for r in label.quick_checked(spark.createDataFrame([(1, "投标文件必须按照要求密封并加盖公章。"), (2, "（项目名称）"), (3, "随便写些什么内容吧，都可以")], "sid long, text string"), prints).collect()}
    assert quick == {1: ("FIXED", 0.95), 2: ("VARIABLE", 0.9), 3: ("UNCERTAIN", 0.5)}
    assert label.texts_for_review(label.marked_by_fingerprint(s, prints)).first().variable == "（项目名称）采购。"


def test_packing_equals_a_plain_loop(spark):
    rng = random.Random(1)
    docs = {d: [(f"s{i}", "x" * rng.randint(0, 300)) for i in range(rng.randint(1, 8))] for d in range(20)}
    s = spark.createDataFrame([(d, n, c, i) for d, own in docs.items() for i, (n, c) in enumerate(own)], "doc_id long, section_type string, content string, ord int")
    got = {(r.doc_id, r.chunk_no): (r.section_names, r.prompt) for r in chunk.packed(s, 400).collect()}
    for d, own in docs.items():
        chunks, now = [], []
        for n, c in own:
            w = f"=== {n} ===\n{c}\n\n"
            parts = [(n, w)] if len(w) * 2 <= 400 else [(f"{n}({k // 200 + 1})", f"=== {n}({k // 200 + 1}) ===\n{w[k : k + 200]}\n\n") for k in range(0, len(w), 200)]
            for p in parts:
                if now and sum(len(b) * 2 for _, b in now) + len(p[1]) * 2 > 400:
                    chunks.append(now)
                    now = []
                now.append(p)
        chunks.append(now)
        assert [got[d, k] for k in range(len(chunks))] == [(" + ".join(n for n, _ in c), "".join(b for _, b in c)) for c in chunks]
        assert (d, len(chunks)) not in got


def test_overlap_affinity_and_groups(spark):
    t = spark.createDataFrame([("", ""), ("short", "short"), ("a" * 150 + "\n" + "b" * 90, "b" * 90), ("c" * 300, "c" * 100)], "p string, want string")
    assert all(r.got == r.want for r in t.select("want", chunk.overlap_tail("p", 200).alias("got")).collect())
    aff = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, w double")
    got = {(r.a, r.b): r.w for r in chunk.affinity_of(spark.createDataFrame([("b", "a"), ("a", "c")], "a string, b string"), aff).collect()}
    assert got == {("b", "a"): 0.9, ("a", "c"): 0.0}
    groups = spark.createDataFrame([(0, "g1", ["x"], ["y"], [], None), (1, "g2", [], ["x"], ["y"], 9000)], "ord int, id string, sections_high array<string>, sections_medium array<string>, sections_low array<string>, token_limit_override int")
    names = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "key long, section string")
    assert {(r.key, r.dimension, r.token_limit) for r in chunk.best_group(names, groups, 6000).collect()} == {(1, "g1", 6000), (2, "general", 6000)}


def test_clusters(spark):
    s = spark.createDataFrame([(1, n, "x" * k, i) for i, (n, k) in enumerate([("a", 89), ("b", 89), ("c", 89), ("d", 10), ("e", 10), ("f", 10)])], "doc_id long, section_type string, content string, ord int")
    seeds = spark.createDataFrame([(1, "a", 0)], "doc_id long, section_type string, rank int")
    got = [r.sections for r in chunk.clustered(s, seeds, {("a", "b"): 0.9, ("c", "a"): 0.5}, 300).orderBy("chunk_no").collect()]
    # 202 tokens of the seed and 202 of b, which is near enough for half as much again; c does not fit, d (44) does, e no longer
    assert got == [["a", "b", "d"], ["c", "e", "f"]]
    groups = spark.createDataFrame([(0, "g1", ["a"], ["b"], ["c"], 400)], "ord int, id string, sections_high array<string>, sections_medium array<string>, sections_low array<string>, token_limit_override int")
    clusters = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c", "d"])], "doc_id long, chunk_no int, sections array<string>")
    rows = chunk.semantic_chunks(s, clusters, groups, 300, "<{text}>").orderBy("chunk_no").collect()
    assert [(r.section_names, r.dimension, r.token_budget, r.overlap_tokens) for r in rows] == [("a + b", "g1", 400, 0), ("c + d", "g1", 400, 182)]  # the tail begins after a line feed in its first half
    assert rows[1].prompt.startswith("<【上文重叠】\n") and rows[1].prompt.endswith("=== d ===\n" + "x" * 10 + "\n\n>")


def _greedy(rows, order, near, limit, degrade):
    """rows [(name, size)], order: seeds by rank."""
    size, taken, out = dict(rows), [], []
    if len(size) <= degrade:
        total = 0
        for s in (s for s in size if s in order):
            if not out or total + size[s] > limit:
                out.append([])
                total = 0
            out[-1].append(s)
            total += size[s]
        return out
    for seed in order:
        if seed in taken:
            continue
        own, total, budget = [seed], size[seed], limit
        for c in sorted((s for s in size if s not in taken and s != seed), key=lambda s: -near(seed, s)):
            wide = int(budget * 1.5)
            if total + size[c] > budget:
                if near(seed, c) < 0.8 or total + size[c] > wide:
                    continue
                budget = wide
            own.append(c)
            total += size[c]
        taken += own
        out.append(own)
    left = [s for s in size if s not in taken]
    return out + ([left] if out and left else [])


def test_clusters_equal_a_plain_greedy_choice(spark):
    rng = random.Random(4)
    names = [f"s{i}" for i in range(9)]
    aff = {(a, b): rng.choice([0.3, 0.5, 0.8, 0.95]) for a in names for b in names if a < b and rng.random() < 0.4}
    near = lambda a, b: aff.get((a, b), aff.get((b, a), 0.0))
    rows, ranks, want = [], [], {}
    for d in range(40):
        own = rng.sample(names, rng.randint(1, 9))
        text = [rng.choice([None, "x" * rng.randint(0, 120)]) for _ in own]
        order = rng.sample(own, rng.randint(0, len(own)))
        rows += [(d, s, x, i) for i, (s, x) in enumerate(zip(own, text, strict=True))]
        ranks += [(d, s, i) for i, s in enumerate(order)]
        want[d] = _greedy([(s, 2 * (len(x or "") + len(s) + 11)) for s, x in zip(own, text, strict=True)], order, near, 300, 4)
    rows += [(99, None, "x", 0)]
    s = spark.createDataFrame(rows, "doc_id long, section_type string, content string, ord int")
    got = {d: [] for d in want}
    for r in chunk.clustered(s, spark.createDataFrame(ranks, "doc_id long, section_type string, rank int"), aff, 300, 4).orderBy("doc_id", "chunk_no").collect():
        got[r.doc_id].append(r.sections)
    assert got == want
    none = chunk.clustered(s.where("doc_id < 0"), spark.createDataFrame(ranks, "doc_id long, section_type string, rank int"), {}, 300)
    assert none.count() == 0


def test_similarity_equals_a_plain_search(spark):
    rng = random.Random(8)
    pairs = [("".join(rng.choice("abé唯") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abé唯") for _ in range(rng.randint(0, 30)))) for _ in range(200)]

    def plain(a, b):
        s, t = sorted((a, b), key=len)
        return next((k for k in range(len(s), 1, -1) if any(s[i : i + k] in t for i in range(len(s) - k + 1))), 0) / max(len(s), 1) if s and t else 0.0

    got = {(r.a, r.b): r.s for r in spark.createDataFrame(pairs, "a string, b string").withColumn("s", fn.similarity("a", "b")).collect()}
    assert all(abs(got[p] - plain(*p)) < 0.00051 for p in pairs)
    long = ("".join(rng.choice("abcdefgh") for _ in range(3000)), "".join(rng.choice("abcdefgh") for _ in range(3000)))
    long = (long[0], long[1][:1000] + long[0][500:1100] + long[1][1000:])
    assert spark.createDataFrame([long], "a string, b string").select(fn.similarity("a", "b").alias("s")).first().s == pytest.approx(0.2, abs=0.002)


def test_feedback_order_and_bounds(spark):
    rows = [("a", i, "false_positive") for i in range(3)] + [("b", i, "false_positive") for i in range(21)] + [("c", i, "confirm") for i in range(11)] + [("d", 0, "missed")] + [("e", i, "false_positive") for i in range(12)] + [("e", 12, "confirm")]
    got = {r.rule_id: r for r in state.feedback_state(spark.createDataFrame(rows, "rule_id string, event_id long, feedback_type string").withColumn("ts", F.col("event_id"))).collect()}
    assert {k: round(v.current_confidence, 6) for k, v in got.items()} == {"a": 0.85, "b": 0.5, "c": 1.0, "d": 1.0, "e": 0.52}
    assert got["a"].needs_review and not got["d"].needs_review


def test_rate_limit_forgets_refused_events(spark):
    t = [*range(12), 61]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(t)], "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.accepted for r in state.rate_limited(rows).collect()}
    assert [got[i] for i in range(13)] == [True] * 10 + [False] * 2 + [True]


def test_versions_and_upsert(spark):
    c = "rule_id string, platform string, rule_type string, target string, description string, enabled boolean, mandatory boolean"
    a = spark.createDataFrame([("A-1", "p", "t", "x", "d", True, True), ("B-1", "p", "t", "x", "d", True, True), ("C-1", "p", "t", "x", None, True, True)], c)
    b = spark.createDataFrame([("B-1", "p", "t", "x", "e", False, True), ("C-1", "p", "t", "x", None, True, True), ("D-1", "p", "t", "x", "d", True, True)], c)
    got = {r.rule_id: (r.status, sorted(f.field for f in r.fields)) for r in sync.versions_diff(a, b).collect()}
    assert got == {"A-1": ("removed", []), "B-1": ("changed", ["description", "enabled"]), "D-1": ("added", [])}
    incoming = b.withColumn("seq", F.lit(1)).union(b.where("rule_id = 'D-1'").withColumn("description", F.lit("last")).withColumn("seq", F.lit(2))).union(b.limit(1).withColumn("rule_id", F.lit("bad id")).withColumn("seq", F.lit(3)))
    after, counts, bad = sync.upserted(a, incoming)
    assert {r.rule_id: r.description for r in after.collect()} == {"A-1": "d", "B-1": "e", "C-1": None, "D-1": "last"}
    assert tuple(counts.first()) == (1, 3) and [r.rule_id for r in bad.collect()] == ["bad id"]
    rules_, n = sync.synced(a, b.select("rule_id", "description").where("rule_id <> 'C-1'"), "p")
    assert n.first().asDict() == {"new_rules": 1, "updated_rules": 1, "disabled_rules": 2}
    assert {r.rule_id for r in rules_.where("NOT enabled").collect()} == {"A-1", "C-1"}


def test_mining(spark):
    c = spark.createDataFrame([(1, "upheld", "指定品牌", 0), (2, "partial", "相同MAC地址", 0), (3, "rejected", "品牌", 0), (4, "upheld", "无", 0), (5, "upheld", "品牌", 1)], "case_id long, decision_type string, raw_content string, is_analyzed int").withColumn("summary", F.lit(None).cast("string"))
    known, new = mine.mined(c)
    assert {r.rule_id: r.hits for r in known.collect()} == {"R107": 2}
    assert [(r.name, r.is_new, r.hits) for r in new.collect()] == [("串通投标_MAC一致", True, 1)]


def test_cases_from_pages(spark):
    html = "<html><head><title>投诉处理</title><script>品牌</script></head><body><p>某政府采购投诉处理结果公告</p><p>项目名称：学校&nbsp;设备</p><p>一、相关</p><p>五、处理依据及结果</p><p>投诉成立，责令重新</p><p>2024年3月5日</p></body></html>"
    r = mine.cases(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert (r.title, r.project_name, r.decision_date, r.decision_type, r.complaint_types) == ("某政府采购投诉处理结果公告", "学校 设备", "2024-03-05", "upheld", [])


def test_trend_and_billing(spark):
    e = spark.createDataFrame([("2024-05-03",), ("2024-05-04",), ("2024-02-01",)], "d string").select(F.to_timestamp("d").alias("created_at"))
    got = [(r.month, r.n) for r in stats.monthly_trend(e, F.to_timestamp(F.lit("2024-06-15"))).collect()]
    assert got == [("2024-01", 0), ("2024-02", 1), ("2024-03", 0), ("2024-04", 0), ("2024-05", 2), ("2024-06", 0)]
    u = spark.createDataFrame([(90, 5.0)], "tokens long, cost double")
    assert [(a.type, a.severity) for a in stats.billing_status(u, 100, 5).first().alerts] == [("token_usage", "warning"), ("cost", "critical")]


def docx(paragraphs, tables=()):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(*x) for x in paragraphs) + "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_ingest_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("招标公告", "1"), ("正文",), ("评审办法", "1"), ("打分",), ("合同条款", "1"), ("条款",)], [[["a", "b"], ["c", "d"]]]))
    (tmp_path / "b.docx").write_bytes(docx([("第一章 招标公告",), ("内容",)]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"")
    files, sections, bad = documents.ingested(spark, str(tmp_path))
    names = {r.path: r.path[-6:] for r in files.collect()}
    assert sorted(names.values()) == ["a.docx", "b.docx", "c.docx"]
    assert sorted(r.section_type for r in sections.collect()) == ["合同条款", "招标公告", "招标公告", "评审办法"]
    assert {r.path[-6:]: r.reason.split(":")[0] for r in bad.collect()} == {"/d.txt": "extension", "c.docx": "BadZipFile"}  # Spark's scan leaves empty files out
    lines_, _ = documents.lines_of_files(documents.accepted(documents.files(spark, str(tmp_path)))[0])
    assert documents.table_texts(lines_.withColumn("doc_id", F.xxhash64("path"))).first().tables == "[TABLE 1]\na | b\nc | d"


def test_packs_from_files(spark, tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"rules": [{"id": "SEC-1", "type": "chapter_required", "target": "x", "weight": 5, "unknown": 1}]}))
    (tmp_path / "forb.json").write_text(json.dumps({"patterns": {"c1": {"severity": "critical", "regex_list": [{"id": "F-1", "pattern": "a", "weight": 3}, {"id": "F-1", "pattern": "b", "severity": "low"}]}, "c2": {"regex_list": [{"id": "F-2", "pattern": "c"}]}}}))
    (tmp_path / "ind.json").write_text(json.dumps({"rules": [{"id": "IND-GOV-1", "type": "forbidden", "target": "t", "pattern": "z"}]}))
    ind = str(tmp_path / "ind.json")
    got = packs.read_rules(spark, str(tmp_path / "base.json"), str(tmp_path / "forb.json"), [ind, ind]).orderBy("rule_seq").collect()
    assert [(r.rule_seq, r.rule_id, r.severity, r.weight) for r in got] == [(0, "SEC-1", "medium", 5.0), (1, "F-1", "critical", 3.0), (2, "F-1", "low", 10.0), (3, "F-2", "medium", 10.0), (4, "IND-GOV-1", "medium", 10.0)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "review.txt").write_text("{text}")
    (tmp_path / "p" / "review_v3.txt").write_text("{text} {b} {a}")
    r = packs.read_prompts(spark, str(tmp_path / "p")).first()
    assert (r.name, r.version, r.variables) == ("review", 3, ["a", "b", "text"])
