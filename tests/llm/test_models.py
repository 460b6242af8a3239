"""Learned operators: held-out accuracy, methods on small data, edge cases; WARC and HTML; mixing; the pipeline."""

import base64
import hashlib
import random
import time
import zlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import boosting, html_text, language_id, mixing, quality_rules, toxicity, warc
from auditlake.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


# quality rules


def brute_base(x):
    w = WORD.findall(x or "")
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (x or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), dup, len(marked)


def test_base_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "a b c ", "é# ", "\n", "\t|", "漢 "]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", " \n ", "x\nx\n x\nx", "a a a", "a a a a"]
    got = {r.doc_id: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.text_statistics(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute_base(x) for i, x in enumerate(texts)}


def test_rules_are_grown_and_pruned():
    rng = np.random.default_rng(0)
    x = {c: rng.random(900) for c in quality_rules.FEATURES}
    bad = ((x["digits"] > 0.8) & (x["n_words"] < 0.5)) | (x["capitals"] > 0.9)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(900, bool)
    for r in rules:
        hit[quality_rules.covered(r, x, np.arange(900))] = True
    assert (hit == bad).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(900, bool)) == [] and quality_rules.learn(x, np.ones(900, bool)) == []


def test_rules_become_one_ordered_expression(spark):
    c = quality_rules.Condition
    rules = [(c("digits", True, 0.5), c("capitals", False, 0.2)), (c("digits", True, 0.1),)]
    rows = spark.createDataFrame([(0.6, 0.1), (0.6, 0.3), (0.0, 0.0)], "digits double, capitals double")
    assert [r.k for r in rows.select(quality_rules.as_column(rules).alias("k")).collect()] == [0, 1, None]
    assert rows.select(quality_rules.as_column([]).alias("k")).first().k is None


def test_quality_query(spark):
    got = queries()["op3_learned_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    ok = got.loc[labels.index]
    clean = ok[~ok.base_failed]
    assert clean.kept[labels[clean.index] == 1].mean() > 0.95
    assert not (got.base_failed & got.kept).any()
    assert clean.kept[labels[clean.index] == 0].mean() < 0.5
    odd = docs(spark, [(None, None, "a", 3), (1, "x y z " * 30, "b", 4), (1, "x y z " * 30, "b", 4)], ", kept string, N_WORDS int")
    some = quality_rules.judged(odd, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(some) == 3 and all(r.base_failed and not r.kept for r in some)
    assert quality_rules.judged(odd.limit(0), spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, quality int")).count() == 0


# toxicity


def test_boosted_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.7) & (x[:, 1] > 0.5)).astype(int)
    m = boosting.boost(x, y, np.ones(1500))
    assert ((m.probability(x) >= 0.5) == y).mean() > 0.98
    knots, values = boosting.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert knots.tolist() == [1, 1, 2, 3, 4, 4] and values.tolist() == [0, 0, 0.5, 0.5, 1, 1]
    assert (np.diff(m.probability(np.sort(x, axis=0))) >= -1).all() and 0 <= m.probability(x).min() <= m.probability(x).max() <= 1


def test_toxic_features():
    w = toxicity.hashes_of(["idiot"])
    lex = toxicity.Lexicon(w, np.array([4.0]))
    f = {c: v for c, v in zip(toxicity.FEATURES, toxicity.features(pa.array(["you IDIOT there", "an id1ot and i.d.i.o.t", "plain text", "", None, "AAAA!!??"]), lex).T, strict=True)}
    assert f["lexicon"].round(6).tolist() == [round(4 / 3, 6), 0, 0, 0, 0, 0] and f["near_you"][0] > 0
    assert f["hidden"][1] > 0 and f["hidden"][0] == 0 and f["obfuscated"][1] > 0 and f["longest_run"][5] == 4
    assert f["exclamations"][5] == 0.25 and np.isfinite(np.stack(list(f.values()))).all()


def test_toxicity_is_learned(spark):
    got = queries()["op6_toxicity"](spark, SF).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    own = got.loc[truth.index]
    held = own[own.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert ((held.predicted == truth[held.index]).mean()) > 0.85
    none = toxicity.scored(docs(spark, [(1, "x"), (None, None)]), toxicity.train(docs(spark, [(1, "x")]), spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert [r.score for r in none] == [0.0, 0.0]


# language


def test_language_is_learned(spark):
    got = queries()["op10_language_id"](spark, SF).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["lang"]
    held = got[got.held_out]
    assert (held.lang_pred == truth[held.index]).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_of_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    own = docs(spark, rows, ", lang string")
    m = language_id.train(own)
    assert m.languages == ["en", "fr"] and m.loss[-1] < m.loss[0] and (m.weight == 0).mean() > 0.5
    odd = docs(spark, [(1, None), (2, ""), (3, "123 !?"), (None, "the dog"), (5, "漢字"), (6, "le " * 50_000)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, m).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "en" and got[6][0] == "fr" and got[5][0] in ("en", "fr")
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.train(own.limit(0)) is None


def plain_grams(text):
    import unicodedata

    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    line = " " + "".join(w + " " for w in words)
    return Counter(g for k in (1, 2, 3) for i in range(len(line) - k + 1) if (g := line[i : i + k]) != " ")


@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 20])
def test_grams_of_any_piece_size(piece, monkeypatch):
    for text in ("", "a", " a", "ab", "a b", "The cat, the  CAT! été 漢字 x2y", "..", "ß\u0301 é\n\nz"):
        monkeypatch.setattr(language_id, "PIECE", piece)
        at, n = language_id.gram_counts(text)
        monkeypatch.setattr(language_id, "PIECE", 1 << 20)
        whole = np.unique(language_id.grams(text), return_counts=True)
        want = plain_grams(text)
        assert at.tolist() == whole[0].tolist() and n.tolist() == whole[1].tolist(), text
        assert n.sum() == sum(want.values()) and len(want) - 2 <= len(n) <= len(want), text  # hashes may fall together


def test_logits_are_those_of_tf_idf(spark):
    rows = [(i, x, lang) for i, (x, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    m = language_id.train(docs(spark, rows, ", lang string"))

    def place(g):
        h = 0
        for c in g:
            h = (h * 0x01000193 + (0 if c == " " else ord(c)) * 0x9E3779B1) % 2**32
        h = (h + len(g) - 1) % 2**32
        return ((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32 >> (32 - language_id.BITS)

    text = "the cat le chien"
    n = plain_grams(text)
    z = sum(k / sum(n.values()) * language_id.SCALE * m.weight[place(g)].astype(float) for g, k in n.items()) + m.bias
    assert np.allclose(m.logits(text), z, atol=1e-5) and np.abs(z - m.bias).max() > 0.1


def test_languages_with_clashing_columns_repeats_and_ties(spark):
    rows = [(i, x, lang, 0.5, "x") for i, (x, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    rows += [(1, rows[1][1], "fr", 0.5, "x"), (1, rows[1][1], "fr", 0.5, "x"), (7, "zzz", "zz", None, None)]
    own = docs(spark, rows, ", lang string, SCORE double, _lang string")
    got = language_id.predict(own, language_id.train(own), "text", "found", "p").collect()
    assert len(got) == len(rows) and {r.SCORE for r in got} == {0.5, None}
    assert len({(r.found, r.p) for r in got if r.text == rows[1][1]}) == 1
    assert language_id.predict(own.limit(0), None, "text", "found", "p").count() == 0


def test_temperature_fits_the_odds():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 2)) * 3
    y = (rng.random(4000) > language_id.softmax(z / 2.5)[:, 0]).astype(int)
    assert 2.0 < language_id.temperature(z, y) < 3.2


# WARC


def test_rare_languages_are_learned_and_frequencies_cover_all(spark, monkeypatch):
    rng = random.Random(8)
    words = {"aa": ["alba", "lama", "bala"], "zz": ["zyx", "xyz", "yzzy"]}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(12))
    rows = [(i, text("aa"), "aa") for i in range(600)] + [(i, None if i % 2 else "12 34", "aa") for i in range(600, 1500)] + [(i, text("zz"), "zz") for i in range(1500, 1506)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, real = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda *a: seen.append(a) or real(*a))
    m = language_id.train(docs, sample=5)
    assert m.languages == ["aa", "zz"]
    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 and x[1] and x[1][0].isalpha()]
    rare = sum(x[2] == "zz" for x in learned)
    labels, df, total = seen[0][1:]
    assert 0 < rare < 20 and labels.count("zz") == rare and labels.count("aa") == language_id.LEAST
    want = np.zeros(1 << language_id.BITS)
    for x in learned:
        want[np.unique(language_id.grams(x[1]))] += 1
    assert total == len(learned) and (df == want).all()
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, m).collect()}
    assert all(got[i] == lang for i, x, lang in rows if x and x[0].isalpha())


def test_equal_parts_of_languages():
    assert language_id.shares({"a": 10, "b": 5000, "c": 9000}, 4000) == 1995
    assert language_id.shares({"a": 10, "b": 20}, 4000) >= 20
    assert language_id.shares({str(i): 1000 for i in range(200)}, 4000) == language_id.LEAST


def test_warc_round_trip_in_chunks(spark):
    rng = random.Random(3)
    big = "".join(rng.choice("ab é\r\n") for _ in range(5000))
    rows = [(3, "http://a/1", big), (1, "http://a/2\r\nX: y", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", big + "x"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.archive(pages)
    got = {}
    for r in warc.read_chunks(manifest, chunk_bytes=512).collect():
        got.setdefault(r.record_id, []).append(r)
    assert sum(r.records for r in manifest.collect()) == 7 == len(got)
    html = {i: (x or "").encode() for i, _, x in rows}
    for chunks in got.values():
        chunks.sort(key=lambda r: r.chunk_no)
        own = html[chunks[0].page_id]
        if chunks[0].record_type == "response":
            assert b"".join(r.data for r in chunks) == own and all(len(r.data) <= 512 for r in chunks)
            sha = hashlib.sha1()
            for r in chunks:
                assert r.offset == sum(len(c.data) for c in chunks[: r.chunk_no])
                sha.update(r.data)
                assert r.digest == base64.b32encode(sha.digest()).decode()
        assert [r.last for r in chunks] == [False] * (len(chunks) - 1) + [True] and chunks[0].payload_bytes == len(own)
    kinds = {c[0].page_id: (c[0].record_type, c[0].refers_to_page) for c in got.values()}
    assert kinds[1] == ("response", None) and kinds[2] == ("revisit", 1) == kinds[None]
    assert kinds[5] == ("revisit", 4) and kinds[3][0] == "response"
    assert all(got[c[0].refers_to][0].page_id == c[0].refers_to_page for c in got.values() if c[0].refers_to)
    assert warc.read_chunks(warc.archive(pages.limit(0))).count() == 0
    whole = warc.read_chunks(warc.archive(pages, min_bytes=5)).where("last").groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in whole} == {"response": 7}


def test_records_of_repeated_and_missing_page_ids(spark):
    rows = [(1, "u", "same", 0, "a"), (1, "u", "same", 0, "a"), (1, "v", "other", 1, None), (2, "u", "same", 0, "a"), (8, "u", "twice", 0, "a"), (9, "u", "twice", 0, "a"), (None, "u", "alone", 2, "b"), (None, "u", "alone", 2, "b"), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk_no int, RECORD string").repartition(3)
    got = warc.read_chunks(warc.archive(pages), chunk_bytes=2).collect()
    assert len({(r.record_id, r.chunk_no) for r in got}) == len(got)
    texts = {}
    for r in sorted(got, key=lambda r: r.chunk_no):
        texts.setdefault(r.record_id, []).append(r)
    whole = sorted((str(c[0].page_id), c[0].record_type, str(c[0].refers_to_page), b"".join(r.data for r in c)) for c in texts.values())
    assert whole == sorted([("1", "response", "None", b"same")] * 2 + [("1", "response", "None", b"other"), ("2", "revisit", "1", b""), ("8", "response", "None", b"twice"), ("9", "revisit", "8", b"")] + [("None", "response", "None", b"alone")] * 2 + [("None", "response", "None", b"")])
    assert [texts[c[0].refers_to][0].page_id for c in texts.values() if c[0].refers_to] == [8]  # 1 stands twice, so no record of it is named


def test_few_bytes_in_many_partitions_make_few_archives_and_tasks(spark, tmp_path):
    rows = [(i, "u", None if i % 7 == 0 else f"page {i // 2}") for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(40).write.parquet(f"{tmp_path}/pages.parquet")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    was = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, ("40", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        got = warc.op1_warc_chunked_records(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        manifest = warc.archive(spark.read.parquet(f"{tmp_path}/pages.parquet"))
        assert sum(r.records for r in manifest.collect()) == 300 and 1 < manifest.select("path").distinct().count() <= spark.sparkContext.defaultParallelism
        first = {}
        for i, _, html in rows:
            first.setdefault(html, i)
        want = [(i, len(html or ""), base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode(), "response" if first[html] == i else "revisit", None if first[html] == i else first[html]) for i, _, html in rows]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    large = spark.createDataFrame([("file:///none", k * warc.SPLIT, (k + 1) * warc.SPLIT, 9) for k in range(30)], warc.MANIFEST)
    assert warc.dealt(large).rdd.getNumPartitions() == 30  # a range of full size is a task of its own
    small = spark.createDataFrame([("file:///none", k, k + 1, 1) for k in range(30)], warc.MANIFEST)
    assert warc.dealt(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert warc.dealt(large.limit(0)).rdd.getNumPartitions() == 1


def test_a_changed_archive_is_an_error(spark, tmp_path):
    import gzip

    head = warc.record_head("x", 1, "u", False, None, None, hashlib.sha1(b"abc").hexdigest(), 3, warc.DATE)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(head + b"abd\r\n\r\n"))
    size = (tmp_path / "x.warc.gz").stat().st_size
    m = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", 0, size, 1)], warc.MANIFEST)
    with pytest.raises(Exception, match="digest"):
        warc.read_chunks(m).collect()


@pytest.mark.parametrize("name", ["op1_warc_chunked_records", "op2_minhash_near_dedup", "op4_line_dedup", "op7_winnowing_decontamination", "op8_suffix_array_dedup"])
def test_queries_give_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = [tuple(r) for r in queries()[name](spark, d).collect()]
    cols = queries()[name](spark, d).columns
    want = c.sql(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# HTML


def brute_cut(score, tie):
    best = None
    for bits in range(1 << len(score)):
        lab = [bool(bits >> i & 1) for i in range(len(score))]
        cost = sum(max(0, -s) if lab[i] else max(0, s) for i, s in enumerate(score)) + sum(c for (i, j), c in tie.items() if lab[i] != lab[j])
        if best is None or cost < best - 1e-12:
            best = cost
    return best


def test_minimum_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(1, 9)
        score = [rng.uniform(-2, 2) for _ in range(n)]
        tie = {(i, j): rng.random() * 2 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        lab = html_text.min_cut(score, tie)
        cost = sum(max(0, -s) if lab[i] else max(0, s) for i, s in enumerate(score)) + sum(c for (i, j), c in tie.items() if lab[i] != lab[j])
        assert cost == pytest.approx(brute_cut(score, tie))


def nested(rng, n):
    """Ties as a page has them: a chain, and arcs that nest."""
    tie = {(i, i + 1): rng.random() for i in range(n - 1)}

    def arcs(a, b, depth):
        at = a
        while at < b and depth < 12:
            to = min(b, at + rng.randint(1, max(1, (b - a) // 2)))
            if to > at + 1:
                tie[at, to] = tie.get((at, to), 0.0) + rng.random()
                arcs(at, to, depth + 1)
            at = to

    arcs(0, n - 1, 0)
    return tie


def test_reductions_keep_the_cut():
    rng = random.Random(8)
    for n in [*range(1, 10)] * 6 + [40, 60]:
        score = [rng.choice([rng.uniform(-1, 1), 0.0]) for _ in range(n)]
        for tie in (nested(rng, n), {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4}):
            near = [{} for _ in range(n)]
            for (i, j), c in tie.items():
                near[i][j] = near[j][i] = c
            assert html_text.min_cut(score, tie) == html_text._by_flow(list(range(n)), score, near, [None] * n)  # the one with least content, too


@pytest.mark.parametrize("kind", ["chain", "nested"])
def test_minimum_cut_of_a_very_long_page_takes_linear_time(kind):
    rng = random.Random(9)
    n = 100_000
    tie = {(i, i + 1): 1.0 for i in range(n - 1)} if kind == "chain" else nested(rng, n)
    score = [rng.uniform(-0.5, 0.5) for _ in range(n)]
    began = time.time()
    assert len(set(html_text.min_cut(score, tie))) <= 2
    assert time.time() - began < 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>One &amp; two</h1><p><b>First   line.<br><p>Second &lt;line&gt; é.</p><p></p><div class="comments"><p>I like it very much indeed.</p></div></article><form><input>Sign</form><footer>&copy; x</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE, html_text.PRIOR) == "One & two\nFirst line.\nSecond <line> é."
    for odd in (None, "", "plain", "<", "<p", "<<<>>>", "<a href='", "<script>x", "</p></div>", "<!-- x", "&amp", "\x00<p>퟿"):
        assert isinstance(html_text.main_text(odd, html_text.PRIOR), str)


LONG = "A sentence of the article, long enough to be read, which says one thing and then another."
NAVIGATION = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul>'
WANT = f"Title of it\n{LONG}\nYes.\n{LONG}"
BODY = f"<h1>Title of it</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>"
COMMENTS = f'<div id="comments"><article class="x"><p>I read it twice. {LONG}</p></article><p>{LONG} Me too.</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>{NAVIGATION}</nav><article>{BODY}</article><footer>(c) 2020</footer></body>",
        f'<form action="x" id="aspnetForm"><div class="menu">{NAVIGATION}</div><article>{BODY}</article><div class="footer">(c) 2020</div></form>',  # a form around all of it
        f'<form><div id="nav">{NAVIGATION}</div><div>{BODY * 3}</div></form>',
        f'<div class="legal"><article>{BODY}</article></div>',  # a wrapper with a word against
        f'<nav>{NAVIGATION}</nav><div class="legal">{BODY * 3}</div>',
        f'<article><h1>Title of it</h1><p>{LONG}</p><p>Yes.</p><div class="read-more-block"><p>{LONG}</p></div></article>',
        f'<main><div class="ad">Buy now, buy it cheap.</div><article>{BODY}{COMMENTS}</article></main><aside><article><p>{LONG} Teaser.</p></article></aside>',
        f"<nav>{NAVIGATION}</nav><div><div>{BODY * 2}</div></div><div>{NAVIGATION}</div>",  # no evidence around the text
        f'<header><h2>The site</h2>{NAVIGATION}</header><div role="main"><header>Title of it</header><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div role="contentinfo">{LONG}</div>',
        f'<div class="cookie-notice">We use cookies on this site. {LONG}</div><div class="post">{BODY * 2}</div><div class="share-buttons"><button>Share</button></div>',
    ],
)
def test_main_text_of_many_layouts(page):
    times = next(n for n in (3, 2, 1) if page.count("Yes.") == n)
    assert html_text.main_text(page, html_text.PRIOR) == "\n".join([WANT] * times)


def test_inline_elements_keep_their_text():
    page = "<article><p>Let <math><mi>x</mi> = 1</math> and press <button>OK</button> to see <select><option>none</option></select>what it is, at once.</p></article>"
    assert html_text.main_text(page, html_text.PRIOR) == "Let x = 1 and press OK to see what it is, at once."


def test_the_cut_overrules_the_classifier():
    """Blocks whose own score says one thing and whose neighbours another."""
    page = f"<div><p>{LONG}</p><p>{LONG}</p><p>So it is.</p><p>{LONG}</p><p>{LONG}</p></div><div>{NAVIGATION}</div>"
    got = html_text.labelled(page, html_text.PRIOR)
    short = next(x for x in got if x[0] == "So it is.")
    assert short[1] < 0 and short[2]
    assert [x[2] for x in got] == [True] * 5 + [False] * 3


def test_words_of_class_and_id():
    said = {"main-nav": html_text.AGAINST, "content-sidebar": html_text.AGAINST, "post content": html_text.FOR, "article-comments": html_text.REMARK, "post footer": html_text.NONE, "x y": html_text.NONE, "mainContent": html_text.FOR}
    assert {k: html_text.words_say(k) for k in said} == said


def test_pages_that_repeat_and_clash(spark):
    page = f"<nav>{NAVIGATION}</nav><article>{BODY}</article>"
    rows = [(1, "u", page, "a", 1), (1, "u", page, "a", 1), (1, "v", "<article><p>Other.</p></article>", "b", 2), (None, None, page, None, None), (2, "u", None, "c", 3), (3, "u", "", "c", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, N_CHARS int")
    got = sorted((str(r.page_id), r.url or "", r.text) for r in html_text.extracted(pages, html_text.fitted(pages)).collect())
    assert got == sorted([("1", "u", WANT), ("1", "u", WANT), ("1", "v", "Other."), ("None", "", WANT), ("2", "u", ""), ("3", "u", "")])
    assert html_text.extracted(pages.limit(0), html_text.fitted(pages.limit(0))).count() == 0


def test_long_pages_stay_whole():
    page = f"<nav>{NAVIGATION}</nav><article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert html_text.main_text(page, html_text.PRIOR) == "\n".join([LONG] * 20_000)


def test_pages_of_the_data(spark):
    import html

    got = {r.page_id: r for r in queries()["op9_min_cut_html_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = "\n".join(y for y in (" ".join(html.unescape(x).split()) for x in re.split(r"<(?:/?(?:h1|p|b)|br)>", inner)) if y)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)
    none = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    assert html_text.extracted(none, html_text.fitted(none)).first().text == ""


# mixing


def test_rates_reach_the_targets(spark):
    got = queries()["op5_soft_membership_mixing"](spark, SF).toPandas()
    words = got.n_words * got.rate
    for d, share in mixing.TARGETS.items():
        assert (words * got[f"p_{d}"]).sum() / words.sum() == pytest.approx(share, abs=1e-3)
    assert (got.rate >= 0).all() and len(got) == 1000 and words.sum() == pytest.approx(got.n_words.sum(), rel=1e-3)


def plain_gap(n, p, target, tries=3000):
    """Least whitened square distance of the totals from the target over r >= 0, by coordinate descent."""
    a = p.T * n
    white = np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-10)
    r, off = np.ones(len(n)), a.sum(axis=1) - target
    for _ in range(tries):
        for i in range(len(n)):
            new = max(0.0, r[i] - (a[:, i] @ white @ off) / (a[:, i] @ white @ a[:, i]))
            off += a[:, i] * (new - r[i])
            r[i] = new
    return off @ white @ off, white


@pytest.mark.parametrize("targets", [{"a": 0.85, "b": 0.1, "c": 0.05}, {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 0.6, "b": 0.3, "c": 0.1}])
def test_projected_gradient_equals_a_plain_solver(spark, targets):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 100, 200)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n long, p array<double>").repartition(3)
    fit = mixing.fit_rates(df, ["a", "b", "c"], targets, "n", "p")
    r = mixing.rates(p, fit.steps)
    weight = np.array([targets.get(d, 0.0) for d in "abc"])
    target = n.sum() * weight / weight.sum()
    assert np.allclose(fit.target, target) and np.allclose((n * r) @ p, fit.reached) and (r >= 0).all()
    least, white = plain_gap(n, p, target, 300)
    off = (n * r) @ p - target
    assert off @ white @ off <= 1.02 * least + 1e-6 * n.sum() and fit.close == (np.abs(off).max() <= mixing.CLOSE * n.sum())


def test_mixing_without_targets_or_with_targets_out_of_reach(spark):
    df = spark.createDataFrame([(10, [0.9, 0.1]), (5, [0.8, 0.2])], "n long, p array<double>")
    fit = mixing.fit_rates(df, ["a", "b"], {}, "n", "p")
    assert len(fit.steps) == 0 and fit.close
    fit = mixing.fit_rates(df, ["a", "b"], {"b": 1.0}, "n", "p")
    p, n = np.array([[0.9, 0.1], [0.8, 0.2]]), np.array([10, 5])
    white = np.linalg.inv((p * n[:, None]).T @ p)
    gap = lambda r: ((n * r) @ p - [0, 15]) @ white @ ((n * r) @ p - [0, 15])
    least = min(gap(np.array([x, y])) for x in np.linspace(0, 3, 61) for y in np.linspace(0, 6, 601))
    r = mixing.rates(p, fit.steps)
    assert not fit.close and (r >= 0).all() and gap(r) <= 1.1 * least
    assert mixing.fit_rates(df.limit(0), ["a", "b"], {"a": 1.0}, "n", "p").close


def test_mixing_without_labels_or_rows(spark):
    own = docs(spark, [(1, "a b"), (None, None)], "")
    out, fit = mixing.mixed(own, spark.createDataFrame([], "doc_id long, domain string"))
    assert fit.domains == [] and sorted(r.n_words for r in out.collect()) == [0, 2] and {r.rate for r in out.collect()} == {1.0}


def test_mixing_of_repeated_rows_and_clashing_columns(spark):
    rows = [(i, "the clean text of a document " * 9 if i % 2 else "you idiot you moron " * 9, 5, None, None) for i in range(40)]
    rows += [(1, rows[1][1], 6, "x", 2.0), (1, rows[1][1], 6, "x", 2.0), (None, None, None, None, None), (50, "", 1, None, None)]
    own = spark.createDataFrame(rows, "doc_id long, text string, N_WORDS int, posterior string, rate double")
    labelled = spark.createDataFrame([(i, "clean" if i % 2 else "toxic") for i in range(40)], "doc_id long, domain string")
    out, fit = mixing.mixed(own, labelled, {"clean": 0.5, "toxic": 0.5})
    assert out.columns == ["doc_id", "text", "N_WORDS", "posterior", "rate", "_n_words", "_posterior", "_rate"]
    got = out.collect()
    assert len(got) == len(rows) and len({r._rate for r in got if r.doc_id == 1}) == 1
    assert [r._n_words for r in got if r.text in (None, "")] == [0, 0] and fit.domains == ["clean", "toxic"]
    assert mixing.mixed(own.limit(0), labelled)[0].count() == 0


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{d}/documents.parquet")
    kept = before
    for name, stage in p.STAGES:
        after = stage(spark, kept, d).cache()
        if name != "mixing":
            assert after.columns == before.columns
        assert 0 < after.count() <= kept.count()
        kept = after
    assert {"rate", "n_words"} <= set(kept.columns)
    assert p.run(spark, d).count() == kept.count()
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12 34", None, "s", 0)], before.schema)
    assert p.language_id(spark, odd, d).count() == 0 and p.line_dedup(spark, odd, d).count() == 3 and p.near_dedup(spark, odd, d).count() == 3 and p.decontamination(spark, odd, d).count() == 3


def test_odd_markup_takes_linear_time():
    import time

    began = time.time()
    for page in ("<a " * 100_000, "< " * 100_000, "<p>x" * 20_000, "<div>" * 20_000 + "x", "&amp;" * 50_000, "<b>" * 30_000 + "y</i>" * 30_000, "<div>x" * 20_000, "<div><p>x</div>" * 20_000):
        html_text.main_text(page, html_text.PRIOR)
    assert time.time() - began < 60
    assert [b.text for b in html_text.read_page("<p>a < b</p><p>c<a hr").blocks] == ["a < b", "c"]


def test_blocks_of_the_fit_come_from_the_whole_page(spark, monkeypatch):
    page = "<html><body><article>" + "".join(f"<p>Sentence number {i} of the article.</p>" for i in range(150)) + "</article><footer>" + "".join(f"<p>Link {i}</p>" for i in range(100)) + "</footer></body></html>"
    seen, real = [], html_text.fit
    monkeypatch.setattr(html_text, "fit", lambda x, y: seen.append((x, y)) or real(x, y))
    html_text.fitted(spark.createDataFrame([(i, page) for i in range(3)], "page_id long, html string"))
    x, y = seen[0]
    place = x[:, html_text.FEATURES.index("position")]
    assert len(y) == 3 * html_text.SAMPLE_BLOCKS and 0 < y.sum() < len(y)
    assert (place < 0.3).any() and (place > 0.8).any()
    assert html_text.sampled_blocks([4, 7], 1) == [4, 7]
