"""Near-duplicates, line dedup, suffix dedup, winnowing: against brute force and on edge cases."""

import hashlib
import random
import re
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.llm import common, decontaminate, line_dedup, near_dedup, suffix_dedup, suffix_sort
from auditlake.llm.common import Scratch
from auditlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def frame(spark, texts, extra=False):
    rows = [(i, x, "en") if extra else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + (", TEXT2 string" if extra else ""))


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "été", "ﬀ"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 80))] for _ in range(n // 3)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(2):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            out.append((" " if rng.random() < 0.5 else "\n").join(c).upper() if rng.random() < 0.3 else "\t".join(c))
    return [*out, None, "", "  \n", "One two", "one  TWO", "one two three four five six", out[0], out[0]]


def brute_near(texts, k, percent=80):
    sets = []
    for x in texts:
        w = WORD.findall(lower(x or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    texts = corpus(k)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, texts, True), k=k).collect()}
    assert got == brute_near(texts, k)


def test_near_duplicates_of_edge_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "x y z x y z"), (None, "x y z x y z"), (None, None), (7, "a b c d e f")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, True), (7, 2, 5, False)], key=repr)


def test_near_duplicates_among_repeated_and_null_ids(spark):
    rng = random.Random(11)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(36)]
    near = [[*x[:-1], "other"] for x in texts]
    nearer = [[*x[:-2], "an", "other"] for x in texts[:12]]
    # twelve texts of id 5, twelve without id and twelve of ids of their own; near ones with ids, without, and some that make buckets of three
    ids = [*[5] * 12, *[None] * 12, *range(20, 32)] + [*range(100, 112), *range(200, 212), *[None] * 6, *[6] * 6] + [*[6] * 6, *[None] * 6]
    rows = list(zip(ids, map(" ".join, texts + near + nearer), strict=True))
    rows += [(5, rows[13][1]), (None, rows[13][1]), (5, rows[0][1])]
    root = brute_near([x for _, x in rows], 5)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root[i][1], []).extend([doc] if doc is not None else [])
    want = [(doc, root[i][0], min(least[root[i][1]], default=None)) for i, (doc, _) in enumerate(rows)]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(12)
    text = [f"w{rng.randrange(10**6)}" for _ in range(50)]
    whole, near, other = " ".join(text), " ".join([*text[:-1], "x"]), " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))
    rows = [(1, whole, 1), (1, whole, 2), (1, near, 3), (2, near, 4), (1, other, 5), (None, other, 6), (None, whole, 7), (None, "alone in the world of texts", 8), (None, "alone in the world of texts", 9), (3, "", 1), (3, "", 1), (None, None, 1), (4, " \t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ROOT int")
    got = sorted(((r.doc_id, r.text) for r in near_dedup.deduplicated(docs).collect()), key=repr)
    first = min(whole, near, key=lambda x: hashlib.sha256(x.encode()).digest())
    assert got == sorted([(1, first), (1, other), (None, "alone in the world of texts"), (3, ""), (3, ""), (None, None), (4, " \t")], key=repr)
    assert near_dedup.deduplicated(docs).columns == ["doc_id", "text", "ROOT"] and near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_sketch_fills_every_bin_and_estimates(spark):
    rng = np.random.default_rng(0)
    a = np.unique(common.mix(rng.integers(0, 2**62, 400).astype(np.uint64)))
    b = np.concatenate((a[:320], np.unique(common.mix(rng.integers(0, 2**62, 80).astype(np.uint64)))))
    s = near_dedup.sketches([a, b, a[:1], a[:7]], 512)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.1
    assert (near_dedup.sketches([a[::-1].copy()], 512)[0] == s[0]).all()


def test_links_between_components_in_blocks():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**62, 100).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[: 100 - d], rng.integers(0, 2**62, d).astype(np.uint64)))) for d in (0, 4, 9, 40, 60)]
    got = near_dedup.links_between([b"%d" % i for i in range(5)], sets, [b"%d" % i for i in range(5)], 80)
    joined = {frozenset(x) for x in got}
    assert len(joined) == 2 and set().union(*joined) == {b"0", b"1", b"2"}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(40)] + [(1, 1)]
    root = {x: x for e in links for x in e}
    for _ in range(80):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long"), "c").collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "c").count() == 0


def brute_lines(texts, ids=None, min_chars=20, min_docs=3):
    ids = ids or list(range(len(texts)))
    held = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\r\x0b\x0c"))
    for i, x in zip(ids, texts, strict=True):
        for line in (x or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, x in zip(ids, texts, strict=True):
        lines = (x or "").split("\n")
        keep = [y for y in lines if not (len(key(y)) >= min_chars and len(held[key(y)]) >= min_docs and max(held[key(y)]) != i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    shared = ["The quick brown fox jumps over", "  the QUICK brown fox jumps over\r", "short line", "été été été été été x", "a line that stands in two documents only"]
    texts = ["\n".join(rng.choice([*shared[:4], f"own line number {rng.randint(0, 99)} of a text", ""]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [shared[4], shared[4], None, "", "\n", texts[0]]
    df = frame(spark, texts, True).repartition(3)
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "TEXT2", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == brute_lines(texts)


def test_line_dedup_edges_meet_across_partitions(spark, monkeypatch):
    """One line in all documents is cut into many partitions."""
    monkeypatch.setattr(Scratch, "partitions", lambda *a: 16)
    texts = ["the one line that everybody has"] * 200
    got = sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, texts)).collect())
    assert got == [(i, int(i != 199)) for i in range(200)]


def test_line_dedup_of_odd_ids(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line), (3, line), (3, line), (2, line + "\nx")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, ""), (3, line), (3, line), (2, "x")], key=repr)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_streamed_runs_do_not_depend_on_batches():
    rng = random.Random(1)
    rows = sorted({(rng.randrange(8), 0, rng.randrange(12)) for _ in range(70)}, key=lambda r: (r[0], -r[2]))
    whole = pa.RecordBatch.from_pydict({"h1": [r[0] for r in rows], "h2": [0] * len(rows), "doc_id": [r[2] for r in rows], "row": list(range(len(rows))), "places": [[0]] * len(rows)})
    want = []
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[2])
    for h, own in by.items():
        want += [k for k, r in enumerate(rows) if r[0] == h and len(own) >= 3 and r[2] != max(own)]
    for step in (1, 2, 3, 7, 100):
        for cuts in ([], [30], [5, 6, 50], [1, 2, 3, 69]):  # partitions: their open runs are settled by what the edges say
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                parts = [whole.slice(k, min(step, b - k)) for k in range(a, b, step)]
                out += [x for y in line_dedup.judged(3)(iter(parts)) for x in y.to_pylist()]
            edges = defaultdict(list)
            for x in out:
                if x["documents"]:
                    edges[x["h1"]].append((x["doc_id"], x["documents"]))
            got = [x["row"] for x in out if x["h1"] is None]
            got += [x["row"] for x in out if x["h1"] is not None and not x["documents"] and sum(n for _, n in edges[x["h1"]]) >= 3 and x["doc_id"] != max(d for d, _ in edges[x["h1"]])]
            assert sorted(got) == want, (step, cuts)


def brute_suffix(texts, span=200):
    raw = [(x or "").encode() for x in texts]
    n = Counter(x[i : i + span] for x in raw for i in range(len(x) - span + 1))
    out = {}
    for d, x in enumerate(raw):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - span + 1):
            if n[x[i : i + span]] > 1:
                gone[i : i + span] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out[d] = (len(x), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [suffix_dedup.MAX_BYTES, 900, 100])  # 100: down to single windows
def test_suffix_dedup_equals_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 5000)
    monkeypatch.setattr(Scratch, "partitions", lambda *a: 7)  # edges of partitions
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = []
    for _ in range(30):
        own = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            own += [p[a : a + rng.randint(150, 400)], " ".join(word() for _ in range(rng.randint(0, 20)))]
        texts.append(" ".join(own))
    texts += ["ab" * 300, "x" * 199, "y" * 200, "y" * 200, "z" * 450, None, "", texts[0]]
    got = {}
    for r in suffix_dedup.repeated_spans(frame(spark, texts, True), max_bytes=most).collect():
        got[r.doc_id] = (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.text).hexdigest())
    assert got == brute_suffix(texts)


def test_anchors_of_many_bytes_are_split(spark, monkeypatch):
    rng = random.Random(13)
    shared = "".join(rng.choice("abcdef") for _ in range(230))
    texts = [f"{i:05d}" * 30 + shared + f"{i + 7:06d}" * 30 for i in range(40)]
    calls, real = [], suffix_dedup.finer
    monkeypatch.setattr(suffix_dedup, "finer", lambda pieces, parts: calls.append(pieces.count()) or real(pieces, parts))
    for most, counts in ((1000, True), (suffix_dedup.MAX_BYTES, False)):
        calls.clear()
        got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.text).hexdigest()) for r in suffix_dedup.repeated_spans(frame(spark, texts), max_bytes=most).collect()}
        assert got == brute_suffix(texts) and bool(sum(calls)) == counts


def test_finer_anchors_have_each_window_once_and_equal_ones_together(spark):
    rng = random.Random(3)
    shared = "".join(rng.choice("abc") for _ in range(260))
    texts = [("".join(rng.choice("xy") for _ in range(rng.randint(0, 90))) + shared[rng.randint(0, 20) :] + f"{i:03d}").encode() for i in range(25)]
    pieces = spark.createDataFrame([(0, i, 0, 5, bytearray(x)) for i, x in enumerate(texts)], "a long, doc_id long, row long, lo int, piece binary")
    for parts in suffix_dedup.FINER:
        own, anchors = Counter(), defaultdict(set)
        for r in suffix_dedup.finer(pieces, parts).collect():
            for s in range(r.lo - 5, r.hi - 5 - 199):
                own[r.doc_id, s] += 1
                anchors[texts[r.doc_id][s : s + 200]].add(r.a)
        assert own == Counter((i, s) for i, x in enumerate(texts) for s in range(len(x) - 199))
        assert all(len(x) == 1 for x in anchors.values())
    assert len({a for x in anchors.values() for a in x}) == len(anchors)  # the finest anchor is a window


def test_suffix_dedup_of_edge_tables(spark):
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "q" * 10 + "".join(chr(97 + i % 26) for i in range(250))), (1, "q" * 10 + "".join(chr(97 + i % 26) for i in range(250))), (None, "short")]
    got = sorted(len(r.text) for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [0, 0, 5]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(1, 4), st.sampled_from([1, 3, 20, 200]), st.sampled_from([1, 300, 1 << 20]), st.sampled_from([1, 3, 1 << 19]))
def test_suffixes_are_sorted_with_their_common_prefixes(values, times, depth, memory, batch):
    values = (values * times)[:150]
    before, suffix_sort.BATCH = suffix_sort.BATCH, batch
    try:
        with tempfile.TemporaryDirectory() as folder:
            got = [(p, s) for x in suffix_sort.suffixes(np.array(values, np.uint16), depth, folder, memory) for p, s in zip(*(y.tolist() for y in x), strict=True)]
    finally:
        suffix_sort.BATCH = before
    assert sorted(p for p, _ in got) == list(range(len(values)))
    keys = [values[p : p + depth] for p, _ in got]
    assert keys == sorted(keys, reverse=True)
    for a, b, (_, shared) in zip(keys, keys[1:], got[1:], strict=False):
        assert shared == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_keys_are_ordered_in_ranges(tmp_path):
    rng = np.random.default_rng(5)
    key = np.concatenate((rng.integers(0, 50, 4000), np.full(3000, 7), rng.integers(0, 2**62, 2000))).astype(np.uint64)
    got = suffix_sort.ordered(key, suffix_sort.Files(str(tmp_path), 0), 1)
    assert (key[got] == np.sort(key)).all() and len(set(got.tolist())) == len(key)


def test_a_shard_larger_than_memory(tmp_path):
    """What a sort allocates does not follow the text: it stays in files."""
    import tracemalloc

    rng = np.random.default_rng(6)
    peaks, before, suffix_sort.BATCH = [], suffix_sort.BATCH, 1 << 14
    try:
        for n in (1 << 18, 1 << 21):
            t = np.memmap(tmp_path / f"t{n}", np.uint16, "w+", shape=(n,))
            t[:] = rng.integers(1, 27, n)
            folder = tmp_path / f"f{n}"
            folder.mkdir()
            tracemalloc.start()
            assert sum(len(p) for p, _ in suffix_sort.suffixes(t, 200, str(folder), 1 << 20)) == n
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    finally:
        suffix_sort.BATCH = before
    assert peaks[1] < 12 << 20 and peaks[1] < 2 * peaks[0]


def test_windows_belong_to_one_segment():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc d") for _ in range(n)) for n in (0, 199, 200, 201, 1500, 700)]
    raw, at = common.utf8(pa.array(texts))
    which, first, last, anchor, _ = suffix_dedup.segments(raw, at)
    own = Counter((int(w), s) for w, a, b in zip(which, first, last, strict=True) for s in range(a, b + 1))
    assert own == Counter((i, s) for i, x in enumerate(texts) for s in range(len(x) - 199))
    assert ((anchor >= last) & (anchor < first + 150)).all()


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_winnow(texts, items):
    words = lambda x: BENCH.findall(lower(x or ""))
    wins = defaultdict(set)
    for i, x in items:
        w = words(x)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1) if w else []:
            wins[tuple(w[k : k + n])].add(i)
    out = {}
    for d, x in enumerate(texts):
        w = words(x)
        hit, own = set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    own |= wins[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), sorted(i for i in own if i is not None))
    return out


@pytest.mark.parametrize(("block", "bits"), [(1_000_000, 26), (25, 26), (25, 6)])
def test_winnowing_equals_brute_force(spark, block, bits, monkeypatch):
    """Broadcast, joined, and joined behind filters that let everything pass."""
    if bits == 6:
        monkeypatch.setattr(decontaminate, "passes", lambda filter_, h: np.ones(len(h), bool))
    monkeypatch.setattr(decontaminate, "PART", 20)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(40)] + ["été", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 5, 9, 10, 11, 30, 45, 0, 1, 90])]
    items += [(20, items[5][1]), (5, items[6][1]), (None, items[4][1]), (30, None), (31, "unique words of this item only")]
    texts = []
    for _ in range(60):
        own = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        p = (rng.choice(items)[1] or "").split()
        a = rng.randint(0, max(0, len(p) - 5))
        texts.append(", ".join(own + p[a : a + rng.randint(5, 20)]).upper() + "!")
    texts += [None, "", "...", "UNIQUE words-of; this item only"]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in decontaminate.contamination(frame(spark, texts, True), b, broadcast_words=block).collect()}
    assert got == brute_winnow(texts, items)


def test_winnowing_with_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, ["a b c"])
    r = decontaminate.contamination(docs, none).first()
    assert (r.n_words, r.spans, r["items"]) == (3, [], [])
    assert decontaminate.contamination(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    odd = spark.createDataFrame([(1, "a b", 0, "x"), (1, "c d", 0, "x"), (None, "A, B!", 1, "y"), (None, None, 1, "y")], "doc_id long, text string, N_WORDS int, items string")
    for most in (10, 0):
        got = sorted(((r.doc_id, r.n_words, len(r.spans), r["items"]) for r in decontaminate.contamination(odd, some, broadcast_words=most).collect()), key=repr)
        assert got == sorted([(1, 2, 1, [1]), (1, 2, 0, []), (None, 2, 1, [1]), (None, 0, 0, [])], key=repr)


def test_every_shared_span_has_a_shared_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 2**62, 10).astype(np.uint64)
        sides = [np.concatenate((rng.integers(0, 2**62, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(0, 2**62, rng.integers(0, 9)).astype(np.uint64))) for _ in range(2)]
        prints = [set(g[decontaminate.winnowed(g)].tolist()) for g in (common.windows(s, decontaminate.GRAM) for s in sides)]
        assert prints[0] & prints[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x1cﬀ漢0_", max_size=30), max_size=6), st.sampled_from([1, 3, 1 << 20]))
def test_tokens_of_any_piece_size(texts, piece):
    before, common.PIECE = common.PIECE, piece
    try:
        raw, at = common.utf8(pa.array(texts, pa.string()))
        t = common.Tokens(common.LOWER[raw], at, common.SPACE)
        words = [WORD.findall(lower(x)) for x in texts]
        assert np.diff(t.first).tolist() == list(map(len, words))
        flat = [w for x in words for w in x]
        assert [bytes(common.LOWER[raw][a:b]).decode() for a, b in zip(t.start, t.end, strict=True)] == flat
        same = {w: h for w, h in zip(flat, t.hash.tolist(), strict=True)}
        assert [same[w] for w in flat] == t.hash.tolist() and len(set(same.values())) == len(same)
    finally:
        common.PIECE = before


def test_queries_return_their_columns(spark):
    from auditlake.llm.queries import oracle_sql, queries

    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries()] == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
    assert F is not None


@pytest.mark.parametrize(("size", "most"), [(1 << 30, 64), (100 << 30, 6_400), (160 << 40, 330_000), (1 << 50, 2_200_000)])
def test_partitions_grow_before_their_number_does(spark, monkeypatch, size, most):
    monkeypatch.setattr(Scratch, "written_bytes", lambda *_: size)
    n = Scratch(spark, "test").partitions("x")
    assert n <= most and size / n <= (512 << 20) and (size <= (160 << 30) or size / n >= (16 << 20))


def test_edges_are_broadcast_by_their_size_and_without_one_task_for_all(spark, monkeypatch):
    found = spark.createDataFrame([(1, 1, 1, 1, 1, 0, False, False, True), (1, 1, 1, 2, 1, 0, False, False, True), (2, 1, 1, 3, 1, 0, False, False, True), (1, 2, 1, 3, 1, 0, False, False, True), (5, 1, 1, 3, 1, 9, True, False, False)], "a long, d1 long, d2 long, doc_id long, row long, lo int, whole boolean, part boolean, edge boolean")
    out = suffix_dedup.with_edges(found)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 1, 1, 1, 0, True, False), (1, 1, 1, 2, 1, 0, True, True), (1, 2, 1, 3, 1, 0, False, True), (5, 1, 1, 3, 1, 9, True, False)]
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "strategy=broadcast" in plan
    texts = [f"line number {i % 7} of all the lines\nown {i}" for i in range(60)]
    bitmaps = sorted(map(tuple, line_dedup.keep_bitmaps(frame(spark, texts)).collect()), key=repr)
    assert len(bitmaps) == 53
    monkeypatch.setattr(common, "SENT_ROWS", 1)
    large = suffix_dedup.with_edges(found)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, out.collect())) and "strategy=broadcast" not in large._jdf.queryExecution().toString()
    assert sorted(map(tuple, line_dedup.keep_bitmaps(frame(spark, texts)).collect()), key=repr) == bitmaps
