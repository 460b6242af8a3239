"""What SQL cannot say, against brute force on the given tables: the verdicts of the learned list, and the recall of the pipeline's near-dedup on the text that reaches it."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from auditlake.llm import near_dedup, quality_rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKS = set(".,;:!?|#*$%&<>()[]{}\"'-_/\\@+=~^`")


def plain_statistics(text):
    """quality_rules.FEATURES of a text, word by word."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    in_twice = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    symbols, chars = sum(c in "#*$%&|<>" for c in text), sum(map(len, words))
    upper, letters = sum("A" <= c <= "Z" for c in text), sum(c.isascii() and c.isalpha() for c in text)
    longest = run = 0
    for i, w in enumerate(words):
        run = run + 1 if i and w == words[i - 1] else 1
        longest = max(longest, run)
    per = lambda a, b: a / max(b, 1)
    n, dup = len(words), len(lines) - len(set(lines))
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": len(in_twice), "mean_word": per(chars, n), "symbols_per_word": per(symbols, n), "dup_line_share": per(dup, len(lines)),
        "repeat_share": per(len(in_twice), n), "capitals": per(upper, letters), "punctuation": per(sum(c in MARKS for c in text), chars), "digits": per(sum(c in "0123456789" for c in text), chars),
        "distinct_words": per(len(set(words)), n), "words_per_line": per(n, len(lines)), "lone_marks": per(sum(w in MARKS for w in words), n), "exclamations": per(text.count("!"), n), "longest_run": per(longest, n),
    }


def test_verdicts_of_the_list_equal_a_plain_reading(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learned_rules(docs, labels)
    assert rules
    got = {r.doc_id: r for r in quality_rules.judged(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    fired = set()
    for d, text in texts.items():
        x = plain_statistics(text)
        assert all(abs(got[d][f] - x[f]) < 1e-9 for f in quality_rules.FEATURES), (d, [f for f in quality_rules.FEATURES if abs(got[d][f] - x[f]) >= 1e-9])
        rule = next((k for k, conditions in enumerate(rules) if all((x[c.feature] >= c.value) == c.above for c in conditions)), None)
        failed = x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        assert (got[d].rule, got[d].base_failed, got[d].kept) == (rule, failed, not failed and rule is None), d
        fired.add(rule)
    assert None in fired and len(fired) > 1


def similar_pairs(texts, k=5, percent=80):
    """All pairs (i, j) with 100 * common >= percent * union over k-word shingles, by an index of every shingle."""
    sets, holders = {}, defaultdict(list)
    for d, text in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()
        for s in sets[d]:
            holders[s].append(d)
    common = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    return {(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)}


def stage_input(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return p.line_dedup(spark, p.language_id(spark, docs, sf), sf)


def recall(docs):
    """(pairs of similarity 0.8 or more in the rows, those of them in one component, components of more than one row, rows kept of these)."""
    own = docs.cache()
    pairs = similar_pairs({r.doc_id: r.text for r in own.select("doc_id", "text").collect()})
    of = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(own).select("doc_id", "component_id").collect()}
    kept = {r.doc_id for r in near_dedup.deduplicated(own).select("doc_id").collect()}
    size = Counter(of.values())
    many = {d for d, c in of.items() if size[c] > 1}
    assert {of[d] for d in of} == kept  # the smallest id of each component, and nothing else
    return len(pairs), sum(of[a] == of[b] for a, b in pairs), len({of[d] for d in many}), len(many & kept)


def test_near_copies_that_reach_the_stage_are_found(spark):
    pairs, found, groups, left = recall(stage_input(spark, SF).where(F.col("doc_id").isNotNull()))
    print(pairs, found, groups, left)
    assert pairs and found >= 0.9 * pairs and found == pairs
    assert left == groups
