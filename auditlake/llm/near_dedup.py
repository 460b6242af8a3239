"""MinHash near-duplicates: fast similarity sketching, banding, exact verification, connected components.

Sketch. t coordinates ("bins"). In round i < t every shingle is thrown by the round's hash into one bin; in round t + j all are thrown into bin j. A bin keeps
the smallest (round, hash) that it ever got, so a value of an earlier round always wins and only empty bins matter from then on. After 2t rounds every
bin is filled, whatever the size of the set; a set of a few times t shingles is done after two or three rounds. Coordinates of two sets agree with
probability J, with the concentration of independent samples.

Banding. 32 bands of 4 coordinates: a pair with J = 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.

Verification. Sets of equal content are one class from the start. In a bucket (the classes that share a band) the smallest class is compared with every other
one, and components are formed. A bucket whose other members are then in different components is looked at once more, by blocks of bounded size, for links
between components; pairs inside one component need no look, and only links that join components come out, so a bucket of n classes gives fewer than n rows.
Comparison is on the full sets, by integers: 100 * |A & B| >= 80 * |A | B|.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import LOWER, SPACE, Scratch, Tokens, binary_array, free_name, map_batches, mix, utf8, windows
from auditlake.llm.components import components

BANDS, ROWS = 32, 4
PERCENT = 80


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; of the whole sequence if it has fewer words; empty without words."""
    raw, at = utf8(column)
    t = Tokens(LOWER[raw], at, SPACE)
    return [np.unique(windows(h, min(k, len(h)))) if len(h) else h for h in map(t.of, range(len(column)))]


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(len(sets), t) of fast similarity sketching; the sets must not be empty."""
    full = np.uint64(2**64 - 1)
    out = np.full((len(sets), t), full)
    flat = out.reshape(-1)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        to = row * t + (h % np.uint64(t)).astype(np.int64) if i < t else row * t + (i - t)
        np.minimum.at(flat, to, (np.uint64(i) << np.uint64(52)) | (h >> np.uint64(12)))
        if i % 8 < 3 or i >= t:
            short = (out == full).any(axis=1)
            if not short.all():
                stay = short[row]
                x, row = x[stay], row[stay]
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), part.shape[:2]).copy()
    for j in range(rows):
        out = mix(out + part[:, :, j])
    return out


def class_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): text_key tells texts of one id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text"))


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, bands) per row; node is null for an empty set."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2), k)
        full = [i for i, s in enumerate(sets) if len(s)]
        found = band_hashes(sketches([sets[i] for i in full], bands * rows), bands, rows).view(np.int64)
        at = dict(zip(full, found, strict=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), binary_array([class_key(s) if len(s) else None for s in sets]), pa.array([at.get(i) for i in range(len(sets))], pa.list_(pa.int64()))],
            ["doc_id", "text_key", "n_shingles", "node", "bands"],
        )

    return map_batches(keyed(docs, id_col, text_col), f, "doc_id long, text_key binary, n_shingles long, node binary, bands array<long>", 512)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(a, b) -> those whose sets are similar. texts(node, text), one text for each node."""

    def sets_of(nodes: list[bytes], column: pa.Array) -> list[np.ndarray]:
        """Neighbours in a batch are often the same node: its set is made once."""
        new = [i for i, x in enumerate(nodes) if not i or x != nodes[i - 1]]
        made = dict(zip(new, shingle_sets(column.take(pa.array(new, pa.int64())), k), strict=True))
        out: list[np.ndarray] = []
        for i in range(len(nodes)):
            out.append(made[i] if i in made else out[-1])
        return out

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (sets_of(batch.column(i).to_pylist(), batch.column(i + 2)) for i in (0, 1))
        keep = [i for i in range(batch.num_rows) if similar(x[i], y[i], percent)]
        return batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return map_batches(both.select("a", "b", "ta", "tb"), f, "a binary, b binary", 256)


#: Shingles of one block of a bucket: what a task holds of it is at most two blocks.
BLOCK = 2_000_000


def links_between(nodes: list[bytes], sets: list[np.ndarray], labels: list[bytes], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join all components of a block which similar pairs join. An inverted index gives one set's overlaps with all others at once, and the
    members of the largest component need no look: each pair between components has an end outside of it."""
    size = np.array([len(s) for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    label = np.array([names[x] for x in labels])
    largest = np.bincount(label).argmax()
    out = []
    for i in np.flatnonzero(label != largest):
        lo, hi = np.searchsorted(elements, sets[i], "left"), np.searchsorted(elements, sets[i], "right")
        n = hi - lo
        hit = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.bincount(hit, minlength=len(sets))
        for j in np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (label != label[i])):
            if label[j] != label[i]:
                out.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return out


def rest_links(scratch: Scratch, members: DataFrame, texts: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components inside the buckets. members(bucket, node, n_shingles) of buckets of three at least; texts(node, text), one text for each node."""
    labelled = members.join(roots.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = scratch.keep(labelled, "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n_shingles").alias("total")).where("lo <> hi")
    blocks = open_.select("bucket", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"))
    mine = labelled.join(blocks, "bucket").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # every pair of blocks meets once; a bucket of one block is one task's small group
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = mine.withColumn("other", other).select("bucket", "node", "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    full = mine.join(texts, "node").select("bucket", "i", "j", "node", "label", "text")

    def f(group: pa.Table) -> pa.Table:
        nodes, labels = group["node"].to_pylist(), group["label"].to_pylist()
        sets = shingle_sets(group["text"].combine_chunks(), k)
        found = links_between(nodes, sets, labels, percent) if len(nodes) > 1 else []
        return pa.table({"a": binary_array([a for a, _ in found]), "b": binary_array([b for _, b in found])})

    return full.groupBy("bucket", "i", "j").applyInArrow(f, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, class_size, and text_key (SHA-256 of the text) and root (a key of the component), which deduplicated() reads.

    Rows of equal sets are one class (class_size rows). component_id: the smallest doc_id among the rows reachable by links; kept: doc_id = component_id.
    Null or empty text, or text without words: n_shingles 0, linked with nothing, component_id = doc_id, kept. Rows that repeat a doc_id stay separate rows,
    each linked by its own text. A null doc_id reaches others but is never a component_id unless nothing else is (then component_id is null and the row kept).
    Other columns of docs, whatever their names, are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    every = scratch.keep(sketched(docs, id_col, text_col, k, bands, rows), "rows")
    # the row whose text stands for the class; of all rows with a null id only where there is no other
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("own")
    classes = scratch.keep(every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), own, F.count("*").alias("class_size"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    many = buckets.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).where("members > 1")
    members = scratch.keep(buckets.join(many, "bucket"), "members")

    # one text for each node: rows that repeat both id and text fall together
    candidates = members.select("node").distinct().join(classes.select("node", F.col("own.doc_id").alias("own_id"), F.col("own.text_key").alias("own_key")), "node")
    text = keyed(docs, id_col, text_col).where("text is not null")
    texts = scratch.keep(text.join(candidates, (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("node", "text").distinct(), "texts")

    pairs = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = scratch.keep(verified(pairs, texts, k, percent), "links")
    roots = scratch.keep(components(scratch, links, "first"), "roots")
    rest = members.where("members > 2 and node <> pivot").select("bucket", "node", "n_shingles")
    more = scratch.keep(rest_links(scratch, rest, texts, roots, k, percent), "more")
    if not more.isEmpty():
        roots = components(scratch, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "second")

    whole = classes.select("node", "class_size", F.col("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = whole.join(smallest, "root").select("node", "class_size", "component_id", "root")
    out = every.drop("bands").join(labels, "node", "left")
    # with n_shingles 0 there is no class
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = scratch.keep(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "text_key", "root"), "out")
    scratch.drop("rows", "classes", "members", "texts", "links", "roots", "labelled", "more")
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null ids are above all others) and, of several texts of that id, with the smallest SHA-256.

    Of rows that repeat id and text one stays, whichever. Rows without words are linked with nothing, so all of them stay. Columns stay as they are; an empty table stays empty.
    """
    id_, key = free_name(docs, "_dedup_id", "_dedup_key")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    found = near_duplicates(docs, id_col, text_col, k, percent).where("root IS NOT NULL")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    first = first.select(name(F.col("first.doc_id")).alias(id_), F.col("first.text_key").alias(key))
    text = F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.where(worded).withColumn(id_, name(F.col(id_col).cast("long"))).withColumn(key, F.unhex(F.sha2(text, 256)))
    return own.join(first, [id_, key], "left_semi").dropDuplicates([id_, key]).select(docs.columns).union(docs.where(~worded))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=4).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
