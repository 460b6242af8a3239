"""Merkle manifest of a table: one tree of digests per group of rows, and one over the groups' roots, with a proof for each row.

The leaves are range-partitioned by (group, order) and written; counts per piece (one group in one partition) give each leaf its place in its group. A task then streams a piece through a mountain range:
a stack with one run of nodes per level, where the third node of a run (or the last of its level, known from the group's size: short runs are hashed without padding) completes a peak, whose record is
carried to the level above. Nodes whose run crosses an edge of the piece are left open; open nodes of MERGE neighbouring pieces go through the same stack again, so a few rounds end in one root a group.
A round hands on a few nodes per level and piece, so none is large.

Proofs go down in blocks of SPAN levels: a block's own nodes and the path of its top give the paths of its bottom, so a row meets one block and not the whole tree.

Nulls: a null value hashes as `-`, a null group is a group of its own (before all others), null orders come first. Rows that repeat everything are leaves of their own, side by side. Texts are hashed by
Spark where they lie and go no further. An empty table has no root and gives no rows. Columns that are not named play no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, ship, table

FANOUT = 3
#: Pieces whose open nodes meet in one piece of the next round.
MERGE = 64
#: Levels of a block of proofs: 729 leaves, 364 nodes.
SPAN = 6

NODE = "g string, size long, piece long, level int, idx long, at long, hash string, kind int"
OPEN, INNER, TOP = 0, 1, 2


def leaf_of(*columns: str | Column) -> Column:
    """SHA-256 (lowercase hex) of the values one after another: `-` for null, else bytes in UTF-8, `:`, value."""
    parts = []
    for c in columns:
        v = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def of_level(size: int, level: int) -> int:
    """How many nodes a tree over so many leaves has at a level."""
    return -(-size // FANOUT**level)


class MountainRange:
    """The stack of one piece. Nodes come in order of place; done gets the records (level, idx, hash, kind)."""

    __slots__ = ("done", "runs", "size")

    def __init__(self, size: int):
        self.size, self.runs, self.done = size, {}, []

    def add(self, level: int, idx: int, h: str) -> None:
        while True:
            n = of_level(self.size, level)
            if n == 1:
                self.done.append((level, idx, h, TOP))
                return
            run = self.runs.get(level)
            if run is None:
                if idx % FANOUT:  # its run begins before this piece
                    self.done.append((level, idx, h, OPEN))
                    return
                run = self.runs[level] = []
            run.append((idx, h))
            if len(run) < FANOUT and idx < n - 1:
                return
            del self.runs[level]
            if level:
                self.done += [(level, i, x, INNER) for i, x in run]
            level, idx, h = level + 1, idx // FANOUT, digest(*(x for _, x in run))

    def rest(self) -> None:
        """What stays open at the end of the piece."""
        self.done += [(level, i, x, OPEN) for level, run in self.runs.items() for i, x in run]
        self.runs = {}


def _peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams nodes (g, size, piece, level, idx, hash), sorted by g, piece and place."""
    now, stack = None, None
    out: list[tuple] = []

    def take() -> None:
        g, size, piece = now
        out.extend((g, size, piece, level, i, i * FANOUT**level, h, kind) for level, i, h, kind in stack.done)
        stack.done.clear()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], ["g", "size", "piece", "level", "idx", "at", "hash", "kind"])

    for batch in batches:
        for g, size, piece, level, idx, h in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if now is None or now[2] != piece or now[0] != g:
                if now is not None:
                    stack.rest()
                    take()
                now, stack = (g, size, piece), MountainRange(size)
            stack.add(level, idx, h)
        if now is not None:
            take()
        yield flush()
    if now is not None:
        stack.rest()
        take()
        yield flush()


def _ordered(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.repartition(n, "g", "piece").sortWithinPartitions("g", "piece", "at")


class Forest:
    """The trees of a table of leaves. leaves: (g string, leaf string, and others); trees are by g, leaves of a tree ascend by `order`.

    rows: the leaves with size (of their tree) and idx; nodes: records of all levels above the leaves, tops included; roots: (g, size, root)."""

    def __init__(self, leaves: DataFrame, order: list[str], scratch: Scratch, name: str):
        spark = leaves.sparkSession
        ship(spark)
        self.scratch, self.name = scratch, name
        keys = [F.col("g"), *map(F.col, order), F.col("leaf")]
        kept = scratch.keep(leaves, f"{name}-leaves")  # so that sampling for the ranges does not hash the texts again
        self.partitions = n = scratch.partitions(f"{name}-leaves", 64 << 20)
        placed = scratch.keep(kept.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), f"{name}-placed")
        placed = placed.withColumn("piece", F.shiftright("_id", 33))
        before = Window.partitionBy("g").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = placed.groupBy("g", "piece").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        pieces = pieces.select("g", "piece", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("g")).alias("size"))
        self.rows = scratch.keep(placed.join(pieces, ["g", "piece"]).withColumn("idx", F.col("_id") + F.col("_shift")).drop("_id", "_shift"), f"{name}-rows")
        scratch.drop(f"{name}-leaves", f"{name}-placed")

        todo, pieces, rounds = self.rows.select("g", "size", "piece", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash"), F.col("idx").alias("at")), n, []
        while True:
            part = scratch.keep(_ordered(todo, n).mapInArrow(_peaks, NODE), f"{name}-peaks{len(rounds)}")
            rounds.append(part.where(F.col("kind") != OPEN))
            if pieces == 1:
                break
            pieces, n = -(-pieces // MERGE), max(1, -(-n // MERGE), spark.sparkContext.defaultParallelism)
            todo = part.where(F.col("kind") == OPEN).select("g", "size", F.floor(F.col("piece") / MERGE).alias("piece"), "level", "idx", "hash", "at")
        self.nodes = rounds[0]
        for part in rounds[1:]:
            self.nodes = self.nodes.unionByName(part)
        self.roots = self.nodes.where(F.col("kind") == TOP).select("g", "size", F.col("hash").alias("root"))

    def proofs(self, above: DataFrame, *carried: str) -> DataFrame:
        """above(g, top, proof): what each tree's root is part of. Gives g, idx, leaf, top, proof and the carried columns of each row. A proof is one `left,right` (digests
        of the run's nodes before and after) per level, joined by `;`, from the leaf up."""
        spark = self.rows.sparkSession
        most = self.rows.agg(F.max("size")).first()[0] or 1
        height = 0
        while of_level(most, height) > 1:
            height += 1
        plain = [F.lit(None).cast(self.rows.schema[c].dataType).alias(c) for c in carried]
        sized = self.roots.select("g", "size").join(above, "g")
        upper, schema = None, "g string, idx long, size long, leaf string, top string, proof string"
        for r in range(max(1, -(-height // SPAN)) - 1, -1, -1):
            low, high = r * SPAN, (r + 1) * SPAN
            tops = sized.where(F.col("size") <= FANOUT**high).select("g", F.lit(0).cast("long").alias("block"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("idx"), "size", F.lit(None).cast("string").alias("hash"), "top", "proof")
            if upper is not None:
                tops = tops.unionByName(upper.where(F.col("size") > FANOUT**high).select("g", F.col("idx").alias("block"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("idx"), "size", F.lit(None).cast("string").alias("hash"), "top", "proof"))
            none = [F.lit(None).cast("string").alias("top"), F.lit(None).cast("string").alias("proof")]
            inner = self.nodes.where(F.col("level").between(low + 1, high - 1)).select("g", F.floor(F.col("at") / FANOUT**high).alias("block"), (high - F.col("level")).alias("ord"), "idx", "size", "hash", *none)
            if r:
                items = self.nodes.where(F.col("level") == low).select("g", F.floor(F.col("at") / FANOUT**high).alias("block"), F.lit(SPAN).alias("ord"), "idx", "size", "hash", *none, *plain)
            else:
                items = self.rows.select("g", F.floor(F.col("idx") / FANOUT**high).alias("block"), F.lit(SPAN).alias("ord"), "idx", "size", F.col("leaf").alias("hash"), *none, *carried)
            every = tops.select("*", *plain).unionByName(inner.select("*", *plain)).unionByName(items)
            kinds = "".join(f", `{c}` {self.rows.schema[c].dataType.simpleString()}" for c in carried)
            found = every.repartition(max(self.partitions, spark.sparkContext.defaultParallelism), "g", "block").sortWithinPartitions("g", "block", "ord", "idx").mapInArrow(_paths(low, high, len(carried)), schema + kinds)
            upper = self.scratch.keep(found, f"{self.name}-paths{r}") if r else found
        return upper.drop("size")


def _paths(low: int, high: int, carried: int):
    """Streams blocks: the path of a block's top, its inner nodes from above, its items; a path is the run's other nodes, then the path of the run's parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, held = None, {}, []
        base, top, size, level_of_held = "", "", 1, None
        out: list[tuple] = []

        def settle() -> None:
            """The held nodes are one whole run."""
            nonlocal held
            if not held:
                return
            level = level_of_held
            up = known.get((level + 1, held[0][1] // FANOUT), base)
            alone = of_level(size, level) == 1
            hashes = [x[2] for x in held]
            for k, (g, idx, h, rest) in enumerate(held):
                own = up if alone else f"{''.join(hashes[:k])},{''.join(hashes[k + 1 :])}" + (f";{up}" if up else "")
                if level == low:
                    out.append((g, idx, size, h, top, own, *rest))
                else:
                    known[level, idx] = own
            held = []

        for batch in batches:
            types = [batch.schema.field(8 + k).type for k in range(carried)]
            names = ["g", "idx", "size", "leaf", "top", "proof", *(batch.schema.field(8 + k).name for k in range(carried))]
            for g, block, order, idx, n, h, at, path, *rest in zip(*(batch.column(k).to_pylist() for k in range(8 + carried)), strict=True):
                if now != (g, block):
                    settle()
                    now, known = (g, block), {}
                if order == 0:
                    base, top, size = path, at, n
                    continue
                level = high - order
                if held and (level != level_of_held or held[0][1] // FANOUT != idx // FANOUT):
                    settle()
                level_of_held = level
                held.append((g, idx, h, rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *types], strict=True)], names)
                out = []
        settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *types], strict=True)], names)

    return run


def group_key(column: str) -> Column:
    """A group as a key that is never null and sorts as the groups do: null first, then by bytes."""
    c = F.col(column).cast("string")
    return F.coalesce(F.concat(F.lit(":"), c), F.lit("-"))


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, **more: Column) -> DataFrame:
    """(order column, leaf, subroot, root, proof, and the columns of `more`, which are computed from docs) of every row: a leaf is leaf_of(columns), trees are by `group`, ascending by `order`."""
    scratch = Scratch(docs.sparkSession, "merkle")
    leaves = docs.select(group_key(group).alias("g"), F.col(order).cast("long").alias("id"), leaf_of(*columns).alias("leaf"), *(c.alias(k) for k, c in more.items()))
    trees = Forest(leaves, ["id"], scratch, "rows")
    over = Forest(trees.roots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("root").alias("leaf")), ["key"], scratch, "groups")
    root = over.roots.first()
    start = over.roots.select("g", F.lit("").alias("top"), F.lit("").alias("proof"))
    above = scratch.keep(over.proofs(start, "key").select(F.col("key").alias("g"), F.col("leaf").alias("top"), "proof"), "above")
    found = trees.proofs(above, "id", *more)
    return found.select(F.col("id").alias(order), "leaf", F.col("top").alias("subroot"), F.lit(root.root if root else None).cast("string").alias("root"), "proof", *more)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    step = lambda h, x: F.sha2(F.concat(F.substring_index(x, ",", 1), h, F.substring_index(x, ",", -1)), 256)
    return F.when(proof == "", leaf).otherwise(F.aggregate(F.split(proof, ";"), leaf, step))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents in a tree of its source, and what folding gives where line feeds were taken out of the text."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    changed = F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)), F.translate("text", "\n", "")).otherwise(F.col("text"))
    own = manifest(docs, [*fields, "text"], "source", "doc_id", other=leaf_of(*fields, changed))
    proof = F.sha2(F.translate("proof", ",;", ""), 256)
    found = own.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("other"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a text in DuckDB, which has none: bit by bit over the bytes' hex digits.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({s}))), lambda k: (strpos('0123456789ABCDEF', substr(hex({s}), (2 * k + 1)::BIGINT, 1)) - 1) * 16
+ strpos('0123456789ABCDEF', substr(hex({s}), (2 * k + 2)::BIGINT, 1)) - 1)), lambda c, b: list_reduce(list_prepend(xor(c, b::BIGINT), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _levels(first: str, name: str, levels: int) -> str:
    """SQL of the trees of the table `first` (g, i, h), one table per level: a tree of one node stays as it is."""
    out = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {first})"]
    for k in range(1, levels + 1):
        out.append(f"{name}{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i // 3 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k - 1} GROUP BY g, i // 3))")
    return ",\n".join(out)


def _climb(name: str, levels: int, start: str, upper: str) -> str:
    """SQL that folds `start` (id, g, i, f, p) up the levels: f the folded digest, p the siblings so far."""
    out, last = [], start
    for k in range(levels):
        out.append(f"""{upper}{k} AS (SELECT r.id, r.g, r.i // 3 AS i, CASE WHEN max(s.n) = 1 THEN max(r.f) ELSE sha256(string_agg(CASE WHEN s.i = r.i THEN r.f ELSE s.h END, '' ORDER BY s.i)) END AS f,
            max(r.p) || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (WHERE s.i <> r.i), '') AS p FROM {last} r JOIN {name}{k} s ON r.g = s.g AND r.i // 3 = s.i // 3 GROUP BY r.id, r.g, r.i)""")
        last = f"{upper}{k}"
    return ",\n".join(out)


def _sql(levels: int = 11) -> str:
    """Trees of up to 3^levels rows a source."""
    parts = lambda text: " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    changed = f"(CASE WHEN {CRC32_SQL.format(s='doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)"
    return f"""WITH d AS (SELECT doc_id, coalesce(':' || source, '-') AS g, sha256({parts('text')}) AS h, sha256({parts(changed)}) AS f FROM documents),
    r AS (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, h) AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
    {_levels('r', 't', levels)},
    own AS (SELECT id, g, i, f, '' AS p FROM r), {_climb('t', levels, 'own', 'c')},
    tops AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, g AS key FROM t{levels}), {_levels('tops', 'u', levels)},
    own2 AS (SELECT c.id, '' AS g, o.i, c.f, c.p FROM c{levels - 1} c JOIN tops o ON c.g = o.key), {_climb('u', levels, 'own2', 'e')}
    SELECT r.doc_id, r.h AS leaf, o.h AS subroot, z.h AS root, sha256(e.p) AS proof_sha256, e.f AS folded_root, e.f = z.h AS verified
    FROM r JOIN tops o ON r.g = o.key JOIN e{levels - 1} e USING (id), u{levels} z"""


OP13_SQL = _sql()
