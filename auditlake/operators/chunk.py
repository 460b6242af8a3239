"""Packing of sections into prompts (CHK-*)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import col, let, section_name, tokens_estimate

OVERLAP_RATIO, OVERLAP_MIN, OVERLAP_MAX = 0.15, 200, 800
DEGRADE = 5


def sampled(name: Column | str, rate: float = 0.3) -> Column:
    """CHK-2: whether a section is in the sample, by the MD5 of its name."""
    return F.pmod(F.conv(F.substring(F.md5(col(name)), 1, 8), 16, 10).cast("long"), F.lit(1000)) / 1000 <= rate


def violated_sections(found: DataFrame, sections: DataFrame) -> DataFrame:
    """CHK-3: (doc_id, section_type) of sections named by findings of forbidden and keyword rules."""
    named = found.where("rule_type <> 'chapter_required'").select("doc_id", section_name("location").alias("section_type")).distinct()
    return sections.select("doc_id", "section_type").join(named, ["doc_id", "section_type"], "left_semi")


def selected(sections: DataFrame, violated: DataFrame, rate: float = 0.3) -> DataFrame:
    """CHK-2: all violated sections, a sample of the others; adds is_violated."""
    own = sections.join(violated.select("doc_id", "section_type").distinct().withColumn("_v", F.lit(True)), ["doc_id", "section_type"], "left").withColumn("is_violated", F.coalesce("_v", F.lit(False))).drop("_v")
    return own.where(F.col("is_violated") | sampled("section_type", rate))


def packed(sections: DataFrame, limit: int) -> DataFrame:
    """CHK-1: (doc_id, chunk_no, section_names, prompt): sections in order fill a chunk up to the limit (2 tokens a character); a section over it is cut into parts of
    limit / 2 characters, named `section(1)` and so on, each of which is a block like the others."""
    half = limit // 2
    block = lambda name, text: F.concat(F.lit("=== "), name, F.lit(" ===\n"), text, F.lit("\n\n"))
    sections = sections.select("doc_id", "ord", "section_type", block(F.col("section_type"), F.col("content")).alias("_whole"))
    whole = F.col("_whole")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / half).cast("int")), lambda i: F.struct(F.concat("section_type", F.lit("("), (i + 1).cast("string"), F.lit(")")).alias("name"), block(F.concat("section_type", F.lit("("), (i + 1).cast("string"), F.lit(")")), F.substring(whole, i * half + 1, F.lit(half))).alias("text")))
    parts = sections.withColumn("_b", F.when(F.length(whole) * 2 > limit, cut).otherwise(F.array(F.struct(F.col("section_type").alias("name"), whole.alias("text")))))
    blocks = parts.select("doc_id", "ord", F.posexplode("_b").alias("part", "b")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "part", F.col("b.name").alias("name"), F.col("b.text").alias("text")))).alias("blocks"))
    # the fold is over sizes alone: it gives each block the number of its chunk, and no text is copied on the way
    sizes = F.transform("blocks", lambda x: F.length(x["text"]) * 2)
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("of"))

    def step(acc: Column, n: Column) -> Column:
        flush = (acc["size"] + n > limit) & (F.size(acc["of"]) > 0)
        chunk = acc["chunk"] + flush.cast("int")
        return F.struct(F.when(flush, n).otherwise(acc["size"] + n).alias("size"), chunk.alias("chunk"), F.array_append(acc["of"], chunk).alias("of"))

    numbered = blocks.withColumn("_f", F.aggregate(sizes, start, step)).withColumn("_z", F.arrays_zip("blocks", F.col("_f.of").alias("of")))
    own = F.transform(F.sequence(F.lit(0), F.col("_f.chunk")), lambda k: F.transform(F.filter("_z", lambda z: z["of"] == k), lambda z: z["blocks"]))
    out = numbered.select("doc_id", F.posexplode(own).alias("chunk_no", "c"))
    part = lambda name, sep: F.array_join(F.transform("c", lambda x: x[name]), sep)
    return out.select("doc_id", "chunk_no", part("name", " + ").alias("section_names"), part("text", "").alias("prompt"))


def overlap_tail(prev: Column | str, limit: Column | int) -> Column:
    """CHK-5: the end of a text: clamp(limit * 0.15, 200, 800) / 2 characters, from after the first line feed if that is in the first half; '' for null."""
    c = F.coalesce(col(prev), F.lit(""))
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    n = F.ceil(F.least(F.greatest(F.lit(OVERLAP_MIN), lim * OVERLAP_RATIO), F.lit(OVERLAP_MAX)) / 2).cast("int")
    tail = F.right(c, n)
    at = F.instr(tail, F.lit("\n")) - 1
    return F.when(F.length(c) <= n, c).when((at > 0) & (at < F.floor(n / 2)), F.substring(tail, at + 2, n)).otherwise(tail)


def with_overlap(chunks: DataFrame, limit: int) -> DataFrame:
    """Adds the overlap with the chunk before, and its tokens."""
    prev = F.lag("prompt").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    return chunks.withColumn("overlap", overlap_tail(prev, limit)).withColumn("overlap_tokens", tokens_estimate("overlap"))


def affinity_of(pairs: DataFrame, affinity: DataFrame) -> DataFrame:
    """CHK-6: pairs(a, b) with w: the weight of either order, 0 if there is none."""
    w = affinity.groupBy("a", "b").agg(F.max("w").alias("w"))
    ab = pairs.join(F.broadcast(w), ["a", "b"], "left")
    return ab.join(F.broadcast(w.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("w").alias("_w"))), ["a", "b"], "left").withColumn("w", F.coalesce("w", "_w", F.lit(0.0))).drop("_w")


def ranked_candidates(pairs: DataFrame, affinity: DataFrame) -> DataFrame:
    """SRT-4: pairs(a, b, pos): candidates b of a by affinity, stable."""
    return affinity_of(pairs, affinity).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.col("w").desc(), "pos")))


def best_group(names: DataFrame, groups: DataFrame, default_limit: int) -> DataFrame:
    """CHK-7: names(key, section) -> (key, dimension, token_limit): the group with the largest sum of 3/2/1 by high/medium/low, the first on ties; `general` if none scores."""
    flat = None
    for c, w in (("sections_high", 3), ("sections_medium", 2), ("sections_low", 1)):
        one = groups.select("ord", "id", "token_limit_override", F.explode(c).alias("section"), F.lit(w).alias("points"))
        flat = one if flat is None else flat.union(one)
    flat = flat.groupBy("ord", "id", "token_limit_override", "section").agg(F.max("points").alias("points"))  # high counts before medium before low
    score = names.join(F.broadcast(flat), "section").groupBy("key", "ord", "id", "token_limit_override").agg(F.sum("points").alias("score"))
    best = score.groupBy("key").agg(F.max_by(F.struct("id", "token_limit_override"), F.struct(F.col("score"), -F.col("ord"))).alias("g"))
    out = names.select("key").distinct().join(best, "key", "left")
    return out.select("key", F.coalesce("g.id", F.lit("general")).alias("dimension"), F.greatest(F.lit(default_limit), F.coalesce("g.token_limit_override", F.lit(0))).alias("token_limit"))


def _packed_names(names: Column, limit: int) -> Column:
    """array<struct<name, size>> in order, filled into array<array<string>> up to the limit."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), none.alias("now"), F.lit(0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        flush = (acc["total"] + x["size"] > limit) & (F.size(acc["now"]) > 0)
        fresh = F.struct(F.array_append(acc["out"], acc["now"]).alias("out"), F.array(x["name"]).alias("now"), x["size"].alias("total"))
        more = F.struct(acc["out"].alias("out"), F.array_append(acc["now"], x["name"]).alias("now"), (acc["total"] + x["size"]).alias("total"))
        return F.when(flush, fresh).otherwise(more)

    return F.aggregate(names, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["out"], acc["now"])).otherwise(acc["out"]))


def _grown(seed: Column, rest: Column, near: Callable[[Column, Column], Column], limit: int) -> Column:
    """The cluster of a seed (struct<name, size>) among array<struct<name, size>> in order: array<string>."""
    ranked = F.array_sort(F.transform(rest, lambda x, i: F.struct((-near(seed["name"], x["name"])).alias("far"), i.alias("pos"), x["name"].alias("name"), x["size"].alias("size"))))
    start = F.struct(F.array(seed["name"]).alias("own"), seed["size"].alias("total"), F.lit(limit).alias("budget"))

    def step(acc: Column, x: Column) -> Column:
        total, wider = acc["total"] + x["size"], F.floor(acc["budget"] * 1.5).cast("int")
        taken = lambda budget: F.struct(F.array_append(acc["own"], x["name"]).alias("own"), total.alias("total"), budget.alias("budget"))
        return F.when(total <= acc["budget"], taken(acc["budget"])).when((x["far"] <= -0.8) & (total <= wider), taken(wider)).otherwise(acc)

    return F.aggregate(ranked, start, step, lambda acc: acc["own"])


def clustered(sections: DataFrame, seeds: DataFrame, affinity: dict[tuple[str, str], float], limit: int, degrade: int = DEGRADE) -> DataFrame:
    """CHK-4/8: (doc_id, chunk_no, sections array<string>): greedy clusters of a document's sections around seeds(doc_id, section_type, rank). A candidate joins by affinity while the budget
    lasts; from affinity 0.8 on the budget grows by half once for it. Sections that no cluster took form the last one. A document's sections are few: they are folded as one array of names and
    sizes. A name that repeats in a document counts once, at its first place and with its last size; a section without text has size 0 for it; rows without a name and documents without a seed are left out.
    """
    rank = seeds.groupBy("doc_id", "section_type").agg(F.min("rank").alias("rank"))
    size = (2 * (F.coalesce(F.length("content"), F.lit(0)) + F.length("section_type") + 11)).cast("int")
    named = sections.where(F.col("section_type").isNotNull()).select("doc_id", "section_type", "ord", size.alias("size"))
    once = named.groupBy("doc_id", "section_type").agg(F.min("ord").alias("ord"), F.max_by("size", F.struct("ord", "size")).alias("size"))
    joined = once.join(rank.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (once["section_type"] == rank["section_type"]), "left")
    rows = F.array_sort(F.collect_list(F.struct(F.col("ord"), once["section_type"].alias("name"), F.col("size"), F.col("rank"))))
    docs = joined.groupBy("doc_id").agg(rows.alias("every"))
    known = {f"{b}\0{a}": w for (a, b), w in affinity.items()} | {f"{a}\0{b}": w for (a, b), w in affinity.items()}
    weights = F.create_map(*[F.lit(x) for k, w in known.items() for x in (k, float(w))]) if known else None
    near = lambda a, b: F.lit(0.0) if weights is None else F.coalesce(weights[F.concat(a, F.lit("\0"), b)], F.lit(0.0))
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size")))
    chosen = F.filter("every", lambda x: x["rank"].isNotNull())
    by_rank = F.array_sort(F.transform(chosen, lambda x: F.struct(x["rank"].alias("rank"), x["ord"].alias("ord"), x["name"].alias("name"), x["size"].alias("size"))))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, seed: Column) -> Column:
        rest = F.filter(bare(F.col("every")), lambda x: ~F.array_contains(acc["taken"], x["name"]) & (x["name"] != seed["name"]))
        grown = let(_grown(seed, rest, near, limit), lambda own: F.struct(F.concat(acc["taken"], own).alias("taken"), F.array_append(acc["out"], own).alias("out")))
        return F.when(F.array_contains(acc["taken"], seed["name"]), acc).otherwise(grown)

    def finish(acc: Column) -> Column:
        left = F.array_except(F.transform("every", lambda x: x["name"]), acc["taken"])
        return F.when((F.size(acc["out"]) > 0) & (F.size(left) > 0), F.array_append(acc["out"], left)).otherwise(acc["out"])

    clusters = F.when(F.size("every") <= degrade, _packed_names(bare(chosen), limit)).otherwise(F.aggregate(by_rank, start, step, finish))
    return docs.select("doc_id", F.posexplode(clusters).alias("chunk_no", "sections"))


def routed_models(chunks: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    """CHK-9: chunks(dimension) with the model of their dimension, or the default one."""
    return chunks.join(F.broadcast(routes.select("dimension", "model")), "dimension", "left").withColumn("model", F.coalesce("model", F.lit(default)))


def models_used(routes: DataFrame, default: str) -> DataFrame:
    """The distinct models, the default one first."""
    own = routes.select("model").distinct().where(F.col("model") != default)
    return routes.sparkSession.createDataFrame([(0, default)], "pos int, model string").union(own.select(F.lit(1), "model")).orderBy("pos", "model").select("model")


def semantic_chunks(sections: DataFrame, clusters: DataFrame, groups: DataFrame, limit: int, template: str = "{text}") -> DataFrame:
    """CHK-8: clusters(doc_id, chunk_no, sections) -> (doc_id, chunk_no, section_names, dimension, token_budget, prompt, overlap_tokens): the sections' texts in the order of the cluster, in the
    template, after the end of the chunk before, cut to the budget of the chunk's dimension."""
    each = clusters.select("doc_id", "chunk_no", F.posexplode("sections").alias("pos", "section_type"))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))
    text = each.join(sections.select("doc_id", "section_type", "content"), ["doc_id", "section_type"])
    block = F.concat(F.lit("=== "), "section_type", F.lit(" ===\n"), "content", F.lit("\n\n"))
    own = F.array_sort(F.collect_list(F.struct("pos", "section_type", block.alias("b"))))
    whole = text.groupBy("doc_id", "chunk_no").agg(own.alias("_o")).select("doc_id", "chunk_no", F.array_join(F.transform("_o", lambda x: x["section_type"]), " + ").alias("section_names"), F.array_join(F.transform("_o", lambda x: x["b"]), "").alias("_text"))
    dims = best_group(each.select(key.alias("key"), F.col("section_type").alias("section")), groups, limit)
    out = whole.withColumn("key", key).join(dims, "key").drop("key").withColumnRenamed("token_limit", "token_budget")
    prev = F.lag("_text").over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    out = out.withColumn("_prev", prev).withColumn("_tail", overlap_tail("_prev", F.col("token_budget")))
    body = F.when(F.col("_tail") != "", F.concat(F.lit("【上文重叠】\n"), "_tail", F.lit("\n\n"), "_text")).otherwise(F.col("_text"))
    return out.withColumn("prompt", F.replace(F.lit(template), F.lit("{text}"), body)).withColumn("overlap_tokens", tokens_estimate("_tail")).select("doc_id", "chunk_no", "section_names", "dimension", "token_budget", "prompt", "overlap_tokens")
