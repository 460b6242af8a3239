"""Results by content (RUL-13, SRC-12): what a rule finds in a text is kept under the hash of the text and the hash of the rule, and never computed twice.

Three tables, all in buckets of the text's hash, so that they meet without an exchange: places (where a text stands), texts (each once, in one folder for each load), found (matches by rule). A run first
looks at hashes alone: which texts lack which of its rules. Only those texts are read, only in the folders of the loads they came with, and only for the rules they lack. A new or changed rule so invalidates
itself alone; a pack that is read again (hot reload) with nothing changed computes nothing. A run counts once its rows are written and its number stands in `runs`, the last write of all: what a broken run
left is not seen by any later one.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.rules import forbidden_matches
from auditlake.operators.scan import constant
from auditlake.sources.packs import quoted

_TABLES = {
    "places": "text_hash string, doc_id {id}, section_type string, ord int",
    "texts": "text_hash string, content string, load int",
    "seen": "text_hash string, run string",
    "found": "text_hash string, rule_hash string, run string, start int, matched string, line_no int, text string",
}


def text_hash(c: str | Column) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def rule_hash() -> Column:
    """Of what decides the matches of a forbidden rule: its pattern and where it does not count."""
    return F.sha2(F.concat_ws("\x00", F.coalesce("pattern", quoted("target")), F.to_json(F.coalesce("exclude_contexts", F.array().cast("array<string>")))), 256)


class Results:
    """A store in a folder that all executors share. `last` tells what the latest run did: texts and rules evaluated."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, doc_id: str = "long"):
        self.spark, self.folder, self.last = spark, folder, {}
        self.buckets = buckets
        self.name = f"results_{hashlib.md5(folder.encode()).hexdigest()[:12]}"
        for table, columns in _TABLES.items():
            apart = " PARTITIONED BY (load)" if table == "texts" else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns.format(id=doc_id)}) USING parquet{apart} CLUSTERED BY (text_hash) SORTED BY (text_hash) INTO {buckets} BUCKETS LOCATION '{folder}/{table}'")
        if self._exists("texts"):  # loads of another session
            spark.sql(f"MSCK REPAIR TABLE {self.name}_texts")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def _append(self, df: DataFrame, name: str) -> None:
        """One file for each bucket (and load)."""
        own = df.select(self.table(name).columns).repartition(self.buckets, "text_hash").sortWithinPartitions("text_hash")
        writer = own.write.mode("append").format("parquet").bucketBy(self.buckets, "text_hash").sortBy("text_hash").option("path", f"{self.folder}/{name}")
        (writer.partitionBy("load") if name == "texts" else writer).saveAsTable(f"{self.name}_{name}")

    def _runs(self) -> dict[str, set[str]]:
        """Rules that a finished run had evaluated when it was over, for all its texts."""
        if not self._exists("runs"):
            return {}
        return {r.run: set(r.rules) for r in self.spark.read.schema("run string, rules array<string>").parquet(f"{self.folder}/runs").collect()}

    def put(self, sections: DataFrame) -> None:
        """Adds sections(doc_id, section_type, content[, ord]): their places, and the texts that are not there yet. Null texts match nothing and are left out."""
        own = sections.where(F.col("content").isNotNull()).withColumn("text_hash", text_hash("content"))
        own = own if "ord" in own.columns else own.withColumn("ord", F.lit(0))
        there = self.table("texts")
        load = (there.agg(F.max("load")).first()[0] or 0) + 1
        new = own.groupBy("text_hash").agg(F.any_value("content").alias("content")).join(there.select("text_hash"), "text_hash", "left_anti")
        self._append(new.withColumn("load", F.lit(load)), "texts")
        self._append(own, "places")

    def lacking(self, hashes: list[str]) -> DataFrame:
        """(text_hash, load, rules): texts and which of the rules they lack. Reads hashes only."""
        runs = {k: sorted(v & set(hashes)) for k, v in self._runs().items()}
        known = constant([{"run": k, "rules": v} for k, v in runs.items()], "array<struct<run:string,rules:array<string>>>")
        seen = self.table("seen").groupBy("text_hash").agg(F.collect_set("run").alias("_runs"))
        both = self.table("texts").select("text_hash", "load").join(seen, "text_hash", "left")
        done = F.flatten(F.transform(F.filter(known, lambda r: F.array_contains(F.coalesce("_runs", F.array().cast("array<string>")), r["run"])), lambda r: r["rules"]))
        return both.select("text_hash", "load", F.array_except(constant(hashes, "array<string>"), done).alias("rules")).where(F.size("rules") > 0)

    def run(self, rules: DataFrame) -> DataFrame:
        """Matches of the forbidden rules at all places, as rules.forbidden_matches gives them: what is known is read, the rest is computed and kept."""
        own = rules.where("type = 'forbidden'").withColumn("rule_hash", rule_hash())
        hashes = sorted({r.rule_hash for r in own.select("rule_hash").collect()})
        todo = self.lacking(hashes)
        texts, loads, missing = (lambda r: (r[0], r[1], r[2]))(todo.agg(F.count("*"), F.collect_set("load"), F.array_distinct(F.flatten(F.collect_set("rules")))).first())
        self.last = {"texts": texts, "rules": len(missing or []), "loads": sorted(loads or [])}
        if texts:
            self._evaluate(own.where(F.col("rule_hash").isin(missing)), todo, loads, hashes)
        finished = constant(sorted(self._runs()), "array<string>")
        found = self.table("found").where(F.array_contains(finished, F.col("run"))).drop("run")
        wanted = own.drop("type").withColumn("type", F.lit("forbidden")).select(*rules.columns, "rule_hash")
        at = found.join(F.broadcast(wanted), "rule_hash").drop("rule_hash")  # a pack
        return self.table("places").select("text_hash", "doc_id", "section_type").join(at, "text_hash").select("doc_id", "section_type", *rules.columns, "start", "matched", "line_no", "text")

    def _evaluate(self, rules: DataFrame, todo: DataFrame, loads: list[int], hashes: list[str]) -> None:
        run = uuid.uuid4().hex
        once = rules.dropDuplicates(["rule_hash"])
        texts = self.table("texts").where(F.col("load").isin(loads)).join(todo.select("text_hash", "rules"), "text_hash")
        as_sections = texts.select(F.struct("text_hash", "rules").alias("doc_id"), F.lit("").alias("section_type"), "content")
        found = forbidden_matches(as_sections, once.drop("rule_hash")).join(F.broadcast(once.select("rule_seq", "rule_hash")), "rule_seq")
        found = found.where(F.array_contains("doc_id.rules", F.col("rule_hash"))).select(F.col("doc_id.text_hash").alias("text_hash"), "rule_hash", F.lit(run).alias("run"), "start", "matched", "line_no", "text")
        self._append(found, "found")
        self._append(todo.select("text_hash", F.lit(run).alias("run")), "seen")
        self.spark.createDataFrame([(run, hashes)], "run string, rules array<string>").coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
