"""Rule sets: differences, upserts, versions, comparison of files (SYN-*, SET-*)."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.text import short_id, valid_rule_id

COMPARED = ["platform", "rule_type", "target", "description", "enabled", "mandatory"]


def versions_diff(old: DataFrame, new: DataFrame, compared: list[str] | None = None, key: str = "rule_id") -> DataFrame:
    """SET-6 / JOI-8: (key, status added|removed|changed, fields array<struct<field, old, new>>); equal ones are left out."""
    names = compared or COMPARED
    a = old.select(key, F.struct(*names).alias("a"))
    b = new.select(key, F.struct(*names).alias("b"))
    both = a.join(b, key, "full_outer")
    pair = lambda c: F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("old"), F.col(f"b.{c}").cast("string").alias("new")))
    fields = F.filter(F.array(*map(pair, names)), lambda x: x.isNotNull())
    status = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.size(fields) > 0, "changed")
    return both.select(key, status.alias("status"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), fields).otherwise(F.array().cast("array<struct<field:string,old:string,new:string>>")).alias("fields")).where("status IS NOT NULL")


def with_ids(rows: DataFrame, prefix: str = "AUTO-") -> DataFrame:
    """FN-18: rows without a rule id get one from platform, code and target."""
    made = short_id(prefix, F.concat_ws("|", "platform", "platform_code", "target"))
    return rows.withColumn("rule_id", F.coalesce(F.nullif("rule_id", F.lit("")), made))


def upserted(current: DataFrame, incoming: DataFrame, key: str = "rule_id", order: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """SYN-2: (rules after the import, counts of new and updated, rejected with a reason). Of rows with one id the last wins; it counts as new once and as updated for each later row. Ids of a
    wrong form are rejected (FN-19)."""
    ok = incoming.where(valid_rule_id(key))
    last = ok.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
    after = current.join(last.select(key), key, "left_anti").unionByName(last.drop(order).select(current.columns))
    times = ok.groupBy(key).agg(F.count("*").alias("n")).join(current.select(key).distinct().withColumn("_there", F.lit(1)), key, "left")
    counts = times.agg(F.coalesce(F.count_if(F.expr("_there IS NULL")), F.lit(0)).alias("new_rules"), F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("updated_rules"))
    return after, counts, incoming.where(~valid_rule_id(key)).withColumn("reason", F.lit("rule_id"))


def synced(current: DataFrame, remote: DataFrame, platform: str) -> tuple[DataFrame, DataFrame]:
    """SYN-1: remote(rule_id, platform_code, ...) of a platform -> (rules, counts): new ones are added, those there updated, those of the platform that are not remote any more disabled."""
    r = remote.withColumn("_remote", F.lit(True))
    mine = current.where(F.col("platform") == platform)
    others = current.where(F.col("platform") != platform)
    names = current.columns
    both = mine.select(F.struct(*names).alias("a"), "rule_id").join(r.select(F.struct(*[c for c in names if c in remote.columns]).alias("b"), "rule_id", "_remote"), "rule_id", "full_outer")
    action = F.when(F.col("a").isNull(), "new").when(F.col("_remote"), "updated").when(F.col("a.enabled"), "disabled").otherwise("kept")
    both = both.withColumn("action", action)
    value = lambda c: (F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in remote.columns else F.col(f"a.{c}"))
    cols = [(F.when(F.col("action") == "disabled", False).when(F.col("action") == "kept", F.col("a.enabled")).otherwise(True) if c == "enabled" else F.lit(platform) if c == "platform" else F.col("rule_id") if c == "rule_id" else value(c)).alias(c) for c in names]
    counts = both.agg(*(F.count_if(F.col("action") == x).alias(f"{x}_rules") for x in ("new", "updated", "disabled")))
    return others.unionByName(both.select(*cols)), counts


def searched(rules: DataFrame, query: str) -> DataFrame:
    """SYN-3: rules with a text in one of four columns, whatever its case."""
    q = F.lower(F.lit(query))
    hit = F.lit(False)
    for c in ("rule_id", "platform", "target", "description"):
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return rules.where(hit)


def toggled(rules: DataFrame, ids: list[str], enabled: bool | None = None) -> DataFrame:
    """SYN-3: enabled set, or turned over where it is None, for some ids."""
    new = ~F.col("enabled") if enabled is None else F.lit(enabled)
    return rules.withColumn("enabled", F.when(F.col("rule_id").isin(ids), new).otherwise(F.col("enabled")))


def without(rules: DataFrame, ids: list[str]) -> DataFrame:
    return rules.where(~F.col("rule_id").isin(ids))


def platforms(rules: DataFrame) -> DataFrame:
    return rules.select("platform").where("platform <> ''").distinct().orderBy("platform")


def drafted(feedback: DataFrame, rules: DataFrame) -> DataFrame:
    """SYN-4: feedback(platform, platform_code, description) of pairs that no rule has, each once, as disabled drafts."""
    own = feedback.groupBy("platform", "platform_code").agg(F.min("description").alias("description"))
    new = own.join(rules.select("platform", "platform_code"), ["platform", "platform_code"], "left_anti")
    return new.withColumn("rule_id", short_id("UFB-", F.concat_ws("|", "platform", "platform_code"))).withColumn("enabled", F.lit(False))


def kept_versions(versions: DataFrame, n: int = 10) -> DataFrame:
    """SYN-5: rows of the last n versions. Versions are few; rules may be many."""
    last = versions.select("version").distinct().orderBy(F.col("version").desc()).limit(n)
    return versions.join(F.broadcast(last), "version", "left_semi")


def rolled_back(versions: DataFrame, version: str) -> DataFrame:
    """SYN-5: the rules of a version, or of the latest."""
    if version == "latest":
        return versions.join(F.broadcast(versions.agg(F.max("version").alias("version"))), "version", "left_semi").drop("version")
    return versions.where(F.col("version") == version).drop("version")


def files_compared(sections: DataFrame, a: int, b: int) -> DataFrame:
    """SET-3: (section_type, side both|only_in_a|only_in_b) of two documents."""
    own = sections.where(F.col("doc_id").isin(a, b)).groupBy("section_type").agg(F.max(F.col("doc_id") == a).alias("_a"), F.max(F.col("doc_id") == b).alias("_b"))
    return own.select("section_type", F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_in_a").otherwise("only_in_b").alias("side"))


def score_deltas(reports: DataFrame, a: int, b: int, scores: list[str]) -> DataFrame:
    """SET-3: the latest report of each of two files, and b - a of each score."""
    last = lambda f, name: reports.where(F.col("file_id") == f).groupBy().agg(F.max_by(F.struct(*scores), F.struct("created_at", "report_id")).alias(name))
    both = last(a, "a").crossJoin(last(b, "b"))
    return both.select(*(x for c in scores for x in (F.col(f"a.{c}").alias(f"{c}_a"), F.col(f"b.{c}").alias(f"{c}_b"), (F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"{c}_delta"))))


HISTORY = "job string, started timestamp, finished timestamp, tries int, ok boolean, error string"


def run_job(spark: SparkSession, job: str, action: Callable[[], None], history: str, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> bool:
    """SYN-6 / SRC-17: one run of a scheduled job: a failed action is tried again after 1, 2, 4, ... seconds; the outcome is appended to the history, and told. The schedule is outside."""
    started, error = datetime.now(), None
    for n in range(tries):
        try:
            action()
            error = None
            break
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
            if n + 1 < tries:
                wait(2.0**n)
    spark.createDataFrame([(job, started, datetime.now(), n + 1, error is None, error)], HISTORY).write.mode("append").parquet(history)
    return error is None


def job_history(spark: SparkSession, history: str, job: str | None = None, n: int = 50) -> DataFrame:
    """SYN-6: the last n runs, newest first."""
    own = spark.read.schema(HISTORY).parquet(history)
    own = own if job is None else own.where(F.col("job") == job)
    return own.orderBy(F.col("finished").desc()).limit(n)
