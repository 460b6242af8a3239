"""Queries over what is kept between runs: results by content, versions of rules, pages of a service, stored reports; and the SQL surface."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import sql as surface
from auditlake.operators import rules, stats
from auditlake.operators.results import Results
from auditlake.operators.versions import Versions
from auditlake.plans import demo
from auditlake.plans.demo import pack, query, sections, t
from auditlake.session import new_folder
from auditlake.sources import documents, paged
from auditlake.streaming.state import run_available


@query(demo.SQL["forbidden_hits"])
def matches_by_content(spark: SparkSession, d: str) -> DataFrame:
    """RUL-13, SRC-12: a first load under half of the rules, then all texts under all rules: only what is missing is computed"""
    store = Results(spark, new_folder(spark, "results"), 8)
    own = sections(spark, d)
    store.put(own.where("doc_id % 2 = 0"))
    store.run(pack(spark).where("rule_seq % 2 = 0"))
    store.put(own.where("doc_id % 2 <> 0"))
    return store.run(pack(spark)).groupBy("doc_id", "rule_seq", "rule_id").agg(F.count("*").alias("hits"))


def _version(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Rules of version k: every (k + 2)th part is not there, every 3rd of the others is renamed from version 2 on, every 5th is not enabled in version 3."""
    p = t(spark, d, "part").where(F.col("p_partkey") % (k + 2) != 0)
    name = F.when((F.col("p_partkey") % 3 == 0) & F.lit(k >= 2), F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_brand").alias("platform"), name.alias("description"), (~((F.col("p_partkey") % 5 == 0) & F.lit(k == 3))).alias("enabled"))


def _versions(spark: SparkSession, d: str, n: int) -> Versions:
    log = Versions(spark, new_folder(spark, "versions"), "rule_id string, platform string, description string, enabled boolean")
    for k in range(1, n + 1):
        log.commit(_version(spark, d, k))
    return log


def _version_sql(k: int) -> str:
    name = "CASE WHEN p_partkey % 3 = 0 THEN p_name || ' new' ELSE p_name END" if k >= 2 else "p_name"
    return f"SELECT CAST(p_partkey AS VARCHAR) AS rule_id, p_brand AS platform, {name} AS description, {'p_partkey % 5 <> 0' if k == 3 else 'true'} AS enabled FROM part WHERE p_partkey % {k + 2} <> 0"


@query(_version_sql(2))
def rules_at_version(spark: SparkSession, d: str) -> DataFrame:
    """SYN-5: a version in the middle, folded from the log"""
    return _versions(spark, d, 4).at(2)


@query(_version_sql(2))
def rules_rolled_back(spark: SparkSession, d: str) -> DataFrame:
    """SYN-5: gone back to version 2, then old versions folded together"""
    log = _versions(spark, d, 3)
    log.rollback(2)
    log.compact(2)
    return log.at()


_CHANGES = " UNION ALL ".join(
    f"""SELECT {k} AS version, count(*) FILTER (a.rule_id IS NULL) AS added, count(*) FILTER (a.rule_id IS NOT NULL AND b.rule_id IS NOT NULL AND a IS DISTINCT FROM b AND NOT (a.enabled AND NOT b.enabled)) AS changed,
    count(*) FILTER (b.rule_id IS NULL) AS removed, count(*) FILTER (a.enabled AND NOT b.enabled) AS disabled FROM ({_version_sql(k - 1) if k > 1 else _version_sql(1) + " AND false"}) a FULL JOIN ({_version_sql(k)}) b ON a.rule_id = b.rule_id"""
    for k in (1, 2, 3)
)


@query(_CHANGES)
def rule_history(spark: SparkSession, d: str) -> DataFrame:
    """SYN-1, SYN-2: what each version changed, counted from the log"""
    return _versions(spark, d, 3).history()


PAGE = 50


def _service(spark: SparkSession, d: str):
    """The rows of part as pages of a service: files of JSON, one for each page; the third page fails twice. Keys are dealt to pages by hash, so that gaps between keys leave no page empty."""
    folder = new_folder(spark, "service")
    row = F.to_json(F.struct("p_partkey", "p_name", "p_size"), {"ignoreNullFields": "false"})
    own = t(spark, d, "part")
    n = -(-own.select("p_partkey").distinct().count() // PAGE)
    pages = own.select(F.pmod(F.xxhash64("p_partkey"), F.lit(max(n, 1))).cast("int").alias("page"), row.alias("row"))
    pages.repartition("page").write.partitionBy("page").text(f"{folder}/pages")
    local = urlparse(folder).path

    def fetch(page: int):
        if page == 2:
            tries = [x for x in os.listdir(local) if x.startswith("failed")]
            if len(tries) < 2:
                with open(f"{local}/failed{len(tries)}", "w"):
                    raise OSError("503")
        at = f"{local}/pages/page={page}"
        if not os.path.isdir(at):
            return None
        found = []
        for name in sorted(os.listdir(at)):
            if name.endswith(".txt"):
                with open(f"{at}/{name}", encoding="utf-8") as f:
                    found += [tuple(json.loads(x).values()) for x in f]
        return found

    return fetch, n


@query("SELECT p_partkey, p_name, p_size FROM part")
def service_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17: pages in parallel, with tries"""
    fetch, n = _service(spark, d)
    return paged.read_pages(spark, "part_service", "p_partkey bigint, p_name string, p_size int", fetch, n, pause=0.01)


@query("SELECT p_partkey, p_name, p_size FROM part")
def service_stream(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17 as a stream: pages as offsets"""
    fetch, _ = _service(spark, d)
    folder = new_folder(spark, "stream")
    own = paged.stream_pages(spark, "part_feed", "p_partkey bigint, p_name string, p_size int", fetch, pause=0.01)
    run_available(own, lambda b, k: b.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    found = rules.forbidden(sections(spark, d), pack(spark))
    entry = F.struct("rule_id", F.element_at(F.split("location", " ~"), 1).alias("section"), "risk_level", "description")
    own = t(spark, d, "documents").select("doc_id").join(found.groupBy("doc_id").agg(F.collect_list(entry).alias("rule_violations")), "doc_id", "left")
    folder = new_folder(spark, "reports")
    documents.write_reports(own, folder)
    return spark.read.parquet(folder)


@query(f"WITH {demo._HITS} SELECT rule_id, count(*) AS hit_count, (SELECT count(*) FROM documents) AS total_reports, round_even(count(*) / (SELECT count(*) FROM documents), 3) AS hit_rate FROM forb GROUP BY rule_id")
def effectiveness_of_stored(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1, AGG-2: rules of stored reports, out of their VARIANT"""
    return stats.rule_effectiveness(_stored(spark, d))


@query(f"WITH {demo._HITS} SELECT section_type AS section, count(*) AS total, {', '.join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in ('critical', 'high', 'medium', 'low'))} FROM forb GROUP BY 1")
def heatmap_of_stored(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1, AGG-13"""
    return stats.risk_heatmap(stats.violations_of(_stored(spark, d)))


_WORDS = "idiot|moron|stupid"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no::INTEGER AS line_no, CAST(len(regexp_extract_all(line, '(?i){_WORDS}')) AS BIGINT) AS n, sha256({demo._NORM.format("line")})[1:16] AS line_hash FROM l WHERE regexp_matches(line, '(?i){_WORDS}')"""
)
def matches_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """2.14: SQL alone: lines of texts and a pack's matches in them, by LATERAL"""
    surface.register(spark, pack(spark).where("rule_seq = 9"))
    t(spark, d, "documents").createOrReplaceTempView("audit_documents")
    return spark.sql(
        """SELECT d.doc_id, l.line_no, count(*) AS n, audit_text_hash(l.line) AS line_hash FROM audit_documents d, LATERAL audit_lines(d.text) l, LATERAL inline(audit_matches(l.line)) m GROUP BY d.doc_id, l.line_no, l.line"""
    )


@query(f"SELECT doc_id AS id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i){_WORDS}')) FROM documents) GROUP BY 1")
def match_rows_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """2.14: the Arrow table function over a whole table"""
    surface.register(spark, pack(spark).where("rule_seq = 9"))
    t(spark, d, "documents").createOrReplaceTempView("audit_documents")
    return spark.sql("SELECT id, count(*) AS n FROM audit_match_rows(TABLE(SELECT doc_id, text FROM audit_documents)) GROUP BY id")
