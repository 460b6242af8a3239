"""Files -> lines and sections (SRC-1..7), and tables written and read (SNK-*, SRC-21)."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.text import strip
from auditlake.operators import label, segment
from auditlake.session import ship

SUPPORTED = ["pdf", "docx"]
MAX_BYTES = 50 << 20
STYLED_FROM = 3
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINES = "path string, line_no int, page int, text string, style string, is_table boolean"


def files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: (path, extension, length, content, file_hash) of every file under a path, through any file system that Spark reads (SRC-21)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1)).alias("extension"), "length", "content", F.sha2("content", 256).alias("file_hash"))


def accepted(raw: DataFrame, extensions: list[str] | None = None, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): unknown extension, empty, too large."""
    reason = F.when(~F.col("extension").isin(extensions or SUPPORTED), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > most, "size")
    own = raw.withColumn("reason", reason)
    return own.where("reason IS NULL").drop("reason"), own.where("reason IS NOT NULL").drop("content")


def docx_rows(content: bytes) -> list[tuple[str, str, bool]]:
    """(text, style, is_table) of each paragraph, and of each table as one text: `[TABLE n]`, then its rows with cells joined by ` | `."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""

    def text(e) -> str:
        return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in e.iter())

    out, tables = [], 0
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            out.append((text(e), names.get(key, key) or "", False))
        elif e.tag == f"{_W}tbl":
            tables += 1
            rows = [" | ".join("\n".join(text(p) for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            out.append(("\n".join([f"[TABLE {tables}]", *rows]), "", True))
    return out


def pdf_rows(content: bytes) -> list[tuple[int, str]]:
    """(page, line). Needs a PDF library; without one every PDF is rejected with that reason."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise NotImplementedError("no PDF library") from e
    return [(p + 1, line) for p, page in enumerate(PdfReader(io.BytesIO(content)).pages) for line in (page.extract_text() or "").split("\n")]


def lines_of_files(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-2..6: (LINES, rejected(path, reason)): paragraphs of DOCX (30 to a page), lines of PDF. A file that cannot be read is a rejected row, not a failure."""
    ship(raw.sparkSession)
    schema = LINES + ", reason string"

    def run(batches):
        for batch in batches:
            for path, ext, content in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    if ext == "docx":
                        rows = [(path, i, i // 30 + 1, t, s, tb, None) for i, (t, s, tb) in enumerate(docx_rows(content))]
                    else:
                        rows = [(path, i, p, t, "", False, None) for i, (p, t) in enumerate(pdf_rows(content))]
                except Exception as e:
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], [c.split()[0] for c in schema.split(", ")])

    got = raw.select("path", "extension", "content").mapInArrow(run, schema)
    return got.where("reason IS NULL").drop("reason"), got.where("reason IS NOT NULL").select("path", "reason")


def docx_sections(lines: DataFrame) -> DataFrame:
    """SRC-4/5/6: lines(doc_id, line_no, page, text, style, is_table) -> raw sections: by styles where three paragraphs or more have a heading style, else by text. Tables are in no section (they belong to
    the whole text only)."""
    own = lines.where("NOT is_table").withColumn("heading", F.col("style").rlike("(?i)heading") & (strip("text") != ""))
    styled = own.groupBy("doc_id").agg((F.count_if("heading") >= STYLED_FROM).alias("_styled"))
    own = own.join(styled, "doc_id")
    by_style = segment.sections_of_styled_lines(own.where("_styled").select("doc_id", "line_no", "page", "text", "heading", segment.style_level("style").alias("level"))).drop("headings")
    return by_style.unionByName(segment.sections_of_lines(own.where("NOT _styled").select("doc_id", "line_no", "page", "text")))


def table_texts(lines: DataFrame) -> DataFrame:
    """SRC-7: tables of a document, joined by a blank line."""
    own = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.where("is_table").groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: x["text"]), "\n\n").alias("tables"))


def ingested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ingest query: (files, raw sections by path, rejected)."""
    ok, bad = accepted(files(spark, path))
    lines, broken = lines_of_files(ok)
    keyed = lines.withColumn("doc_id", F.xxhash64("path"))
    return ok.drop("content"), docx_sections(keyed), bad.select("path", "reason").unionByName(broken)


def write_reports(reports: DataFrame, path: str) -> None:
    """SNK-1: report rows, with the whole row as one VARIANT, too: a reader takes paths out of it and parses no text (to_json gives the JSON)."""
    reports.withColumn("report_data", F.parse_json(F.to_json(F.struct("*")))).write.mode("append").parquet(path)


def write_sections(sections: DataFrame, path: str, by: str | None = None) -> None:
    """SNK-2. Partitioned only by a column of few values: by section type small files would abound."""
    w = sections.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def append_audit(entries: DataFrame, path: str) -> None:
    """SNK-6: entries(log_id, ts, user_id, ...) are appended; nothing that is there is read or changed."""
    entries.write.mode("append").parquet(path)


def audit_log(log: DataFrame, user: str | None = None, limit: int = 100) -> DataFrame:
    """SNK-6: newest first."""
    own = log if user is None else log.where(F.col("user_id").cast("string") == user)
    return own.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(limit)


def template_names(raw: DataFrame) -> DataFrame:
    """FN-17: (path, sector, method, project_type) from the folder and the name of a template."""
    from auditlake.functions.text import procurement_method

    name = F.regexp_extract("path", r"([^/]+)\.[^./]+\z", 1)
    sector = F.regexp_replace(F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1), "^铁路工程项目$", "铁路工程")
    dash = name.contains("--")
    # fixed values: kinds by words of the name, in order
    kinds = [("监理", "服务类"), ("设计", "服务类"), ("货物", "货物类"), ("服务", "服务类"), ("材料", "货物类")]
    kind = F.coalesce(*(F.when(name.contains(w), F.lit(k)) for w, k in kinds), F.lit("工程类"))
    method = F.when(name.contains("预审"), "资格预审").when(name.contains("后审"), F.when(name.contains("邀请"), "邀请招标").otherwise("公开招标")).otherwise(procurement_method(name))
    parts = F.split(name, "--")
    return raw.select("path", sector.alias("sector"), F.when(dash, procurement_method(F.trim(F.get(parts, F.lit(0))))).otherwise(method).alias("method"), F.when(dash, F.get(parts, F.lit(1))).otherwise(kind).alias("project_type"))


def fingerprints_of_templates(templates: DataFrame) -> DataFrame:
    """LAB-3: templates(path, text) -> fingerprints by sector, method and project type, which the folder and the name of a template say."""
    named = templates.select("path", "text").join(template_names(templates.select("path").distinct()), "path").withColumn("doc_id", F.xxhash64("path", "text"))
    return label.fingerprints(named, ["sector", "method", "project_type"])


PRINT_BUCKETS = 64


def _bucket(sector: Column) -> Column:
    return F.pmod(F.xxhash64(sector), F.lit(PRINT_BUCKETS)).cast("int")


def write_fingerprints(prints: DataFrame, path: str) -> None:
    """SNK-4: as JSON lines, one group after another, in folders by hash of the sector: their number does not grow with the sectors', and a group is read without most others."""
    own = prints.withColumn("bucket", _bucket(F.col("sector"))).hint("rebalance", F.col("bucket"))
    own.sortWithinPartitions("bucket", "sector", "method", "project_type").write.mode("overwrite").partitionBy("bucket").json(path)


def read_fingerprints(spark: SparkSession, path: str, sector: str | None = None) -> DataFrame:
    """SNK-4: (sector, method, project_type, hash_id, normalized, text, frequency, length), of one sector where it is given."""
    own = spark.read.schema("method string, project_type string, hash_id string, normalized string, text string, frequency long, length int, sector string, bucket int").json(path)
    own = own if sector is None else own.where((F.col("bucket") == _bucket(F.lit(sector))) & (F.col("sector") == sector))
    return own.drop("bucket")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

