"""WARC archives as a chunked record table.

Writing: each task streams its records into an archive of its own in the shared folder (one gzip member per record, payload fed in slices) and returns a manifest:
path and byte range of about 64 MB of records each. Only what the manifest of a successful task names is ever read, so a task that was lost and ran again
leaves no double records. Reading: a task takes byte ranges and streams each record as rows (record id, chunk number): a chunk of at most chunk_bytes, and
the SHA-1 of the payload up to and including it, carried on from chunk to chunk. No task holds a whole record that is larger than a chunk.

Of records with equal payloads, that with the smallest id is the response; the others are revisits: their HTTP headers with the length, the payload's digest and the
id of the response, without the payload.

A record's id is a UUID of its own, whatever page ids repeat or lack, so (record id, chunk number) is a key of the chunk table; the page's id is an extension field of the header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, table
from auditlake.session import ship

CHUNK = 1 << 20
SLICE = 1 << 16
SPLIT = 64 << 20
#: Bytes (of payloads; of archives) that a task which writes or reads archives gets at least, where there are enough of them.
LEAST = 16 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, begin long, end long, records long"
CHUNKS = "record_id string, page_id long, target_uri string, record_type string, refers_to string, refers_to_page long, declared_digest string, payload_bytes long, chunk_no int, offset long, data binary, digest string, last boolean"
PAGE_ID, REFERS_TO_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_payload(pages: DataFrame, id_col: str, html_col: str, *more: Column) -> DataFrame:
    """page_id, what more is asked for, html (null: empty), sha1 (hex)."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), *more, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))


def payloads(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """page_id, sha1, bytes: what planned() needs to know of all rows at once."""
    return with_payload(pages, id_col, html_col).select("page_id", "sha1", F.octet_length("html").cast("long").alias("bytes"))


def planned(pages: DataFrame, known: DataFrame, id_col: str, html_col: str, url_col: str, min_bytes: int) -> DataFrame:
    """known: payloads() of the pages. Gives page_id, url, html, sha1 (hex), record (UUID of a response that revisits refer to; null: any), revisit, first_page and first (page and UUID of a revisit's response).

    The UUID of a response follows from its payload and page, so what refers to it need not see it. Rows that repeat a response's page and payload are responses
    too: none of them can be told from the others, so their revisits name the page and the digest but no record (which the format leaves open).
    """
    own = with_payload(pages, id_col, html_col, F.col(url_col).cast("string").alias("url"))
    size = F.octet_length("html")
    each = known.where(F.col("bytes") >= min_bytes).groupBy("sha1", "page_id").agg(F.count("*").alias("n"))
    firsts = each.groupBy("sha1").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("least"), F.sum("n").alias("n")).where("n > 1")
    both = own.join(firsts.select("sha1", F.col("least.page_id").alias("least"), F.col("least.n").alias("times"), F.lit(True).alias("often")), "sha1", "left")
    again = F.col("often").isNotNull() & (size >= min_bytes)
    revisit = again & ~F.col("page_id").eqNullSafe(F.col("least"))
    uuid_ = F.regexp_replace(F.md5(F.concat_ws(" ", "sha1", "least")), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5")
    named = F.when(again & (F.col("times") == 1), uuid_)
    return both.select("page_id", "url", "html", "sha1", F.when(~revisit, named).alias("record"), revisit.alias("revisit"), F.when(revisit, F.col("least")).alias("first_page"), F.when(revisit, named).alias("first"))


def header_value(x: str) -> str:
    """A header's value is one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def record_head(record: str, page_id: int | None, url: str | None, revisit: bool, first_page: int | None, first: str | None, sha1: str, size: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"{PAGE_ID}: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(sha1))}")
    if revisit:
        lines += [*([] if first is None else [f"WARC-Refers-To: <urn:uuid:{first}>"]), *([] if first_page is None else [f"{REFERS_TO_PAGE}: {first_page}"]), f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + http


def write_archives(records: DataFrame, folder: str, date: str = DATE, level: int = 1) -> DataFrame:
    """records as planned() -> MANIFEST rows; running it writes. folder: a URI that executors reach, for example under spark.checkpoint.dir."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        at = begin = n = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": pa.array([path]), "begin": pa.array([begin], pa.int64()), "end": pa.array([at], pa.int64()), "records": pa.array([n], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None)
                page_id, url, sha1, record, revisit, first_page, first = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4, 5, 6, 7))
                body = batch.column(2)[i].as_buffer()
                body = memoryview(body) if body is not None else memoryview(b"")
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                parts = [z.compress(record_head(record or str(uuid.uuid4()), page_id, url, revisit, first_page, first, sha1, len(body), date))]
                if not revisit:
                    for k in range(0, len(body), SLICE):
                        parts.append(z.compress(body[k : k + SLICE]))
                        if sum(map(len, parts)) > SLICE:
                            out.write(b"".join(parts))
                            at += sum(map(len, parts))
                            parts = []
                parts += [z.compress(b"\r\n\r\n"), z.flush()]
                out.write(b"".join(parts))
                at += sum(map(len, parts))
                n += 1
                if at - begin >= SPLIT:
                    yield row()
                    begin, n = at, 0
        if out is not None:
            out.close()
            if n:
                yield row()

    return records.mapInArrow(run, MANIFEST)


class Members:
    """Bytes of one gzip member after another, out of a range of a file."""

    def __init__(self, file, begin: int, end: int):
        file.seek(begin)
        self.file, self.left, self.raw = file, end - begin, b""
        self.z, self.held = None, b""

    def more(self) -> bool:
        """Reads on in the member; False at its end."""
        while True:
            if self.z is None or self.z.eof:
                return False
            if not self.raw:
                self.raw = self.file.read(min(SLICE, self.left))
                self.left -= len(self.raw)
                if not self.raw:
                    raise ValueError("an archive ends inside a record")
            got = self.z.decompress(self.raw, SLICE)
            self.raw = self.z.unconsumed_tail or self.z.unused_data
            if got:
                self.held += got
                return True

    def next_record(self) -> bool:
        while self.z is not None and not self.z.eof:  # what was not read of the last one
            self.held = b""
            self.more()
        if not self.raw and not self.left:
            return False
        self.z, self.held = zlib.decompressobj(31), b""
        return True

    def head(self) -> list[str]:
        """Lines up to an empty one."""
        while b"\r\n\r\n" not in self.held:
            if not self.more():
                raise ValueError("a record without an end of its headers")
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head.decode("utf-8", "replace").split("\r\n")

    def body(self, size: int, step: int) -> Iterator[bytes]:
        while size:
            want = min(step, size)
            parts, n = [], 0
            while n < want:
                if not self.held and not self.more():
                    raise ValueError("a record shorter than its length")
                part, self.held = self.held[: want - n], self.held[want - n :]
                parts.append(part)
                n += len(part)
            yield b"".join(parts)
            size -= want


def fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK, payload: bool = True) -> DataFrame:
    """MANIFEST rows -> CHUNKS rows, chunks of a record in order. An empty payload has one empty chunk; so has a revisit, with the declared digest and length of
    the full payload. payload=False leaves data null (the bytes are digested all the same). A response whose payload does not have its declared digest is an error."""
    ship(manifest.sparkSession)

    def records(path: str, begin: int, end: int) -> Iterator[dict]:
        fs, base = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(base) as file:
            m = Members(file, begin, end)
            while m.next_record():
                warc = fields(m.head()[1:])
                http_bytes = int(warc["content-length"])
                http = m.head()
                size = http_bytes - sum(len(x.encode()) + 2 for x in http) - 2
                declared = warc.get("warc-payload-digest", "").removeprefix("sha1:")
                page, of = (int(x) if (x := warc.get(name.lower())) else None for name in (PAGE_ID, REFERS_TO_PAGE))
                row = {"record_id": warc["warc-record-id"].strip("<>"), "page_id": page, "refers_to_page": of, "target_uri": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": warc.get("warc-refers-to", "").strip("<>") or None, "declared_digest": declared, "payload_bytes": int(fields(http[1:])["content-length"])}
                sha, at, k = hashlib.sha1(), 0, 0
                for data in m.body(size, chunk_bytes) if size else [b""]:
                    sha.update(data)
                    last = at + len(data) == size
                    digest = base32_sha1(sha.digest()) if row["record_type"] != "revisit" else declared
                    if last and digest != declared:
                        raise ValueError(f"{row['record_id']}: digest {digest}, declared {declared}")
                    yield row | {"chunk_no": k, "offset": at, "data": data if payload else None, "digest": digest, "last": last}
                    at, k = at + len(data), k + 1

    kinds = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("refers_to_page", pa.int64()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int32()), ("offset", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                for row in records(x["path"], x["begin"], x["end"]):
                    held.append(row)
                    size += len(row["data"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return manifest.mapInArrow(run, CHUNKS)


def tasks_for(size: int, spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-size // LEAST))


def dealt(manifest: DataFrame) -> DataFrame:
    """The manifest in as many partitions as its bytes ask for: a range of SPLIT bytes is a task of its own, small ones share tasks."""
    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    return manifest.repartition(max(1, min(n, tasks_for(size, manifest.sparkSession))))


def archive(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes one record per row of pages; returns the manifest, kept as a table in the shared folder.

    Null html is an empty payload; a null url gives no target URI. Payloads under min_bytes are responses. Rows that repeat the response's id and payload are
    written as responses, too. A null id is above all others and refers to a response with an id if there is one. An empty table writes nothing.
    Few bytes in many partitions make few archives: partitions are put together to LEAST bytes of payload, down to as many as there are cores.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    known = scratch.keep(payloads(pages, id_col, html_col), "payloads")
    records = planned(pages, known, id_col, html_col, url_col, min_bytes).coalesce(tasks_for(known.agg(F.sum("bytes")).first()[0] or 0, pages.sparkSession))
    manifest = scratch.keep(write_archives(records, folder or f"{scratch.path}/archives"), "manifest")
    scratch.drop("payloads")
    return manifest


def op1_warc_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_chunks(dealt(archive(table(spark, sf_dir, "pages"))), payload=False).where("last")
    return chunks.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to_page").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
