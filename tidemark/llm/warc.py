"""WARC archives: a writer, and a reader that salvages damaged files.

Archives are gzip files of one member per record. Each is written by one task
under a name of its own attempt and then renamed, and only files named in the
manifest that the tasks return are read, so a repeated task harms nothing.

The reader checks what it can (gzip CRC and length, the version line, the record's
Content-Length, the block digest). Where a check fails it searches for the next
place where a valid gzip member or, in plain files, a version line begins, goes
on from there, and logs the bytes in between as a quarantined gap (archive, start,
end, reason). Records before and after a gap are all returned.

Defined results: a null html is an empty payload; payloads under MIN_REVISIT bytes
are always stored. Of equal payloads the largest page_id is stored and the others
become revisits of it; rows that share that page_id are all stored. Rows without a
page_id are always stored, under a record without a target page. Repeated rows give
repeated records. A null url becomes an empty target. An empty table gives no
archive and no row.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, shared_path, stored

MIN_REVISIT = 1000
#: A task starts another archive beyond so many compressed bytes.
ARCHIVE_BYTES = 16 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
STEP = 16384


def _uri(page_id) -> str:
    return f"urn:page:{'' if page_id is None else int(page_id)}"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header, so the full
    payload's length survives, and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_uri(page_id)} {digest}')}>", f"WARC-Page-URI: {_uri(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z", "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""), f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {_uri(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(rec: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(rec) + z.flush()


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page stores.
    Carries no text: a digest and an id per page, counted per digest before the
    shuffle."""
    slim = pages.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= MIN_REVISIT)).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    most = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).filter("_least < refers_to").drop("_least")
    return slim.join(most, "digest").filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _writer(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}"
        out, n, part, done = bytearray(), 0, 0, []

        def close() -> None:
            nonlocal out, n, part
            final = posixpath.join(base, f"{name}-{part:04d}.warc.gz")
            with fs.open_output_stream(final + ".tmp") as f:
                f.write(bytes(out))
            fs.move(final + ".tmp", final)
            done.append((posixpath.basename(final), n, len(out)))
            out, n, part = bytearray(), 0, part + 1

        for b in batches:
            for page_id, url, html, ref in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                payload = b"" if html is None else html.encode("utf-8")
                page, to = (None if pd.isna(x) else int(x) for x in (page_id, ref))
                out += member(record(page, None if pd.isna(url) else url, payload, hashlib.sha1(payload).hexdigest(), to))
                n += 1
                if len(out) >= ARCHIVE_BYTES:
                    close()
        if n:
            close()
        yield pd.DataFrame(done, columns=["archive", "n_records", "n_bytes"])

    return run


def write_archives(spark: SparkSession, pages: DataFrame, root: str) -> DataFrame:
    """Write page_id, url, html as archives under root (a folder that executors
    share); returns the manifest: archive, n_records, n_bytes."""
    bounded_batches(spark)
    pages = pages.select("page_id", "url", "html")
    refs = revisits(pages)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    keyed = pages.withColumn("_d", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    rows = keyed.join(refs.withColumnsRenamed({"page_id": "_p", "digest": "_h"}), (F.col("page_id") == F.col("_p")) & (F.col("_d") == F.col("_h")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to")
    return stored(rows.mapInPandas(_writer(root), "archive string, n_records long, n_bytes long"), "warc-manifest")


def _parse(rec: bytes) -> tuple[dict[str, str], bytes] | str:
    """Headers and block of one record, or what is wrong with it."""
    if not rec.startswith(b"WARC/1."):
        return "no version line"
    end = rec.find(b"\r\n\r\n")
    if end < 0:
        return "headers do not end"
    head = {}
    for line in rec[:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        head[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = head.get("content-length", "")
    if not size.isdigit():
        return "no content length"
    block = rec[end + 4 : end + 4 + int(size)]
    if len(block) < int(size):
        return "shorter than its content length"
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha1:") and hashlib.sha1(block).hexdigest() != digest[5:]:
        return "block digest differs"
    return head, block


def _record_at(data: bytes, at: int) -> tuple[int, tuple[dict[str, str], bytes] | str]:
    """Where the record at this place ends, and the record or what is wrong."""
    if data.startswith(MAGIC, at):
        z, rec, end = zlib.decompressobj(31), [], at
        try:
            while not z.eof and end < len(data):  # in steps: what follows the member is copied
                step = data[end : end + STEP]
                rec.append(z.decompress(step))
                end += len(step)
        except zlib.error as e:
            return at, f"gzip: {e}"
        if not z.eof:
            return at, "gzip member is cut off"
        return end - len(z.unused_data), _parse(b"".join(rec))
    if data.startswith(b"WARC/1.", at):
        end = data.find(b"\r\n\r\n", at)
        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[at:end]) if end > 0 else None
        stop = end + 4 + int(size[1]) if size else at
        parsed = _parse(data[at:stop]) if size else "no content length"
        return stop + 4 * data.startswith(b"\r\n\r\n", stop), parsed
    return at, "neither a gzip member nor a version line"


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, b"").

    A bad record's extent isn't trusted: the search goes on one byte behind its
    start, so records that its wrong length would swallow are found. A candidate
    ends the gap only if a whole valid record begins there."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        end, got = _record_at(data, at)
        if not isinstance(got, str):
            if bad is not None:
                yield "gap", bad, at, reason, b""
                bad = None
            yield "record", at, end, *got
            at = end
            continue
        if bad is None:
            bad, reason = at, got
        after = [x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
        at = min(after, default=len(data))
    if bad is not None:
        yield "gap", bad, len(data), reason, b""


def _page(uri: str) -> int | None:
    tail = uri.rpartition(":")[2]
    return int(tail) if uri.startswith("urn:page:") and tail.lstrip("-").isdigit() else None


READ = "kind string, archive string, start long, stop long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _reader(payloads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                rows, held = [], 0
                for kind, start, end, head, block in salvage(data):
                    if kind == "gap":
                        rows.append((kind, path, start, end, head, None, None, None, None, None, None, None))
                    else:
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = re.search(rb"(?i)content-length:\s*(\d+)", http)
                        own = head.get("warc-type") == "response"
                        digest = hashlib.sha1(body).hexdigest() if own else head.get("warc-payload-digest", "")[5:]
                        rows.append((kind, path, start, end, None, _page(head.get("warc-page-uri", "")), head.get("warc-target-uri"), head.get("warc-type"), _page(head.get("warc-refers-to-page", "")), len(body) if own else int(size[1]) if size else None, digest, body if payloads and own else None))
                        held += len(body) if payloads else 0
                    if len(rows) >= 4000 or held > 16 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return run


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in ("page_id", "refers_to", "payload_bytes")})


def read_archives(spark: SparkSession, root: str, manifest: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """Records (kind "record") and quarantined gaps (kind "gap") of the archives in a
    folder; with a manifest, only of those it names."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(root).select("path", "content")
    if manifest is not None:
        files = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(manifest.select("archive").distinct(), "archive", "left_semi")
    return files.select("path", "content").mapInPandas(_reader(payloads), READ)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = shared_path(spark, "warc")
    manifest = write_archives(spark, pages, root)
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read_archives(spark, root, manifest)
    return found.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (
  SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= {MIN_REVISIT}
"""
