"""WARC archives as a chunked record table.

A record is one or more rows (record, chunk number, bytes): a long payload is never held whole by the writer or the
reader. Both carry a digest from chunk to chunk, and the last chunk of a record must arrive at the digest that the
record states. Each write task makes one archive of gzip members, one member a record; its name is unique to the
attempt, and only archives named in the manifest (the task results that Spark accepted) are read back, so a task that
is lost and run again leaves no half or double archive in the result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import read, whole
from larkspan.llm.exact_dedup import exact_dedup
from larkspan.session import cut_lineage, filesystem, work_path

CHUNK = 1 << 20
LEAST_SHARED = 100  # smaller payloads are always written
DATE = "2026-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, chunk_no long, data binary, last boolean, "
    "bytes_so_far long, digest_so_far string"
)


def decide(pages: DataFrame) -> DataFrame:
    """page_id, sha and the page that holds the payload: the smallest id of all pages with that payload."""
    found = exact_dedup(pages, id_col="page_id", text_col="html", keep="smallest")
    return found.groupBy("doc_id", "text_sha256").agg(F.min("keep_id").alias("keep_id"))


def records(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, record_type, refers_to, digest, size, payload (null for revisits).

    Null html is an empty payload. A page with a null id is a record without an id. Repeated rows are records each;
    of rows with the id that holds the payload, all are responses.
    """
    payload = whole("html").cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    held = decide(pages)
    told = rows.join(held, rows["page_id"].eqNullSafe(held["doc_id"]) & (rows["digest"] == held["text_sha256"]))
    size = F.octet_length("payload").cast("long")
    revisit = (size >= LEAST_SHARED) & ~F.col("page_id").eqNullSafe(F.col("keep_id"))
    return told.select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keep_id")).alias("refers_to"),
        "digest",
        size.alias("size"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def chunk_rows(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The record table cut into chunks; the chunks of a record follow each other."""
    last = F.greatest(F.ceil(F.octet_length("payload") / chunk) - 1, F.lit(0))
    numbered = found.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0)).cast("long"))))
    start = (F.col("chunk_no") * chunk + 1).cast("int")
    data = F.coalesce(F.substring("payload", start, F.lit(chunk)), F.lit(b""))
    return numbered.select(
        "page_id", "url", "record_type", "refers_to", "digest", "size", "chunk_no", data.alias("data"),
        (F.col("chunk_no") == F.coalesce(last, F.lit(0))).alias("last"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _head(row: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(row['refers_to'])}",
        ]
    lines += [
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['size'])}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write one archive per partition below `folder`; the manifest of the archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        store.create_dir(at, recursive=True)
        path = f"{at.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        out, count, packer, digest = None, 0, None, None
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                out = out or store.open_output_stream(path)
                if row["chunk_no"] == 0:
                    packer, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    out.write(packer.compress(_head(row)))
                digest.update(row["data"])
                out.write(packer.compress(row["data"]))
                if row["last"]:
                    if row["record_type"] == "response" and digest.hexdigest() != row["digest"]:
                        raise ValueError(f"payload of page {row['page_id']} has not the digest {row['digest']}")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    count += 1
        if out:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size}])

    return cut_lineage(chunks.mapInArrow(write, MANIFEST))


class _Stream:
    """Bytes of a file of gzip members, unpacked piece by piece."""

    def __init__(self, file, piece: int = 1 << 18):
        self.file, self.piece, self.rest, self.held, self.unpacker = file, piece, b"", b"", None

    def _more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.file.read(self.piece)
                if not self.rest:
                    return False
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            made = self.unpacker.decompress(self.rest, self.piece)
            self.rest = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.rest, self.unpacker = self.unpacker.unused_data, None
            if made:
                self.held += made
                return True

    def head(self) -> dict[str, str] | None:
        """The first line (under "") and the fields up to an empty line; None at the end of the file."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends within a header")
                return None
        lines, self.held = self.held[:end].decode().split("\r\n"), self.held[end + 4 :]
        return {"": lines[0]} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}

    def take(self, size: int) -> bytes:
        parts = []
        while size:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:size], self.held[size:]
            parts.append(part)
            size -= len(part)
        return b"".join(parts)


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _records_of(stream: _Stream, chunk: int) -> Iterator[dict]:
    while head := stream.head():
        if head[""] != "WARC/1.1":
            raise ValueError(f"no record starts here: {head['']!r}")
        http = stream.head()
        size, stated = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
        url = head.get("warc-target-uri")
        row = {
            "page_id": _number(head["warc-record-id"]),
            "url": url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
            "record_type": head["warc-type"],
            "refers_to": _number(head.get("warc-refers-to")),
        }
        if row["record_type"] == "revisit":
            yield row | {"chunk_no": 0, "data": b"", "last": True, "bytes_so_far": size, "digest_so_far": stated}
        else:
            digest, done, no = hashlib.sha256(), 0, 0
            while True:
                data = stream.take(min(chunk, size - done))
                digest.update(data)
                done += len(data)
                yield row | {"chunk_no": no, "data": data, "last": done == size, "bytes_so_far": done, "digest_so_far": digest.hexdigest()}
                no += 1
                if done == size:
                    break
            if digest.hexdigest() != stated:
                raise ValueError(f"record {head['warc-record-id']} has not the digest that it states")
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk table of all archives of a manifest. Without `payloads` the bytes are checked but not handed on."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()),
         ("data", pa.binary()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())]
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, _ = filesystem(path_root)
                held, size = [], 0
                with store.open_input_stream(path) as file:
                    for row in _records_of(_Stream(file), chunk):
                        size += len(row["data"])
                        if not payloads:
                            row["data"] = None
                        held.append(row)
                        if size >= 8 * chunk or len(held) >= 5000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    path_root = work_path(manifest.sparkSession, "warc")
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(unpack, CHUNKS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, read them back, one row per record."""
    manifest = write_archives(chunk_rows(records(read(spark, sf_dir, "pages"))), work_path(spark, "warc"))
    return read_archives(manifest, payloads=False).filter("last").select(
        "page_id",
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP9_SQL = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), k as (
  select *, min(page_id) over (partition by payload_digest) as keeper from p
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> keeper then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> keeper then keeper end as refers_to
from k
"""
