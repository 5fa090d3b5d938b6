"""Operator 10: WARC archives, written and read back.

Writer: one gzip member per record. Of records with equal payloads of 1000 bytes or more one is a response,
the others revisit it without a payload. Tasks write files under a temporary name and rename them, and name
them by partition, so a task that runs again replaces its own files.
Reader: sequential. A file is decompressed in small steps, each record is framed by its content length, and
block and payload digests are verified.

The files go to the folder that driver and executors share. Only digests are shuffled; pages stay where they
are, as the table of digests that occur twice is broadcast below a checked number of rows (else joined).

Defined results: a null page has an empty payload; small or unequal payloads are all responses; rows that
repeat the largest page_id of their payload are all responses; a null page_id is written as an empty id, is
read back as null and is never revisited unless it is the only kind; an empty table writes no file and gives no rows;
other columns are dropped. The reader takes records of other
writers too: lengths and digests that they do not state are taken from the block, ids that are no numbers are null, and
records of other types are passed over.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecmill.llm.common import shared_dir

DEDUP_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
BROADCAST_ROWS = 200_000
STEP = 1 << 16
ID = "urn:page:"


class WarcError(ValueError):
    """A record that is not framed or digested as it says."""


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items())]
    lines += [f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    headers = {"WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        headers["WARC-Target-URI"] = "".join(c for c in url if c not in "\r\n")
    headers["WARC-Payload-Digest"] = f"sha1:{digest}"
    headers["X-Payload-Length"] = str(len(payload))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        return record(kind, headers | {"Content-Type": "application/http; msgtype=response"}, http + payload)
    headers["WARC-Refers-To"] = f"<{ID}{refers_to}>"
    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record(kind, headers | {"Content-Type": "application/http; msgtype=response"}, http)


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member, from the file's bytes in pieces."""
    unpack, out = zlib.decompressobj(31), []
    fed = False
    for piece in pieces:
        while piece:
            out.append(unpack.decompress(piece))
            fed = True
            piece = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack, out, fed = zlib.decompressobj(31), [], False
    if fed:
        raise WarcError("the last record is cut off")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; framing and digests are checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not mark or not first.startswith("WARC/"):
        raise WarcError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        raise WarcError("no content length") from None
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError("the content length does not frame the record")
    block = rest[:length]
    if headers.get("warc-block-digest", "").removeprefix("sha1:") != hashlib.sha1(block).hexdigest():
        raise WarcError("the block digest differs")
    if headers.get("warc-type") == "response" and "warc-payload-digest" in headers:
        payload = block.partition(b"\r\n\r\n")[2]
        if headers["warc-payload-digest"].removeprefix("sha1:") != hashlib.sha1(payload).hexdigest():
            raise WarcError("the payload digest differs")
    return headers, block


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    view = memoryview(content)
    for raw in members(bytes(view[i : i + STEP]) for i in range(0, len(view), STEP)):
        yield parse(raw)


def with_kinds(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which record revisits which."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    twice = (
        rows.where(F.octet_length("payload") >= DEDUP_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("of"), "best")
    )
    if twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        twice = F.broadcast(twice)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    return rows.join(twice, F.col("digest") == F.col("of"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str) -> int:
    """Writes the pages' records to ``folder`` (any URI that pyarrow opens); the number of records."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        number, out, size, n = 0, None, 0, 0
        temporary = lambda: f"{path}/.{part:06d}-{number:04d}.{attempt}"

        def close() -> None:
            out.close()
            store.move(temporary(), f"{path}/{part:06d}-{number:04d}.warc.gz")

        for batch in batches:
            for page_id, url, payload, digest, refers_to in batch.itertuples(index=False):
                if out is None:
                    out, size = store.open_output_stream(temporary()), 0
                url = None if pd.isna(url) else url
                member = page_record(_id(page_id), url, payload, digest, _id(refers_to))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pd.DataFrame({"n": [n]})

    kinds = with_kinds(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return kinds.mapInPandas(task, "n long").agg(F.sum("n")).first()[0] or 0


def _id(value) -> str | None:
    return None if value is None or pd.isna(value) else str(value)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and the
    payload (null for a revisit)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for headers, block in read_records(content):
                    ids = [headers[k].strip("<>").removeprefix(ID) or None if k in headers else None for k in ("warc-record-id", "warc-refers-to")]
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    length, digest = int(headers.get("x-payload-length", len(payload))), headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    digest = digest or hashlib.sha1(payload).hexdigest()
                    rows.append((ids[0], headers.get("warc-target-uri"), length, digest, kind, ids[1], payload if kind == "response" else None))
                    size += len(block)
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    return files.mapInPandas(task, schema).withColumns({c: F.col(c).try_cast("long") for c in ("page_id", "refers_to")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {DEDUP_BYTES} AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {DEDUP_BYTES} AND page_id <> best THEN best END AS refers_to
FROM m
"""
