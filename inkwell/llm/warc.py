"""Operator 3: WARC archives read through an index.

Each task writes the records of its rows as WARC/1.1, every record its own gzip member, and returns their index rows (file, offset,
length, URL, digest). The index is stored as a table by Spark's writer, which commits the rows of one attempt per task:
files of lost or repeated attempts are named by no index row and so never read. A read selects index rows first, sorts
them by file and offset, joins neighbouring ranges into one read each, and cuts the records out of it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, stored, table

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: A task starts a new file after this many bytes.
FILE_BYTES = 256 << 20
#: Ranges at most GAP bytes apart are read at once, up to READ_BYTES (a longer record is read alone).
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Capture times are not in the input; one fixed date keeps archives reproducible.
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
URN = "<urn:inkwell:page:{}>"

INDEX = "id long, file string, offset long, length long, url string, digest string"
RECORD = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """Rows (id, url, body, digest, kind, refers_to). Of equal payloads of REVISIT_BYTES or more the row with the smallest id is
    the response (all such rows where the id is repeated; null ids come last), the others revisit it.

    Only (digest, smallest id, count) is grouped, with partial sums in each task; the bodies go through one join by digest, in
    which AQE splits a digest that holds many rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    rows = rows.select("*", F.sha2("body", 256).alias("digest"))
    first = rows.where(F.octet_length("body") >= REVISIT_BYTES).groupBy(F.col("digest").alias("digest_")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(first, F.col("digest") == F.col("digest_"), "left")
    again = F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return met.select("id", "url", "body", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def record(page: int | None, url: str | None, body: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no block; its header names the payload's digest and length."""
    name = lambda x: URN.format("none" if x is None else x)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {''.join((url or '').splitlines())}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(body)}"]
        body = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return (CRLF.join(head) + CRLF * 2).encode() + body + (CRLF * 2).encode()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; ValueError if the record isn't whole."""
    head, _, rest = data.partition((CRLF * 2).encode())
    lines = head.decode().split(CRLF)
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest != block + (CRLF * 2).encode():
        raise ValueError(f"broken WARC record {fields.get('WARC-Record-ID')}")
    return fields, block


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes the archives below ``root`` (any folder pyarrow can open and all executors share); returns the stored index.

    A null body is an empty payload, a null URL an empty one. Null ids are written as ``none`` and come back null. Repeated rows
    are records of their own. Other columns are not read. An empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        out, path, at = None, "", 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    store.create_dir(base, recursive=True)
                    path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record(row["id"], row["url"], row["body"], row["digest"], row["kind"], row["refers_to"])) + pack.flush()
                out.write(data)
                rows.append((row["id"], path, at, len(data), row["url"], row["digest"]))
                at += len(data)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "file", "offset", "length", "url", "digest"])
        if out is not None:
            out.close()

    planned = plan_records(pages, id_col, url_col, body_col).select("id", "url", F.encode("body", "UTF-8").alias("body"), "digest", "kind", "refers_to")
    return stored(planned.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, root: str, bodies: bool = False) -> DataFrame:
    """Reads the records of the index rows given (all or a selection): id, payload_bytes, payload_digest, record_type,
    refers_to; with ``bodies`` also body (null for revisits). The digest of every block read is computed again and compared.

    Null ids come back null; repeated index rows give repeated records; records of any length are read whole; an empty index gives no
    rows. Only the index's own columns are read."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        run: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if run and (file != run[-1][0] or offset - sum(run[-1][1:]) > GAP or offset + length - run[0][1] > READ_BYTES):
                    yield run
                    run = []
                run.append((file, offset, length))
        if run:
            yield run

    def number(x: str | None) -> int | None:
        return None if x is None or x == URN.format("none") else int(x.rpartition(":")[2][:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        opened, file = None, ""
        for part in ranges(batches):
            if part[0][0] != file:
                file = part[0][0]
                opened = store.open_input_file(file)
            start = part[0][1]
            opened.seek(start)
            data = opened.read(sum(part[-1][1:]) - start)
            rows = []
            for _, offset, length in part:
                fields, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"{file} at {offset}: the payload differs from its digest")
                size = len(block) if kind == "response" else int(fields["X-Payload-Length"])
                rows.append((number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), block.decode() if kind == "response" else None)[: 6 if bodies else 5])
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=schema.names)

    schema = T.StructType.fromDDL(RECORD + ", body string" * bodies)
    return index.select("file", "offset", "length").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/inkwell/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages"), root)
    return read_records(index, root).withColumnRenamed("id", "page_id")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
f AS (SELECT b, min(page_id) AS first FROM p WHERE strlen(b) >= 100 GROUP BY b)
SELECT p.page_id, strlen(p.b)::BIGINT AS payload_bytes, sha256(p.b) AS payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (b)
"""
