"""WARC archives: written with an index first, read back by coalesced byte ranges.

Every task writes one archive of gzip members, one per record, into a folder
that all machines share, and returns an index row per record: file, offset,
length, URL and digest.  The index is a table in the same folder; archives of
attempts that were lost are in no index row and are never read.

Of records with equal payloads (by SHA-256) of at least ``min_bytes`` bytes,
the one with the smallest id is a response and the others revisit it.  Which is
which is found on digests alone, with the least id per digest combined
map-side; a page then meets the least id of its digest, where that occurs
twice, in a join that Spark may split where a payload is frequent.

Reading selects index rows, orders them by file and offset, and fetches
neighbouring records with one read as long as the gap and the range stay
small.  Payloads are hashed again and compared with the digest.

Null and empty pages have an empty payload; a page of any length is one record.
A null URL leaves the header out, line breaks in URLs are percent-encoded.  A
record with a null id revisits the least id of its payload; if no record of
that payload has an id, all of them are responses.  Rows that repeat the least
id are all responses.  Only the three named columns are read, so others cannot
clash; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat, store
from .shared import new_path, partitions, written

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A read goes on over gaps up to GAP and up to RANGE bytes.
GAP, RANGE = 64 << 10, 4 << 20
#: Records of one file are read by one task for so many bytes.
SHARE = 64 << 20
_INDEX = "file string, offset long, length long, page_id long, url string, record_type string, digest string, refers_to long, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """One record; ``first`` is the response that it revisits, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first)}", f"X-Refers-To-Page: {first}"]
    head += [f"X-Page-ID: {'' if page is None else page}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _write(folder: str, date: str):
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, f"part-{uuid.uuid4().hex}.warc.gz", 0
        system, path = fs.FileSystem.from_uri(folder)
        try:
            for batch in batches:
                for part in flat.slices(batch, "html"):
                    rows = []
                    for page, url, html, first in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                        if out is None:
                            out = system.open_output_stream(f"{path}/{name}", compression=None)
                        payload = (html or "").encode()
                        raw = gzip.compress(record(page, url, payload, first, date), 6, mtime=0)
                        out.write(raw)
                        rows.append((name, offset, len(raw), page, url, "response" if first is None else "revisit", digest(payload), first, len(payload)))
                        offset += len(raw)
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Writes the archives; their folder and the index table."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    store.make_folder(folder)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256)))
    # a table of its own: Spark can then split the join where a payload is frequent
    least = written(own.where("key is not null").groupBy("key").agg(F.min("page_id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c"), "warc-least")
    joined = own.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.xxhash64("page_id", "url")))).join(least, "key", "left")
    first = F.when(F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    rows = joined.select("page_id", "url", "html", first.alias("first"))
    return folder, written(rows.mapInArrow(_write(folder, date), _INDEX), "warc-index")


def _read(folder: str):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def fetch(system: fs.FileSystem, path: str, rows: list[tuple]) -> Iterator[tuple]:
        """Records of neighbouring index rows of one file, with one read."""
        low = rows[0][1]
        with system.open_input_file(f"{path}/{rows[0][0]}") as f:
            data = f.read_at(rows[-1][1] + rows[-1][2] - low, low)
        for _, offset, length, *_ in rows:
            fields, http, payload = parse(gzip.decompress(data[offset - low : offset - low + length]))
            told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and digest(payload) != told:
                raise ValueError("a payload differs from its digest")
            first = fields.get("X-Refers-To-Page")
            yield int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, fields.get("WARC-Target-URI"), int(http["Content-Length"]), told, fields["WARC-Type"], int(first) if first else None, payload if fields["WARC-Type"] == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)

        def chunks() -> Iterator[list[tuple]]:
            waiting: list[tuple] = []
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if waiting and (row[0] != waiting[0][0] or row[1] - waiting[-1][1] - waiting[-1][2] > GAP or row[1] + row[2] - waiting[0][1] > RANGE):
                        yield waiting
                        waiting = []
                    waiting.append(row)
            if waiting:
                yield waiting

        for rows in chunks():
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*fetch(system, path, rows), strict=True), kinds, strict=True)], names=names)

    return run


def read(spark: SparkSession, folder: str, index: DataFrame, where: Column | None = None) -> DataFrame:
    """Records of the selected index rows: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` (null for revisits)."""
    chosen = (index if where is None else index.where(where)).select("file", "offset", "length")
    chosen = chosen.repartition(partitions(spark), "file", F.floor(F.col("offset") / SHARE)).sortWithinPartitions("file", "offset")
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])
    return chosen.mapInArrow(_read(folder), schema)
