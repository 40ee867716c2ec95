"""WARC archives: writing, and the normaliser of monolithic gzip.

Archives travel as binary cells of tables, so that Spark alone touches the store: (archive_id, blob). A monolithic
archive is one gzip member over all records. The normaliser inflates such a stream once, writes every record as a
member of its own and returns the offset index beside the new archive; a reader then seeks single records, and follows a
revisit to the response that it refers to. export_archives() and import_archives() write and read archives as files, each
with its index as a sidecar file.

A record's id is made of its page's, so records of equal or null page ids share theirs.

Of records with equal payloads of MIN_REVISIT bytes and more, that with the smallest id is the response and the
others revisit it; rows that share the smallest id are all responses. Null payloads are empty ones. Rows with a null
id have no place in that order: they are responses and nothing refers to them. A table without rows gives archives
without rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, written

MIN_REVISIT = 100
#: Raw bytes of records in an archive; it ends with the record that reaches this.
ARCHIVE_BYTES = 4 << 20
#: Shares into which the rows of one digest are dealt for the join with its smallest id.
SALTS = 32
#: Of deflate, for archives and members.
LEVEL = 6
EPOCH = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set for revisits. Rows are pre-aggregated by digest; only digests with several ids are joined, salted."""
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    first = rows.filter(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).filter("low < high")
    first = first.select("digest", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    return rows.join(first, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(F.col("low") < F.col("page_id"), F.col("low")).alias("refers_to"))


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    clean = re.sub(r"[\x00-\x20\x7f]", "", url or "") or "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one by one; no more than one record and one chunk are held."""
    held = bytearray()
    need = head = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                if (head := held.find(b"\r\n\r\n")) < 0:
                    break
                need = head + 4 + int(headers(bytes(held[:head]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def inflated(blob: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip stream in chunks: one member over all, or many."""
    data = memoryview(blob)
    while len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if not len(data) and not member.unconsumed_tail:
                raise ValueError("the gzip stream is cut off")
            yield member.decompress(data, size)
            data = member.unused_data if member.eof else member.unconsumed_tail
    return


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(rows: DataFrame) -> DataFrame:
    """Monolithic archives (archive_id, blob) of with_revisits' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, raw, parts = TaskContext.get().partitionId(), 0, 0, []
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}"], pa.string()), pa.array([b"".join(parts) + z.flush()], pa.binary())], ["archive_id", "blob"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                parts.append(z.compress(one))
                raw += len(one)
                if raw >= ARCHIVE_BYTES:
                    yield archive()
                    n, raw, parts, z = n + 1, 0, [], zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        if raw:
            yield archive()

    return rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive_id string, blob binary")


INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def normalize(archives: DataFrame) -> DataFrame:
    """Every record as its own gzip member: (archive_id, blob, cdx), where cdx is the sidecar index of (record_id, type, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                members, index, at = [], [], 0
                for one in split_records(inflated(blob)):
                    h = headers(one[: one.find(b"\r\n\r\n")])
                    members.append(_gzip(one))
                    index.append({"record_id": h["warc-record-id"], "type": h["warc-type"], "offset": at, "length": len(members[-1])})
                    at += len(members[-1])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary()), pa.array([index], INDEX)], ["archive_id", "blob", "cdx"])

    return archives.select("archive_id", "blob").mapInArrow(run, "archive_id string, blob binary, cdx array<struct<record_id:string,type:string,offset:long,length:long>>")


def sidecar(normalized: DataFrame) -> DataFrame:
    """The offset index as a table of its own."""
    return normalized.select("archive_id", F.explode("cdx").alias("x")).select("archive_id", "x.*")


def read_records(normalized: DataFrame) -> DataFrame:
    """(page_id, size, digest, record_type, refers_to) of each record, found by its offset and inflated alone. A response's size and digest are those of its bytes, held against its header; a revisit has the digest that it claims, and no size."""

    def page(one: bytes) -> tuple:
        cut = one.find(b"\r\n\r\n")
        h, block = headers(one[:cut]), one[cut + 4 : -4]
        body = block[block.find(b"\r\n\r\n") + 4 :]
        digest, size = h["warc-payload-digest"].removeprefix("sha256:"), None
        if h["warc-type"] == "response":
            size = len(body)
            if hashlib.sha256(body).hexdigest() != digest or size != int(headers(block[: block.find(b"\r\n\r\n")])["content-length"]):
                raise ValueError(f"damaged payload in {h['warc-record-id']}")
        number = lambda x: None if x in (None, "null") else int(x)
        of = lambda k: number(h[k][len("<urn:x-page:") : -1]) if k in h else None
        return of("warc-record-id"), size, digest, h["warc-type"], of("warc-refers-to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [page(zlib.decompress(blob[x["offset"] : x["offset"] + x["length"]], 31)) for x in index]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "size", "digest", "record_type", "refers_to"])

    return normalized.select("blob", "cdx").mapInArrow(run, "page_id long, size long, digest string, record_type string, refers_to long")


def read_pages(normalized: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit's payload is that of the response it refers to; one that leads nowhere raises."""
    records = materialize(read_records(normalized), "warc-records")
    own = records.filter("record_type = 'response'")
    asked = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("at"), F.col("digest").alias("claimed")).distinct()
    # Rows that share the smallest id are all responses, of equal payload: one stands for them.
    target = own.join(asked, (F.col("page_id") == F.col("at")) & (F.col("digest") == F.col("claimed"))).groupBy("at", "claimed").agg(F.min("size").alias("payload_bytes"), F.min("digest").alias("payload_digest"))
    lost = F.raise_error(F.concat(F.lit("no such response: "), F.col("refers_to").cast("string")))
    met = records.filter("record_type = 'revisit'").join(target, (F.col("refers_to") == F.col("at")) & (F.col("digest") == F.col("claimed")), "left")
    met = met.select("page_id", F.coalesce("payload_bytes", lost.cast("long")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return own.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to").unionByName(met)


def _store(folder: str) -> tuple[object, str]:
    """The file system of a folder, by its scheme, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def export_archives(normalized: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as <id>.warc.gz and its index as <id>.cdxj into a folder that all executors reach by its scheme; (archive_id, bytes, records), on which the writing depends.

    A file appears under its name only when it is whole, and a task that runs again writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)

        def put(name: str, data: bytes) -> None:
            part = f"{base}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, f"{base}/{name}")

        for batch in batches:
            for name, blob, index in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                lines = "".join(json.dumps({"record_id": x["record_id"], "type": x["type"], "offset": x["offset"], "length": x["length"]}) + "\n" for x in index)
                put(f"{name}.cdxj", lines.encode())
                put(f"{name}.warc.gz", blob)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(blob)]), pa.array([len(index)])], ["archive_id", "bytes", "records"])

    return normalized.select("archive_id", "blob", "cdx").mapInArrow(run, "archive_id string, bytes long, records long")


def import_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive_id, blob) of the archives in a folder, monolithic or not, for normalize(); files that are not whole yet have another name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.warc\.gz$", 1)
    return files.filter(~name.startswith("_")).select(name.alias("archive_id"), F.col("content").alias("blob"))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(archive_id, record_id, type, offset, length) of the sidecar files in a folder."""
    lines = spark.read.option("pathGlobFilter", "*.cdxj").text(folder).withColumn("path", F.input_file_name())
    x = F.from_json("value", "record_id string, type string, offset long, length long").alias("x")
    return lines.select(F.regexp_extract("path", r"([^/]+)\.cdxj$", 1).alias("archive_id"), x).select("archive_id", "x.*")


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written to monolithic archives, these normalised, and every record read back by the sidecar index."""
    spark, start = pages.sparkSession, written()
    archives = materialize(write_archives(with_revisits(pages)), "warc-monolithic")
    release(spark, start, archives)
    members = materialize(normalize(archives), "warc-members")
    release(spark, start, members)
    return read_pages(members)
