"""Operator 5: Zstandard WARC archives, written and read back.

An archive starts with a skippable frame that holds the dictionary; each record
is a Zstandard frame of its own. The reader loads the dictionary, decodes frame
by frame, and checks every record: version line, mandatory headers, block and
payload lengths, digest and the closing blank lines.

Of pages with equal payloads of ``LEAST`` bytes or more the one with the largest
id is stored, the others become revisit records that refer to it. Archives are
real files in the shared folder, through the file system that its address names.
A task that is run again writes other names; a manifest, committed by Spark,
says which archives count.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, hot_join, scratch, slices, written

LEAST = 1000
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16384, 64, 16384
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_ID = "<urn:x-page:{}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record around an HTTP response; a revisit has its HTTP header only. A null id is written as ``null``."""
    name = lambda x: RECORD_ID.format("null" if x is None else x)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records as one archive. The dictionary is trained on a bounded sample of them; where there is too little to train on, it is a plain one of their first bytes."""
    sample = [r[:SAMPLE_BYTES] for r in records[:: max(1, len(records) // SAMPLES)][:SAMPLES]]
    try:
        raw = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1"
    compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True).compress
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(map(compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames after the dictionary's."""
    if len(data) < 8:
        raise ValueError("not a Zstandard archive: too short")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + size > len(data):
        raise ValueError("not a Zstandard archive: no leading dictionary frame")
    raw = data[8 : 8 + size]
    if raw[:4] == FRAME:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    open_frame, view, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), memoryview(data), 8 + size
    while at < len(data):
        if bytes(view[at : at + 4]) != FRAME:
            raise ValueError(f"no frame at byte {at}")
        one, out = open_frame.decompressobj(), []
        while not one.eof:
            piece = view[at : at + 16384]
            if not len(piece):
                raise ValueError("the last frame is cut off")
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of one record; ValueError if it isn't sound."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError(f"no header: {line[:60]!r}")
        headers[k.strip().decode().lower()] = v.strip().decode()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(headers):
        raise ValueError(f"headers missing: {sorted(missing)}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes; its header says {size}")
    http, mark, payload = rest[:size].partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP response in the block")
    for line in http.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers["http:" + k.strip().decode().lower()] = v.strip().decode()
    if headers["warc-type"] == "response":
        if len(payload) != int(headers["http:content-length"]):
            raise ValueError("the payload's length isn't what its header says")
        if headers.get("warc-payload-digest") != "sha1:" + hashlib.sha1(payload).hexdigest():
            raise ValueError("the payload's digest isn't what its header says")
    elif headers["warc-type"] != "revisit" or payload:
        raise ValueError(f"unexpected record: {headers['warc-type']}")
    return headers, payload


def row(headers: dict[str, str], payload: bytes) -> tuple:
    number = lambda x: None if x is None or x == RECORD_ID.format("null") else int(x.rpartition(":")[2][:-1])
    return (
        number(headers["warc-record-id"]), int(headers["http:content-length"]), headers["warc-payload-digest"].removeprefix("sha1:"),
        headers["warc-type"], number(headers.get("warc-refers-to")),
    )


def store(root: str):
    """(file system, path) of an address with a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def qualified(spark: SparkSession, root: str) -> str:
    """The address with the scheme and host that it has by Spark's settings: a bare path may be in any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    address = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"file://{address.getPath()}" if address.getScheme() == "file" else address.toString()


def resolve(pages: DataFrame, least: int = LEAST, hot: int = 256) -> DataFrame:
    """(page_id, url, payload, digest, response_id): response_id is null unless another page's payload is the same and counts.

    Digests of very many pages are joined apart; see hot_join.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = slim.withColumn("digest", F.sha1("payload"))
    groups = keyed.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = hot_join(keyed, groups, "digest", "n", F.col("page_id"), hot)
    return joined.select("page_id", "url", "payload", "digest", "response_id")


def write_archives(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page; returns the manifest (name, n_records, n_bytes) of the archives below ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(root)
        held, size, made = [], 0, []

        def flush():
            nonlocal held, size
            name, data = f"{uuid.uuid4().hex}.warc.zst", archive(held)
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            made.append((name, len(held), len(data)))
            held, size = [], 0

        for batch in batches:
            for part in slices(batch, 2):
                for page_id, url, payload, digest, response_id in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append(record(page_id, url, payload, digest, response_id, response_id is not None and response_id != page_id))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "n_records", "n_bytes"])

    files, base = store(root)
    files.create_dir(base, recursive=True)
    return written(resolve(pages).mapInArrow(run, "name string, n_records long, n_bytes long"))


def read_archives(spark: SparkSession, root: str, manifest: DataFrame | None = None, payload: bool = False) -> DataFrame:
    """A row for each record of the archives below ``root``, in the manifest if one is given; with ``payload``, also the stored bytes (null in a revisit)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(root)
    if manifest is not None:
        # Where a task was run again, what its lost attempt wrote is left out; what the manifest has must be there, whole.
        # Names and lengths only are joined; contents move where there are strays.
        named = found.select("path", F.col("length").alias("n_found"), F.element_at(F.split("path", "/"), -1).alias("name"))
        both = written(manifest.select("name", "n_bytes").join(named, "name", "full"))
        lost = both.where("n_bytes is not null and (n_found is null or n_found <> n_bytes)").select("name").first()
        if lost:
            raise ValueError(f"an archive is missing or cut short: {lost['name']}")
        if not both.where("n_bytes is null").isEmpty():
            found = found.join(both.where("n_bytes is not null").select("path"), "path", "left_semi")
    schema = ROW + ", payload binary" * payload
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(c for c in batch.columns), strict=True):
                rows, held = [], 0
                for i, raw in enumerate(frames(data.as_py())):
                    try:
                        headers, body = parse(raw)
                    except ValueError as e:
                        raise ValueError(f"{path}, record {i}: {e}") from e
                    rows.append(row(headers, body) + ((body if headers["warc-type"] == "response" else None),) * payload)
                    held += payload * len(body)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return found.select("path", "content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from its archive.

    Null html counts as empty. Rows that repeat the largest id of their payload
    are all responses. Null ids stay null, and such a page refers to the largest
    id of its payload if there is one; where all are null, all are responses. Very
    long pages are records of their own size, in an archive alone if they pass its
    bound. An empty table gives no rows; extra columns are ignored.
    """
    spark = pages.sparkSession
    root = qualified(spark, scratch(spark))
    manifest = write_archives(pages, root)
    if manifest.isEmpty():
        return spark.createDataFrame([], ROW)
    return read_archives(spark, root, manifest)
