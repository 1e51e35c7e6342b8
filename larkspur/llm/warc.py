"""Web pages as WARC records in ZIP-packaged archives, written and read back.

Each archive is a ZIP file of stored members: ``archive/data.warc.gz`` (one
gzip member for each record), ``indexes/index.cdxj`` (a line for each record
with its place and length) and ``datapackage.json``. A reader parses the
directory, reads the index, and range-reads each record.

Payloads of at least 100 bytes that are equal are stored once, by the row of
the smallest id (its record is a response); the others' records are revisits,
which hold the headers only. Smaller payloads are all responses.

Defined results: a null payload is an empty one; a null id counts as larger
than any other; repeated rows of the smallest id are responses each; a null
URL is written as ``urn:none``. Other columns of the input are not read. An
archive takes records up to ARCHIVE_BYTES (or one larger record), so a task
holds one archive in memory. File names are new for each attempt of a task,
and only those that the attempt reports are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.frames import BATCH_ROWS, map_batches
from larkspur.llm.storage import few, gathered, new_path, written
from larkspur.llm.zip_archive import FileSource, ZipArchive, write_stored

ARCHIVE_BYTES = 16 << 20  # of payloads
LEAST_SHARED = 100  # bytes
_WARC, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def record_types(df: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """key, url, payload (null for revisits), payload_bytes, payload_digest, refers_to."""
    raw = F.coalesce(F.encode(F.col(payload), "UTF-8") if df.schema[payload].dataType == T.StringType() else F.col(payload), F.lit(b""))
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), raw.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    shared = F.col("payload_bytes") >= LEAST_SHARED
    first = rows.where(shared).groupBy("payload_digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    # payloads are large: they are shuffled only where the digests of repeated ones are too many to broadcast
    joined = rows.where(shared).join(few(written(gathered(first), "warc-repeated"), 256), "payload_digest", "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    joined = joined.select("key", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to"))
    return joined.unionByName(rows.where(~shared).withColumn("refers_to", F.lit(None).cast(df.schema[key].dataType)))


def _line(value) -> str:
    """A header value: line ends would end the header."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _id(key) -> str:
    return "<urn:page:" + base64.urlsafe_b64encode(json.dumps(key).encode()).decode() + ">"


def _key(uri: str):
    return json.loads(base64.urlsafe_b64decode(uri.removeprefix("<urn:page:").removesuffix(">")))


def record(row: dict) -> bytes:
    """One WARC/1.1 record."""
    revisit = row["refers_to"] is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    if not revisit:
        block += row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(row['key'])}", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_line(row['url']) if row['url'] is not None else 'urn:none'}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(row['refers_to'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    warc = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    if len(block) != int(warc["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode("utf-8").split("\r\n")[1:]), payload


def _archive(rows: list[dict]) -> bytes:
    data, index = bytearray(), []
    for i, row in enumerate(rows):
        member = gzip.compress(record(row), 4, mtime=0)
        index.append(f"{i:012d} 20000101000000 " + json.dumps({"offset": len(data), "length": len(member), "digest": "sha256:" + row["payload_digest"], "filename": "data.warc.gz"}))
        data += member
    text = "\n".join(index).encode()
    about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": n.rsplit("/", 1)[1], "path": n, "hash": "sha256:" + hashlib.sha256(d).hexdigest(), "bytes": len(d)} for n, d in ((_WARC, data), (_INDEX, text))]}
    return write_stored({_WARC: bytes(data), _INDEX: text, "datapackage.json": json.dumps(about).encode()})


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write record_types() rows as archives; returns (archive, records, bytes), itself written."""
    folder = folder or new_path(rows.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            data, name = _archive(held), f"{uuid.uuid4().hex}.wacz"
            with where.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            made = pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [len(held)], "bytes": [len(data)]})
            held.clear()
            return made

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    n = len(row["payload"] or b"")
                    if held and (size + n > ARCHIVE_BYTES or len(held) >= 50_000):
                        yield flush()
                        size = 0
                    held.append(row)
                    size += n
        if held:
            yield flush()

    return written(rows.mapInArrow(run, _MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, key_type: T.DataType = T.LongType()) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload: each record of each archive, range-read through its index."""
    schema = T.StructType([
        T.StructField("page_id", key_type), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("refers_to", key_type), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()),
    ])
    names = schema.names

    def rows(uri: str) -> Iterator[tuple]:
        source = FileSource(uri)
        try:
            archive = ZipArchive(source)
            for line in archive.read(_INDEX).decode().splitlines():
                at = json.loads(line.split(" ", 2)[2])
                warc, http, payload = parse_record(gzip.decompress(archive.read_range(_WARC, at["offset"], at["length"])))
                told = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                url = None if warc["WARC-Target-URI"] == "urn:none" else warc["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                if warc["WARC-Type"] == "response":
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest != told:
                        raise ValueError(f"a damaged payload in {uri}")
                    yield _key(warc["WARC-Record-ID"]), len(payload), digest, "response", None, url, payload
                else:
                    yield _key(warc["WARC-Record-ID"]), int(http["Content-Length"]), told, "revisit", _key(warc["WARC-Refers-To"]), url, None
        finally:
            source.close()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for uri in batch.column("archive").to_pylist():
            held, size = [], 0
            for row in rows(uri):
                held.append(row)
                size += len(row[-1] or b"")
                if len(held) >= BATCH_ROWS or size >= 8 << 20:
                    yield dict(zip(names, zip(*held)))
                    held, size = [], 0
            if held:
                yield dict(zip(names, zip(*held)))

    spark = manifest.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_batches(manifest.select("archive").repartition(tasks), run, schema)
