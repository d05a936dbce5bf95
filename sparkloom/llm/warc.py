"""WARC archives written and read as a chunked record table.

A payload is never handled whole in Python: Spark cuts it into chunk rows
(record identifier, chunk number, bytes), the writer streams them into the
archive's file, and the reader streams every file back as chunk rows that
carry the running SHA-1 of their record, so that the last row of a record has
the digest of the full payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"  # archives of the same records are equal, so a rerun task writes the same bytes


def plan_records(df: DataFrame, id_col: str, url_col: str, text_col: str, min_bytes: int = 0) -> DataFrame:
    """Decide for every row whether it is a response or revisits an equal payload.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the
    largest id is the response; among rows of the same largest id, and of null
    ids, all are.  Only digests and ids meet in the shuffle, and the largest
    ids are pre-aggregated, so a payload that a third of the rows share costs
    one row per task.
    """
    # Only payloads that several rows share need a decision; as a written table its size is known
    # to the planner, which broadcasts it if small and else deals both sides by digest.
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    shared = rows.select("id", "digest").groupBy("digest").agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = written(shared, "warc-shared")
    joined = rows.join(first, "digest", "left")
    revisit = (F.octet_length("payload") >= min_bytes) & (F.col("id") < F.col("last_id"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("last_id")))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, url, refers_to, digest, bytes, chunk_no, chunks, data): a row per chunk, one for an empty payload.

    Rows of a record follow each other in one partition, in order.
    """
    size = F.octet_length("payload")
    chunks = F.greatest(F.lit(1), F.ceil(size / F.lit(chunk)).cast("int"))
    cut = records.select("id", "url", "refers_to", "digest", size.cast("long").alias("bytes"), chunks.alias("chunks"), "payload")
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    return cut.withColumn("data", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("payload")


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def _head(row: dict) -> bytes:
    """The header block of a record, with its empty line."""
    rid = "null" if row["id"] is None else str(row["id"])
    kind = "response" if row["refers_to"] is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, rid)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(row['url'].split())}",
        f"X-Row-ID: {rid}",
        f"X-Payload-Length: {row['bytes']}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}",
        "Content-Type: application/octet-stream",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Row: {row['refers_to']}"]
    lines.append(f"Content-Length: {row['bytes'] if kind == 'response' else 0}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def write_warc(chunks: DataFrame, path: str) -> DataFrame:
    """Write chunk rows as one archive per partition below `path`; returns (file, records) lazily.

    A file is written under a name of its attempt and returned only if the
    task succeeds, so a task that runs again leaves no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(path)
        name, out, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                if row["chunk_no"] == 0:
                    member = zlib.compressobj(3, wbits=31)  # a gzip member of its own for each record
                    out.write(member.compress(_head(row)))
                    records += 1
                if row["refers_to"] is None:
                    out.write(member.compress(row["data"]))
                if row["chunk_no"] == row["chunks"] - 1:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([records], pa.int64())})

    return chunks.mapInArrow(run, "file string, records long")


def _records(stream, chunk: int) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Headers of each record and its payload in pieces of at most `chunk` bytes."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            head[key.strip().lower()] = value.strip()
        left = int(head["content-length"])

        def pieces(left: int = left) -> Iterator[bytes]:
            while left:
                data = stream.read(min(chunk, left))
                if not data:
                    raise ValueError("archive ends inside a record")
                left -= len(data)
                yield data

        yield head, pieces()


READ = "file string, record_no long, row_id string, record_type string, refers_to string, stated_length long, stated_digest string, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def read_warc(files: DataFrame, path: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Stream the archives named in `files` as chunk rows with running digests.

    A record without payload gives one row with no data.  Each file is read by
    one task, and no more than a chunk of it is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(path)
        schema = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("row_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("stated_length", pa.int64()), ("stated_digest", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as raw:
                    rows, held = [], 0
                    for number, (head, pieces) in enumerate(_records(gzip.GzipFile(fileobj=raw), chunk)):
                        sha, size, total = hashlib.sha1(), 0, int(head["content-length"])
                        stated = head["warc-payload-digest"].removeprefix("sha1:")
                        for k, data in enumerate(pieces if total else iter([b""])):
                            sha.update(data)
                            size += len(data)
                            rows.append((name, number, head["x-row-id"], head["warc-type"], head.get("x-refers-to-row"), int(head["x-payload-length"]), stated, k, data if with_data else None, size, base64.b32encode(sha.digest()).decode(), size == total))
                            held += len(data)
                            if held > 8 << 20 or len(rows) >= 5000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                                rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.mapInArrow(run, READ)


def archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row of `df` below `path`; returns the manifest (file, records), written.

    Null payloads are empty records, null ids are kept as such; rows that
    repeat are each written.  An empty table writes no archive.
    """
    return written(write_warc(chunk_rows(plan_records(df, id_col, url_col, text_col, min_bytes)), path), "warc-manifest")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, read the archives back and report each record.

    A response's digest and length are those of the bytes read back; a revisit
    has no payload in the archive, so its own are the ones its record states.
    """
    path = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    manifest = archive(pages, path)
    # A number of partitions that is given is not coalesced: each file becomes a task of its own.
    files = manifest.repartitionByRange(max(1, manifest.count()), "file")
    ends = read_warc(files, path, with_data=False).filter("last")
    own = F.col("record_type") == "response"
    return ends.select(
        F.expr("try_cast(row_id AS bigint)").alias("page_id"),
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("stated_length")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
