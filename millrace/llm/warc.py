"""WARC: a deterministic sharded writer and its reader.

Records are sorted by (shard, payload digest, page id), where a shard is a fixed range of the digests, so the
same pages always give the same files. Copies of one payload stand side by side: the first becomes a response,
the others revisit it, without a join. The copies of very common payloads (more than one in HOT_SHARE rows,
hence at most HOT_SHARE payloads) are spread over all shards; their first pages go to the executors as a
broadcast of at most HOT_SHARE rows.

Files are gzip members, one a record, and roll when their compressed size reaches roll_bytes. A task writes
under names with its attempt's token in a temporary folder; the manifest, a Parquet table, lists the attempt
that counted, and the commit job renames by it, so lost tasks leave nothing behind that a reader sees. Files go
through Arrow's file systems, so the folder may be on any store that these reach.

Defined results: a null payload is empty; a null url has no WARC-Target-URI header; null ids are written as such,
sort after all others and are still paired by payload; repeated rows each give a record; an empty table gives an
empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import shared_dir, written

ROLL_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
LEAST_SHARDS = 64
HOT_SHARE = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard int, part int, path string, temporary string, records bigint, bytes bigint, sha1 string"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, path string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, str]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _clean(url: str) -> str:
    """A header value may hold no line breaks."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _uri(page_id: int | None, digest: str, occurrence: int = 0) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{occurrence}>"


def record(page_id: int | None, occurrence: int, url: str | None, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """One WARC/1.1 record; refers_to is the 1-tuple of the response's id for a revisit."""
    digest = base32_sha1(payload)
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http + (b"" if refers_to else payload)
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", _uri(page_id, digest, occurrence)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", _clean(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to[0], digest))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


class _Roll:
    """Writes the files of one task; a file that a failure leaves behind is never listed."""

    def __init__(self, folder: str, roll_bytes: int):
        self.folder, self.roll_bytes, self.token = folder, roll_bytes, uuid.uuid4().hex
        self.store, self.root = _store(folder)
        self.out, self.at, self.done = None, (-1, 0), []

    def add(self, shard: int, member: bytes) -> None:
        if self.out is None or self.at[0] != shard or self.bytes >= self.roll_bytes:
            part = self.at[1] + 1 if self.at[0] == shard and self.out is not None else 0
            self.close()
            self.at, self.records, self.bytes, self.sha1 = (shard, part), 0, 0, hashlib.sha1()
            self.name = f"_temporary/{self.token}-{shard:05d}-{part:05d}.warc.gz"
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(member)
        self.sha1.update(member)
        self.records += 1
        self.bytes += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            shard, part = self.at
            self.done.append({"shard": shard, "part": part, "path": f"warc-{shard:05d}-{part:05d}.warc.gz", "temporary": self.name, "records": self.records, "bytes": self.bytes, "sha1": self.sha1.hexdigest()})
            self.out = None


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None, level: int = 6) -> DataFrame:
    """Writes pages (page_id, url, html) below folder and returns the committed manifest."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.sum(F.length("payload")).alias("bytes"))
    groups = written(groups)
    total, size = groups.agg(F.sum("n"), F.sum("bytes")).first()
    total, size = total or 0, size or 0
    n = shards or max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    hot = {r["digest"]: r["first"] for r in groups.where((F.col("n") > 1) & (F.col("n") * HOT_SHARE > total)).select("digest", "first").collect()}
    hot_ids = spark.sparkContext.broadcast(hot)
    prefix = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    spread = F.pmod(F.xxhash64("page_id"), F.lit(n)).cast("int")
    even = F.floor(prefix * n / (1 << 32)).cast("int")
    if hot:
        known = spark.createDataFrame([(d,) for d in hot], "digest string").withColumn("hot", F.lit(True))
        rows = rows.join(F.broadcast(known), "digest", "left").withColumn("shard", F.when(F.col("hot"), spread).otherwise(even))
    else:
        rows = rows.withColumn("shard", even)
    rows = rows.select("shard", "digest", "page_id", "url", "payload")
    rows = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "digest", F.col("page_id").asc_nulls_last(), "url")
    _store(folder)[0].create_dir(f"{_store(folder)[1]}/_temporary", recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Roll(folder, roll_bytes)
        last, first, seen = None, None, (None, -1)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, digest, page_id, url, payload = (batch.column(k)[i].as_py() for k in range(5))
                starts = digest != last
                if starts:
                    last, first = digest, page_id
                occurrence = seen[1] + 1 if not starts and seen[0] == page_id else 0
                seen = (page_id, occurrence)
                refers = None
                if len(payload) >= min_revisit_bytes:
                    if digest in hot_ids.value:
                        if hot_ids.value[digest] != page_id or occurrence:
                            refers = (hot_ids.value[digest],)
                    elif not starts:
                        refers = (first,)
                files.add(shard, gzip.compress(record(page_id, occurrence, url, payload, refers), level, mtime=0))
        files.close()
        yield pa.RecordBatch.from_pylist(files.done, schema=_manifest_schema())

    listed = rows.mapInArrow(run, StructType.fromDDL(MANIFEST))
    listed.write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    commit(manifest, folder)
    return manifest


def _manifest_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def commit(manifest: DataFrame, folder: str) -> None:
    """Renames the listed files; may run again after a failure at any point, or after success. The marker comes last."""
    from pyarrow.fs import FileType

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(f"{root}/{row['path']}").type == FileType.NotFound:
                    store.move(f"{root}/{row['temporary']}", f"{root}/{row['path']}")
            yield pa.RecordBatch.from_pydict({"path": batch.column(batch.schema.get_field_index("path"))})

    files, records = manifest.mapInArrow(rename, "path string").count(), manifest.agg(F.sum("records")).first()[0] or 0
    store, root = _store(folder)
    if store.get_file_info(f"{root}/_temporary").type != FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")
    with store.open_output_stream(f"{root}/_COMMITTED.json") as out:
        out.write(json.dumps({"files": files, "records": records}).encode())


def resume(spark: SparkSession, folder: str) -> DataFrame:
    """Commits an archive whose manifest was written before a failure, and returns the manifest."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    commit(manifest, folder)
    return manifest


def parse(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every gzip member of a file, one in memory at a time."""
    data, unzip, plain = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if plain:
                    raise ValueError("the archive is cut short")
                return
        plain.append(unzip.decompress(data))
        data = b""
        if unzip.eof:
            data = unzip.unused_data
            whole = io.BytesIO(b"".join(plain))
            if not whole.readline().startswith(b"WARC/1."):
                raise ValueError("not a WARC record")
            fields = {}
            while line := whole.readline().strip():
                k, _, v = line.decode().partition(":")
                fields[k.lower()] = v.strip()
            yield fields, whole.read(int(fields["content-length"]))
            unzip, plain = zlib.decompressobj(31), []


def _page(uri: str) -> int | None:
    number = uri.strip("<>").split(":")[2]
    return int(number) if number else None


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of a committed archive; payload and block digests are recomputed and must agree."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("path", "bytes")
    files = manifest.repartition(max(1, manifest.count()), "path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for fields, block in parse(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if f"sha1:{base32_sha1(block)}" != fields["warc-block-digest"] or (not revisit and base32_sha1(payload) != digest):
                            raise ValueError(f"a digest in {path} does not agree")
                        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        held.append({"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _page(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit or not with_payload else payload, "path": path})
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.mapInArrow(run, StructType.fromDDL(RECORD))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages as an archive, reads it back and returns the digest of each record."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    write(pages, folder)
    return read(spark, folder, with_payload=False).drop("payload", "path", "url")
