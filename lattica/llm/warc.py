"""WARC archives compressed record by record with a dictionary of their own.

An archive (.warc.zst) begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary trained on the archive's records, followed by one frame for each record, compressed
with it, so any record can be read alone. Archives whose records are too few to train on get
their first bytes as a raw-content dictionary.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id
is a response, the others are revisits without payload that refer to it. Only rows whose digest
a Bloom filter of repeated digests passes are shuffled; the other payloads go from the scan to
their archive. Archives are written by attempt and named in a manifest table, so a task that is
run again leaves no records twice.

Defined cases: a null html is an empty payload; a null url gives a record without target; rows
that repeat the smallest page_id with the same payload are all responses; a row without page_id
revisits if another has one; an empty table makes no archive; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import bloom
from lattica.llm import text as tx
from lattica.session import ship, temporary, written

MAGIC = 0x184D2A5D
MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20  # of records before compression
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 6 << 20  # of an archive's records that its dictionary is trained on, evenly chosen
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
_SPACE = uuid.UUID("9f0f6bd6-91a0-4f5b-8a5c-7f1e4a2f7c11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC/1.1 record with an HTTP block."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page if page is not None else uuid.uuid4())), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if page is not None:
        head.append(("Page-ID", str(page)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A dictionary of the records: trained, or the first bytes of so few that training fails."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    chosen = records[::step]
    size = min(DICTIONARY_BYTES, max(256, total // 16))
    try:
        if len(chosen) >= 16:
            return zstandard.train_dictionary(size, chosen)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(records[:16])[:size].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The bytes of an archive."""
    import zstandard

    d = dictionary(records)
    raw = d.as_bytes()
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(c.compress, records)])


def records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    import zstandard

    at, d = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == MAGIC:
        n = struct.unpack_from("<I", content, 4)[0]
        d, at = zstandard.ZstdCompressionDict(content[8 : 8 + n]), 8 + n
    while at < len(content):
        z = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        out = z.decompress(memoryview(content)[at:])
        if not z.eof:
            raise ValueError("an archive ends inside a record")
        at = len(content) - len(z.unused_data)
        yield out


def parse(rec: bytes) -> dict:
    """Headers and payload of a record; payload is None for a revisit."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload_bytes": length, "payload": None if fields["WARC-Type"] == "revisit" else payload}


def _writer(folder: str, limit: int, run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        ctx = TaskContext.get()
        held: list[bytes] = []
        size = n = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, n
            name = f"part-{run_id}-{ctx.partitionId():06d}-{n:05d}-{ctx.taskAttemptId()}.warc.zst"
            store.create_dir(root, recursive=True)
            data = archive(held)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            done = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "raw_bytes", "bytes"])
            held, size, n = [], 0, n + 1
            return done

        for b in tx.slices(batches, "payload"):
            for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= limit:
                    yield flush()
        if held:
            yield flush()

    return run


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    big = rows.where(F.octet_length("payload") >= least)
    repeated = written(big.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"), "repeated")
    tested = bloom.tested(rows, "digest", bloom.build(repeated, "digest"), "maybe")
    kind = pages.schema["page_id"].dataType
    new = tested.where("not maybe").drop("maybe").withColumn("refers_to", F.lit(None).cast(kind))
    again = tested.where("maybe").drop("maybe").join(repeated, "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    again = again.withColumn("refers_to", F.when(other, F.col("first_id"))).drop("first_id")
    return new.unionByName(again)


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """The manifest, already written: path, records, raw_bytes and bytes of each archive.

    An archive's name holds its run and its task's attempt, so a task that runs again overwrites nothing; what attempts
    that don't count have left in the folder is deleted when the manifest is there."""
    ship(pages.sparkSession)
    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    run_id = _run_id()
    manifest = written(rows.mapInArrow(_writer(folder, limit, run_id), "path string, records long, raw_bytes long, bytes long"), "manifest")
    _without_orphans(manifest, folder, f"part-{run_id}-")
    return manifest


def _run_id() -> str:
    return uuid.uuid4().hex[:12]


def _without_orphans(manifest: DataFrame, folder: str, prefix: str) -> None:
    """Deletes archives of this run that the manifest doesn't name (archives are few beside their records)."""
    spark = manifest.sparkSession
    known = {r["path"].rsplit("/", 1)[1] for r in manifest.select("path").toLocalIterator()}
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for x in fs.listStatus(where) if fs.exists(where) else ():
        if x.getPath().getName().startswith(prefix) and x.getPath().getName() not in known:
            fs.delete(x.getPath(), False)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = ["page", "url", "record_type", "refers", "payload_bytes", "payload_digest", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for b in batches:
        for i in range(b.num_rows):
            rows, size = [], 0
            for rec in records(b["content"][i].as_py()):
                got = parse(rec)
                f, payload = got["fields"], got["payload"]
                digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                if payload is not None and (len(payload) != got["payload_bytes"] or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"record {f['WARC-Record-ID']} is damaged")
                rows.append((f.get("Page-ID"), f.get("WARC-Target-URI"), f["WARC-Type"], f.get("Refers-To-Page-ID"), got["payload_bytes"], digest, payload))
                size += len(rec)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(spark, paths: list[str], id_type: str = "long") -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of every record.

    The paths are those of a manifest; like any scan's file list they are known to the driver."""
    ship(spark)
    schema = "page string, url string, record_type string, refers string, payload_bytes long, payload_digest string, payload binary"
    if not paths:
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.format("binaryFile").load(paths).select("content").mapInArrow(_reader, schema)
    return found.select(F.col("page").cast(id_type).alias("page_id"), "url", "record_type", F.col("refers").cast(id_type).alias("refers_to"), "payload_bytes", "payload_digest", "payload")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages into archives and reads them back."""
    spark = pages.sparkSession
    manifest = write_archives(pages, folder or temporary(spark, "warc"))
    paths = [r["path"] for r in manifest.select("path").toLocalIterator()]
    return read_archives(spark, paths, pages.schema["page_id"].dataType.simpleString())


def as_digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
