"""A deterministic sharded WARC writer, and its reader.

Records are sorted by key across shards (range partitioning), each shard is one task. A shard rolls
to a new file once the compressed size would pass ``most_bytes``; every record is a gzip member of
its own. Headers are made anew from the row: record ids from the key and the payload, digests from
the bytes, one fixed date, so that the same rows give the same files. A file is written under a
temporary name and then renamed to a name that holds its own digest: attempts of a lost or doubled
task rename equal bytes to the same name. Each task then gives its files' manifest rows, and the
manifest is written last, by Spark's own commit. Readers trust only what a manifest names; what
stray attempts leave behind is never read.

Payloads of at least ``revisit_bytes`` that repeat are stored once: the record with the largest key
is the response, others are revisits of it. The choice is made on digests alone; the sort brings a
revisit's verdict and its row together, so page bodies are shuffled once.

Defined results: a null payload is empty, a null target is the empty string; rows with a null key
are written as responses but never chosen as the response of others; of rows with one key
and one payload all are responses or all revisits; other columns are ignored; an empty table gives
an empty manifest and no file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bounded_batches

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"
#: Bytes of a file that the reader holds at a time.
READ = 1 << 20


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def block(headers: list[tuple[str, str]], first: bytes) -> bytes:
    lines = [first, *(f"{k}: {v}".encode() for k, v in headers)]
    return END.join(lines) + END + END


def record_id(key: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{key}/{digest}')}>"


def clean(value: str) -> str:
    """A header value: line ends would break the block."""
    return " ".join(value.split("\r")).replace("\n", " ")


def record(key: int | None, target: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response or revisit record, uncompressed. A revisit has the HTTP header alone."""
    digest = hashlib.sha1(payload).hexdigest()
    http = block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], b"HTTP/1.1 200 OK")
    body = http + payload if refers_to is None else http
    kind = "response" if refers_to is None else "revisit"
    base32 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key, digest, kind)), ("WARC-Date", DATE), ("WARC-Target-URI", clean(target))]
    if key is not None:
        headers.append(("X-Row-Key", str(key)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to, digest, "response")), ("X-Refers-To-Row-Key", str(refers_to)), ("WARC-Profile", PROFILE)]
    headers += [("WARC-Block-Digest", base32(body)), ("WARC-Payload-Digest", base32(payload)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return block(headers, b"WARC/1.1") + body + END + END


def info() -> bytes:
    body = b"software: spanloom\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, hashlib.sha1(body).hexdigest(), "warcinfo")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return block(head, b"WARC/1.1") + body + END + END


def member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


@dataclass
class Roller:
    """Writes a shard's records to files of about ``most_bytes`` and keeps their manifest rows."""

    uri: str
    most_bytes: int
    level: int

    def __post_init__(self) -> None:
        self.fs, self.folder = store(self.uri)
        self.out = None
        self.done: list[dict] = []
        self.first_key = self.last_key = None

    def add(self, key: int | None, data: bytes) -> None:
        packed = member(data, self.level)
        if self.out is not None and self.size + len(packed) > self.most_bytes and self.records:
            self.close()
        if self.out is None:
            self.temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size = self.records = 0
            self.digest = hashlib.sha256()
            self.first_key = key
            self._put(member(info(), self.level))
        self._put(packed)
        self.records += 1
        self.last_key = key

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"{self.first_key}-{self.last_key}-{self.digest.hexdigest()[:24]}.warc.gz"
        self.fs.move(self.temporary, f"{self.folder}/{name}")
        self.done.append({"file": name, "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest(), "first_key": self.first_key, "last_key": self.last_key})
        self.out = None


MANIFEST = "file string, records long, bytes long, sha256 string, first_key long, last_key long"
_manifest = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64())])


def write_archives(df: DataFrame, uri: str, key: str = "page_id", target: Column | str = "url", payload: Column | str = "html", revisit_bytes: int = 1_000, most_bytes: int = 256 << 20, shards: int | None = None, level: int = 6) -> DataFrame:
    """Writes ``df`` as WARC files under the shared folder ``uri``; gives the committed manifest."""
    spark = df.sparkSession
    body = F.coalesce((F.col(payload) if isinstance(payload, str) else payload).cast("binary"), F.lit(b"").cast("binary"))
    pages = df.select(F.col(key).cast("long").alias("key"), F.coalesce((F.col(target) if isinstance(target, str) else target).cast("string"), F.lit("")).alias("target"), body.alias("payload"))
    slim = pages.where(F.length("payload") >= revisit_bytes).select("key", F.sha1("payload").alias("digest")).where(F.col("key").isNotNull())
    groups = slim.groupBy("digest").agg(F.max("key").alias("response"), F.min("key").alias("least")).where("response <> least")
    verdicts = slim.join(groups.select("digest", "response"), "digest").where("key <> response").select("key", "digest", "response").distinct()
    tagged = verdicts.select("key", F.lit(0).alias("tag"), "digest", "response", F.lit("").alias("target"), F.lit(None).cast("binary").alias("payload")).unionByName(
        pages.select("key", F.lit(1).alias("tag"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("response"), "target", "payload")
    )
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = tagged.repartitionByRange(n, "key").sortWithinPartitions("key", "tag", "digest", "target", F.sha1("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller(uri, most_bytes, level)
        at, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != at:
                    at, known = row["key"], {}
                if row["tag"] == 0:
                    known[row["digest"]] = row["response"]
                else:
                    refers = known.get(hashlib.sha1(row["payload"]).hexdigest()) if known else None
                    roll.add(at, record(at, row["target"], row["payload"], refers))
        roll.close()
        if roll.done:
            yield pa.RecordBatch.from_pylist(roll.done, schema=_manifest)

    fs, folder = store(uri)
    fs.create_dir(f"{folder}/_temporary", recursive=True)
    bounded_batches(spark)
    manifest = f"{uri}/_manifest"
    sort.mapInArrow(run, MANIFEST).write.parquet(manifest)
    fs.delete_dir(f"{folder}/_temporary")
    return spark.read.schema(MANIFEST).parquet(manifest)


class BrokenArchive(ValueError):
    """A file does not hold what its manifest row or a record's digest says."""


def members(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    inflate, parts, empty = zlib.decompressobj(31), [], True
    for data in stream:
        while data:
            parts.append(inflate.decompress(data))
            empty = False
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, empty = zlib.decompressobj(31), [], True
    if not empty:
        raise BrokenArchive("the file ends within a member")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of a record."""
    head, _, rest = data.partition(END + END)
    first, *lines = head.split(END)
    if not first.startswith(b"WARC/"):
        raise BrokenArchive("no WARC record")
    headers = {}
    for line in lines:
        name, _, value = line.decode("utf-8").partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    if rest[size:] != END + END:
        raise BrokenArchive("a block of another length")
    return headers, rest[:size]


def verified(headers: dict[str, str], body: bytes) -> dict:
    """A record's row; the digests of block and, where it is stored, payload must hold."""
    base32 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    head, _, payload = body.partition(END + END)
    http = dict(line.split(b": ", 1) for line in head.split(END)[1:])
    kind = headers["warc-type"]
    if headers["warc-block-digest"] != base32(body) or kind == "response" and headers["warc-payload-digest"] != base32(payload):
        raise BrokenArchive(f"digests differ at {headers.get('x-row-key')}")
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "key": number("x-row-key"),
        "target": headers["warc-target-uri"],
        "record_type": kind,
        "refers_to": number("x-refers-to-row-key"),
        "payload_bytes": int(http[b"Content-Length"]),
        "payload_digest": base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex(),
        "payload": payload if kind == "response" else None,
    }


RECORD = "key long, target string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_record = pa.schema([("key", pa.int64()), ("target", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, manifest: DataFrame, uri: str, with_payload: bool = True) -> DataFrame:
    """Records of the manifest's files, each checked: key, target, record_type, refers_to, payload_*."""

    def lines(fs: pafs.FileSystem, path: str, digest: object) -> Iterator[bytes]:
        with fs.open_input_stream(path, compression=None) as f:
            while data := f.read(READ):
                digest.update(data)
                yield data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(uri)
        for batch in batches:
            for entry in batch.to_pylist():
                digest, rows, size, found = hashlib.sha256(), [], 0, 0
                for data in members(lines(fs, f"{folder}/{entry['file']}", digest)):
                    headers, body = parse(data)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    row = verified(headers, body)
                    found += 1
                    if not with_payload:
                        row["payload"] = None
                    size += len(row["payload"] or b"") + 256
                    rows.append(row)
                    if size > READ:
                        yield pa.RecordBatch.from_pylist(rows, schema=_record)
                        rows, size = [], 0
                if found != entry["records"] or digest.hexdigest() != entry["sha256"]:
                    raise BrokenArchive(f"{entry['file']} differs from its manifest row: {json.dumps(entry)}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_record)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "file").mapInArrow(run, RECORD)
