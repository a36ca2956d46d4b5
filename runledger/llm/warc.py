"""Deterministic sharded WARC archives: written, committed by manifest, and read back.

Records are range-sorted by page_id into shards with exact cuts. A shard is a
run of gzip files, each record its own member, rolled by compressed size. A
task writes under a name of its own attempt and renames when a file is whole;
equal input gives equal bytes, so a repeated attempt renames onto the same
content. Archives count once the manifest lists them.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from runledger.llm import ranges
from runledger.session import materialise

RECORDS_PER_SHARD = 4000
ROLL_BYTES = 16 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST_SCHEMA = "file string, shard int, records long, bytes long, sha1 string"
RECORD_SCHEMA = ("page_id long, uri string, record_type string, refers_to long, payload_bytes long, "
                 "payload_digest string, payload binary")


def base32_sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest, copy):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def _member(headers, block):
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def record(page_id, uri, payload, digest, refers_to=None, copy=0):
    """One compressed record with regenerated headers; refers_to makes it a revisit."""
    uri = "".join((uri or f"urn:page:{page_id}").split())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    return _member([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest, copy)),
        ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to, digest, 0) if revisit else None),
        ("Page-ID", page_id), ("Refers-To-Page-ID", refers_to),
        ("Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response")], block)


class _Shard:
    """Writes the files of one shard, each under a temporary name until it is whole."""

    def __init__(self, store, folder, attempt, number, roll_bytes):
        self.store, self.folder, self.attempt = store, folder, attempt
        self.number, self.roll_bytes, self.sequence = number, roll_bytes, 0
        self.stream, self.done = None, []

    def add(self, member):
        if self.stream is None:
            self.name = f"shard-{self.number:06d}-{self.sequence:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary/{self.attempt}-{self.name}"
            self.stream = self.store.open_output_stream(self.temporary)
            self.records = self.size = 0
            self.sha1 = hashlib.sha1()
        self.stream.write(member)
        self.records += 1
        self.size += len(member)
        self.sha1.update(member)
        if self.size >= self.roll_bytes:
            self.close()

    def close(self):
        if self.stream is None:
            return
        self.stream.close()
        self.store.move(self.temporary, f"{self.folder}/data/{self.name}")
        self.done.append((self.name, self.number, self.records, self.size, self.sha1.hexdigest()))
        self.stream, self.sequence = None, self.sequence + 1


def _writer(folder, roll_bytes):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, last, answered = None, None, {}
        for batch in batches:
            done = []
            for row in zip(*(batch.column(n).to_pylist() for n in ("shard", "page_id", "url", "html", "first_id"))):
                number, page_id, url, html, first_id = row
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.close()
                        done += shard.done
                    shard = _Shard(store, path, attempt, number, roll_bytes)
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = base32_sha1(payload)
                if last != page_id:
                    last, answered = page_id, {}
                copy = answered.get(digest, 0)
                answered[digest] = copy + 1
                refers_to = first_id if first_id is not None and (first_id != page_id or copy) else None
                shard.add(record(page_id, url, payload, digest, refers_to, copy))
            if done:
                yield _manifest(done)
        if shard is not None:
            shard.close()
            yield _manifest(shard.done)
    return run


def _manifest(rows):
    columns = list(zip(*rows)) or [[]] * 5
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      ["file", "shard", "records", "bytes", "sha1"])


def _first_of_copies(rows):
    """(digest, n, first_id) of payloads that several rows hold; counts combine before the shuffle."""
    return rows.groupBy("digest", "n").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter(
        F.col("copies") > 1).select("digest", "n", "first_id")


def write_archives(pages, folder, min_revisit_bytes=0, records_per_shard=RECORDS_PER_SHARD, roll_bytes=ROLL_BYTES):
    """Write pages(page_id, url, html) as WARC files below folder; returns the manifest.

    Of rows with equal payloads of at least min_revisit_bytes, that with the
    smallest page_id is the response and the others revisit it. Null html is an
    empty payload, a null url gets a urn. Of rows that repeat both page_id and
    payload the first is the response. Rows without page_id revisit others but
    are never referred to. An empty table gives an empty manifest; other
    columns are ignored. folder must be reachable from all executors.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").alias("n"))
    copies = materialise(_first_of_copies(keyed.select("page_id", "digest", "n").filter(
        F.col("n") >= min_revisit_bytes)), "warc-copies")
    lows, _ = ranges.cuts(rows, "page_id", records_per_shard)
    store, path = fs.FileSystem.from_uri(folder)
    for part in ("data", "_temporary"):
        store.create_dir(f"{path}/{part}", recursive=True)
    named = keyed.join(copies, ["digest", "n"], "left").select(
        ranges.range_of(ranges.key_of("page_id"), lows or [0]).alias("shard"), "page_id", "url", "html", "first_id", "digest")
    placed = named.repartitionById(max(len(lows), 1), "shard").sortWithinPartitions("shard", "page_id", "digest", "url")
    spark = pages.sparkSession
    placed.mapInArrow(_writer(folder, roll_bytes), MANIFEST_SCHEMA).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")


def _parse(member):
    """(headers, block) of one decompressed record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


def _members(stream):
    """Decompressed gzip members of a stream, one record at a time."""
    data, packer, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                if parts:
                    raise ValueError("archive ends inside a record")
                return
        packer = packer or zlib.decompressobj(31)
        parts.append(packer.decompress(data))
        data = b""
        if packer.eof:
            yield b"".join(parts)
            data, packer, parts = packer.unused_data, None, []


def _page(member):
    headers, block = _parse(member)
    if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda name: int(headers[name]) if headers.get(name, "None") != "None" else None
    if headers["WARC-Type"] == "response":
        size, digest = len(payload), base32_sha1(payload)
    else:
        size, digest, payload = number("Payload-Length"), headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
    return (number("Page-ID"), headers["WARC-Target-URI"], headers["WARC-Type"], number("Refers-To-Page-ID"), size, digest, payload)


def _reader(folder, with_payload):
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{path}/data/{name}") as stream:
                    for member in _members(stream):
                        page = _page(member)
                        rows.append(page if with_payload else (*page[:-1], None))
                        size += len(member) if with_payload else 256
                        if size >= 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def read_archives(spark, folder, with_payload=True):
    """One row per record of the archives that the manifest lists; digests are checked."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    files = manifest.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    spread = manifest.select("file").repartition(max(files, 1), "file")
    return spread.mapInArrow(_reader(folder, with_payload), RECORD_SCHEMA)
