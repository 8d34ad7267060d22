"""WARC archives in Zstandard: one frame a record, a dictionary in the leading skippable frame.

Writing: every task writes archives of its own into a folder that all machines share, under names
no other attempt uses, and returns their paths; only paths of finished tasks are ever read, so a
task that was lost or run twice leaves nothing behind that counts. Records with equal payloads of
at least ``least`` bytes are written once as ``response`` (the smallest page id), the others as
``revisit`` that refers to it. Digests are compared without the payloads being shuffled: the few
repeated digests are broadcast while they are at most ``most`` (counted first), else joined.

Reading: an archive is a stream. The dictionary is taken from the skippable frame (itself
compressed or not), then each frame is decoded to one record, whose version line, required
headers, Content-Length, HTTP length, digest and trailing blank lines are validated; a fault
raises ``WarcError`` with the archive's path and the record's number.

Edge cases: null html is an empty payload; a null url has no target header; a null page id is
written as such, and is a revisit if some page with an id has the payload; repeated rows of the
smallest page id are all responses; other columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir, pages

MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
LEAST, MOST, ARCHIVE_BYTES, LEVEL = 100, 200_000, 128 << 20, 3
SAMPLE_BYTES, DICTIONARY_BYTES, CHUNK = 1 << 20, 32 << 10, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


# ---------------------------------------------------------------- records


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    number = value.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record; a revisit's block has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, sep, value = line.partition(b":")
        if not sep:
            raise WarcError(f"no header: {line[:80]!r}")
        out[name.decode("ascii").strip().lower()] = value.decode("utf-8").strip()
    return out


def parse(data: bytes) -> dict:
    """Headers and payload of one record, validated."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    h = fields(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise WarcError(f"missing headers: {sorted(missing)}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size}, but {len(rest) - 4} bytes of content")
    block = rest[:size]
    if h["warc-type"] not in ("response", "revisit"):
        return {"headers": h, "payload": block, "payload_bytes": size}
    http, sep, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not sep or not status.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    length, digest = int(fields(lines).get("content-length", len(payload))), h.get("warc-payload-digest", "")
    if h["warc-type"] == "response":
        if length != len(payload):
            raise WarcError(f"HTTP length {length}, but {len(payload)} bytes of payload")
        if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
            raise WarcError("the payload doesn't have its digest")
    elif payload or "warc-refers-to" not in h:
        raise WarcError("a revisit with a payload, or without a record that it refers to")
    return {"headers": h, "payload": payload, "payload_bytes": length, "payload_digest": digest.removeprefix("sha256:")}


# ---------------------------------------------------------------- archives


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the first records; what they have in common as it is, if they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def skippable(content: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(content)
    return struct.pack("<II", MAGIC, len(packed)) + packed


class Archive:
    """An archive being written; the first records are held back as the dictionary's sample."""

    def __init__(self, filesystem, path: str):
        self.path, self.out = path, filesystem.open_output_stream(path, compression=None)
        self.held, self.held_bytes, self.pack, self.records = [], 0, None, 0

    def start(self) -> None:
        d = dictionary([x[:16384] for x in self.held])
        self.out.write(skippable(d))
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=True)
        for x in self.held:
            self.out.write(self.pack.compress(x))
        self.held = []

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.pack:
            self.out.write(self.pack.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= SAMPLE_BYTES:
            self.start()

    def close(self) -> None:
        if not self.pack:
            self.start()
        self.out.close()


def frames(stream, chunk: int = CHUNK):
    """The decoded frames of an archive one after another, with its dictionary."""
    data = stream.read(8)
    if not data:
        return
    d = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        content = stream.read(size)
        if len(content) != size:
            raise WarcError("the dictionary's frame is cut short")
        if content[:4] == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        d, data = zstandard.ZstdCompressionDict(content), b""
    reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(chunk)
            if not data:
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def read_archive(filesystem, path: str):
    """The validated records of an archive."""
    with filesystem.open_input_stream(path, compression=None) as stream:
        n = -1
        try:
            for n, data in enumerate(frames(stream)):
                yield parse(data)
        except (WarcError, zstandard.ZstdError, UnicodeDecodeError) as fault:
            raise WarcError(f"{path}, record {n if isinstance(fault, WarcError) else n + 1}: {fault}") from fault


def located(uri: str):
    """File system and path of a folder's URI or local path; any that Arrow opens."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# ---------------------------------------------------------------- tables

MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def write_archives(rows: DataFrame, folder: str, least: int = LEAST, most: int = MOST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``rows`` (page_id, url, html) to archives below ``folder``; ``path, records`` of each."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"), F.sha2(html.cast("binary"), 256).alias("digest"))
    large = rows.filter(F.octet_length("payload") >= least)
    twice = cut(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first"))
    named = rows.join(F.broadcast(twice) if twice.count() <= most else twice, "digest", "left")
    # an equal digest of a small payload has no entry, as sizes are equal too
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = named.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))

    def run(batches):
        filesystem, base = located(folder)
        filesystem.create_dir(base, recursive=True)
        archive, done = None, []
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(k).to_pylist() for k in range(5))):
                archive = archive or Archive(filesystem, f"{base}/{uuid.uuid4().hex}.warc.zst")
                archive.add(record(page_id, url, payload, digest, refers))
                if archive.out.tell() >= archive_bytes:
                    archive.close()
                    done, archive = [*done, archive], None
        if archive:
            archive.close()
            done.append(archive)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x.path for x in done]), pa.array([x.records for x in done], pa.int64())], schema=MANIFEST)

    return cut(named.mapInArrow(run, "path string, records long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives that ``manifest`` lists."""

    def run(batches, rows=4096):
        filesystem, _ = located(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = []
                for r in read_archive(filesystem, path):
                    h = r["headers"]
                    out.append((page_of(h["warc-record-id"]), r["payload_bytes"], r["payload_digest"], h["warc-type"], page_of(h["warc-refers-to"]) if h["warc-type"] == "revisit" else None))
                    if len(out) >= rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), READ)], schema=READ)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), READ)], schema=READ)

    return manifest.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    return read_archives(write_archives(pages(spark, sf_dir), folder), folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
