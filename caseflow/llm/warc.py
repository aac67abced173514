"""Dictionary-compressed WARC archives.

Each archive is a WARC 1.1 file of individually compressed Zstandard frames.
A dictionary is built from a bounded sample of the archive's own records (the
first DICT_SAMPLE bytes of payload that reach the writer, which is a random
part of the corpus, as records are dealt by payload digest) and stands in a
leading skippable frame, so that an archive can be read by itself.  Every
record is one frame: a reader can start at any of them.

Archives are written by the tasks, one per partition and at most
``archive_bytes`` long, to a folder all executors share; a task that is run
again writes other file names, and only files named in the returned (and
stored) manifest count.  Payloads with equal digests are archived once; the
other records are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import written
from caseflow.session import scratch_path

DICT_MAGIC = 0x184D2A5D                 # skippable frame that holds the dictionary
DICT_BYTES, DICT_SAMPLE = 64 << 10, 2 << 20
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def _header_value(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id, url, payload, size, payload_digest, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record as bytes."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}",
            f"WARC-Record-ID: {record_id(page_id, payload_digest)}",
            f"WARC-Target-URI: {_header_value(url or '')}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to, payload_digest)}",
                 f"WARC-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Page: {'' if page_id is None else page_id}",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _train(samples: list[bytes]):
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:         # too few or too small records
        return None


class ArchiveWriter:
    """Writes records to one stream; the first ones are held back until the
    dictionary can be built."""

    def __init__(self, stream, level: int = LEVEL):
        self.stream, self.level = stream, level
        self.held: list[bytes] = []
        self.held_bytes = self.records = self.size = 0
        self.compressor = None

    def _start(self):
        words = _train(self.held) if self.held else None
        if words is not None:
            raw = words.as_bytes()
            self._put(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=True)
        held, self.held = self.held, []
        for r in held:
            self._put(self.compressor.compress(r))

    def _put(self, data: bytes):
        self.stream.write(data)
        self.size += len(data)

    def add(self, data: bytes):
        self.records += 1
        if self.compressor is not None:
            self._put(self.compressor.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= DICT_SAMPLE:
            self._start()

    def close(self):
        if self.compressor is None:
            self._start()
        self.stream.close()


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record; memory is bounded by one record."""
    stream = io.BufferedReader(stream) if not hasattr(stream, "peek") else stream
    head = stream.read(8)
    words = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICT_MAGIC:
        words = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    body = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(
        _Joined(head, stream), read_across_frames=True), 1 << 18)
    while True:
        line = body.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError("not at the start of a WARC record")
        fields = {}
        while (line := body.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.lower()] = value.strip()
        block = body.read(int(fields["content-length"]))
        if body.read(4) != b"\r\n\r\n":
            raise ValueError("record does not end as it should")
        yield fields, block


class _Joined(io.RawIOBase):
    """Some bytes, then a stream."""

    def __init__(self, first: bytes, rest):
        self.first, self.rest = first, rest

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.first[:len(buffer)] or self.rest.read(len(buffer))
        self.first = self.first[len(buffer):]
        buffer[:len(data)] = data
        return len(data)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        task = TaskContext.get()
        writer, done = None, []

        def close():
            writer.close()
            done.append((f"{folder}/{name}", writer.records, writer.size))

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, size, sha, refers, revisit = (c[i].as_py() for c in batch.columns)
                if writer is None:
                    name = f"part-{task.partitionId():05d}-{len(done)}-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(f"{path}/{name}", compression=None))
                sha = base64.b32encode(bytes.fromhex(sha)).decode()
                writer.add(record(page_id, url, payload or b"", size, sha, refers, revisit, date))
                if writer.size >= archive_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)],
                                             names=["path", "records", "bytes"])
    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` into ``folder`` (a shared one) and
    return the stored manifest: path, records, bytes per archive.

    The payload is the html in UTF-8; null html is the empty payload.  Of equal
    payloads the record of the smallest page_id is the response, the others
    refer to it; rows repeated with that page_id are responses too.  A null
    page_id is never the one referred to, unless no copy has an id: then all of
    them are responses.  A null url is empty.  An empty table gives no archive.
    Other columns are ignored.
    """
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    heads = rows.groupBy("sha").agg(F.min("page_id").alias("head"))
    same = F.col("head").isNull() | F.col("page_id").eqNullSafe(F.col("head"))
    records = rows.join(heads, "sha").select(
        "page_id", "url", F.when(same, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("size"),
        "sha", F.when(~same, F.col("head")).alias("refers"), (~same).alias("revisit"))
    return written(records.mapInArrow(_write(folder, archive_bytes, date), "path string, records long, bytes long"),
                   "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per archived record: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null for revisits).  A
    response whose payload does not have its digest raises."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _open(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_archive(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        sha = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        size = int(http.decode().rpartition("Content-Length:")[2])
                        if not revisit and (digest(payload) != sha or len(payload) != size):
                            raise ValueError(f"{uri}: a payload differs from its digest")
                        page, refers = fields["warc-page"], fields.get("warc-refers-to-page")
                        rows.append((int(page) if page else None, fields["warc-target-uri"], size, sha, fields["warc-type"],
                                     int(refers) if refers else None, None if revisit else payload))
                        held += len(payload)
                        if len(rows) == 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds,
                                                                                             strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds,
                                                                                     strict=True)], names=names)

    files = manifest.count()
    return (manifest.select("path").repartition(max(1, min(files, 10_000)))
            .mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                             "refers_to long, payload binary"))


def fresh_folder(spark: SparkSession) -> str:
    return scratch_path(spark, f"warc-{uuid.uuid4().hex}")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n,
             array_to_string(list_transform(range(8), lambda g: (
                 list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
                     ('0x' || substr(x, 1 + 5 * g, 5))::INT) >> s) & 31), 1))).list_aggregate('string_agg', '')), '') AS b
      FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS f FROM d)
SELECT page_id, n AS payload_bytes, b AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM m
"""
