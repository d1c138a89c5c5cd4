"""WARC archives in Zstandard frames with a shared dictionary (operator 2).

An archive begins with a skippable frame (magic 0x184D2A5D) whose content is
the dictionary that every later frame needs; each record is one frame with its
content size. The reader loads that dictionary, decodes frame by frame and
checks the version line, mandatory headers, Content-Length, the record's end
and, where a payload is there, its digest.

Defined results: a null payload is an empty one; records with equal payloads of at least
`min_revisit` bytes refer to the one with the smallest id, records with null ids
last (all ids null: each is a response); rows that repeat that smallest id are
responses too; an empty table writes no archive; columns other than the id, the
URL and the payload are ignored. A damaged archive raises an error naming the
file and the byte.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.llm import common

SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_MAGIC = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: int | None) -> str:
    return f"<urn:x-page:{'' if name is None else name}>"


def record(name: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; refers_to makes it a revisit, which has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c if c.isprintable() else "%20" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(name)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        block = http
    else:
        block = http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A dictionary from sample records; from few or tiny ones, their start as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return samples[0][:1024]


def dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.decompress(raw)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


class Writer:
    """Gathers records into one archive; the first `sample_bytes` train its dictionary."""

    def __init__(self, sample_bytes: int = 1 << 20, level: int = 3):
        self.sample_bytes, self.level = sample_bytes, level
        self.held: list[bytes] = []
        self.held_size, self.size = 0, 0
        self.parts: list[bytes] = []
        self.compressor = None

    def add(self, data: bytes) -> None:
        if self.compressor is None:
            self.held.append(data)
            self.held_size += len(data)
            if self.held_size >= self.sample_bytes:
                self._start()
        else:
            self._frame(data)

    def _start(self) -> None:
        raw = train(self.held)
        self.parts.append(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary(raw), write_content_size=True, write_checksum=True)
        for data in self.held:
            self._frame(data)
        self.held, self.held_size = [], 0

    def _frame(self, data: bytes) -> None:
        self.parts.append(self.compressor.compress(data))
        self.size += len(self.parts[-1])

    def finish(self) -> bytes:
        if self.compressor is None and self.held:
            self._start()
        return b"".join(self.parts)


def frames(data: bytes, where: str):
    """(offset, content) of every frame after the leading dictionary."""
    view = memoryview(data)
    if len(view) < 8:
        raise ValueError(f"{where}: no dictionary frame")
    magic, size = struct.unpack_from("<II", view)
    if magic != SKIPPABLE or len(view) < 8 + size:
        raise ValueError(f"{where}: no whole dictionary frame at its start")
    reader = zstandard.ZstdDecompressor(dict_data=dictionary(bytes(view[8 : 8 + size])))
    at = 8 + size
    while at < len(view):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise ValueError(f"{where}: no frame at byte {at}")
        frame, out, end = reader.decompressobj(), [], at
        try:
            expected = zstandard.get_frame_parameters(view[at : at + 18]).content_size
            while not frame.eof and end < len(view):
                step = view[end : end + (1 << 14)]
                out.append(frame.decompress(step))
                end += len(step)
        except zstandard.ZstdError as error:
            raise ValueError(f"{where}: broken frame at byte {at}: {error}") from error
        content = b"".join(out)
        if not frame.eof or len(content) != expected:
            raise ValueError(f"{where}: frame at byte {at} ends early or has another length than it says")
        yield at, content
        at = end - len(frame.unused_data)


def parse(content: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-case) and block of one record."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError(f"{where}: not a record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{where}: bad header line {line!r}")
        headers[name.lower()] = value.strip()
    if missing := [x for x in REQUIRED if x not in headers]:
        raise ValueError(f"{where}: no {missing[0]}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{where}: block and Content-Length differ")
    return headers, rest[:-4]


def payload_of(headers: dict[str, str], block: bytes, where: str) -> tuple[bytes | None, int]:
    """Payload (none in a revisit) and the length its HTTP headers tell."""
    head, found, payload = block.partition(b"\r\n\r\n")
    said = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or len(said) != 1 or not said[0].isdigit():
        raise ValueError(f"{where}: no HTTP headers with one Content-Length")
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise ValueError(f"{where}: a revisit with a payload or without reference")
        return None, int(said[0])
    if len(payload) != int(said[0]) or headers.get("warc-payload-digest") != f"sha1:{digest(payload)}":
        raise ValueError(f"{where}: payload doesn't match its length or digest")
    return payload, len(payload)


def _name(uri: str) -> int | None:
    text = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
MANIFEST = "path string, records long, bytes long"


def first_of_equal(pages: DataFrame, min_revisit: int) -> DataFrame:
    """payload_key, first_id of payloads that several records have; counts before it shuffles."""
    small = pages.select("page_id", "payload_key", "n")
    many = small.where(F.col("n") >= min_revisit).groupBy("payload_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("many"))
    return many.where("many > 1 AND first_id IS NOT NULL").select(F.col("payload_key").alias("f_key"), "first_id")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, archive_bytes: int = 1 << 24, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record per row of (page_id, url, html); returns the manifest of archives.

    Archives have names that no other attempt uses; those of a task that was
    repeated are in no manifest row and are never read.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("payload_key", F.concat(F.sha1(F.col("html").cast("binary")), F.col("n").cast("string")))
    first = common.written(first_of_equal(rows, min_revisit), "first")
    found = rows.join(first, (F.col("payload_key") == F.col("f_key")) & (F.col("n") >= min_revisit), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    found = found.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"))

    def write(batches):
        rows, archive, n = [], Writer(), 0

        def flush():
            nonlocal archive, n
            data, path = archive.finish(), f"{folder}/pages-{uuid.uuid4().hex}.warc.zst"
            common.write_file(path, data)
            rows.append({"path": path, "records": n, "bytes": len(data)})
            archive, n = Writer(), 0

        for batch in batches:
            for name, url, html, refers in zip(*batch.columns, strict=True):
                archive.add(record(name.as_py(), url.as_py(), html.as_py().encode(), refers.as_py(), date))
                n += 1
                if archive.size + archive.held_size >= archive_bytes:
                    flush()
        if n:
            flush()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return common.written(common.mapped(found, write, MANIFEST), "archives")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives that the column `path` names."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for at, content in frames(common.read_file(path), path):
                    where = f"{path}, byte {at}"
                    headers, block = parse(content, where)
                    payload, n = payload_of(headers, block, where)
                    refers = headers.get("warc-refers-to")
                    rows.append((_name(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], _name(refers) if refers else None, n, headers["warc-payload-digest"].removeprefix("sha1:"), payload))
                    size += len(content)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return common.mapped(manifest.select("path").repartition(n, "path"), read, RECORDS)


def op2_warc_zstd(spark, sf_dir: str) -> DataFrame:
    """Each page through an archive: columns as read back."""
    manifest = write_archives(common.read(spark, sf_dir, "pages"), common.new_folder(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(body)) AS BIGINT) AS n, hex, list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((((strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
  + greatest(strpos('0123456789abcdef', substr(hex || '0', CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1, 0)) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS BIGINT), 1)) AS chars FROM p),
f AS (SELECT hex, n, min(page_id) AS first_id FROM d GROUP BY 1, 2)
SELECT d.page_id, d.n AS payload_bytes, array_to_string(chars, '') AS payload_digest, CASE WHEN d.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN d.page_id <> first_id THEN first_id END AS refers_to, d.url FROM d JOIN f USING (hex, n)
"""
