"""Token-id files with Elias-Fano document boundaries (operator 5).

A shard holds the ids of consecutive documents in ascending doc_id order, one
after the other, and two Elias-Fano sequences: where each document begins and,
relative to the first, each doc_id. A sequence of n values below u takes about
n * (2 + log2(u / n)) bits; select(i) finds value i from sampled positions of
the high bits, so no 64-bit table of offsets is stored or built to look one up.

Shard layout, little-endian: magic ``EFIDS01\\0``; header ``<BxxxIQQqQ`` of id width, null doc_ids,
documents, ids, first doc_id, bytes of each of the two sequences (two Q more);
boundaries; doc_ids; ids.

Defined results: null text counts as empty (only the end id); null doc_id comes
first and is returned as null; rows that share a doc_id are separate documents
in an order fixed by their text; an empty table writes no shard and returns no row; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common, tokens

MAGIC = b"EFIDS01\0"
HEADER = struct.Struct("<BxxxIQQqQQ")
#: One sampled position of the high bits for so many values.
SAMPLE = 128
#: Values whose low bits are packed at a time.
BLOCK = 1 << 14


class EliasFano:
    """A non-decreasing sequence of integers from 0 to 2^64 - 1."""

    HEAD = struct.Struct("<QBxxxIQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(high[-1]) + 1, np.uint8)
        ones[high] = 1
        places = np.arange(low_bits, dtype=np.uint64)
        # by blocks of a multiple of eight values, so that each fills whole bytes
        blocks = [np.packbits(((values[at : at + BLOCK, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for at in range(0, n, BLOCK)]
        return cls(n, low_bits, np.concatenate(blocks), np.packbits(ones, bitorder="little"), high[::SAMPLE].astype(np.uint32))

    def dump(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.samples), len(self.low), len(self.high)) + self.samples.astype("<u4").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, data: memoryview) -> EliasFano:
        n, low_bits, n_samples, n_low, n_high = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        samples = np.frombuffer(data, "<u4", n_samples, at)
        low = np.frombuffer(data, np.uint8, n_low, at + 4 * n_samples)
        high = np.frombuffer(data, np.uint8, n_high, at + 4 * n_samples + n_low)
        return cls(n, low_bits, low, high, samples)

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        at = first * self.low_bits
        bits = np.unpackbits(self.low[at // 8 : (last * self.low_bits + 7) // 8], bitorder="little")
        bits = bits[at % 8 : at % 8 + (last - first) * self.low_bits].reshape(-1, self.low_bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Value i: from the sample before it, count ones in the high bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = pos // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: pos % 8] = 0
        while (ones := int(bits.sum())) <= left:
            left -= ones
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        pos = 8 * byte + int(np.flatnonzero(bits)[left])
        return ((pos - i) << self.low_bits) | int(self._low(i, i + 1)[0])

    def block(self, k: int) -> np.ndarray:
        """Values k * SAMPLE to (k + 1) * SAMPLE - 1, as far as there are: the select of one sample's reach."""
        first, last = k * SAMPLE, min((k + 1) * SAMPLE, self.n)
        begin = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 :])[: last - first] + begin
        high = (ones - np.arange(first, last)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(first, last)

    def __iter__(self):
        """All values in order; never more than one sample's reach of them as integers."""
        for k in range(len(self.samples)):
            yield from self.block(k).tolist()


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One shard's bytes; doc_ids ascending, nulls first."""
    lengths = np.array([len(x) for x in ids], np.int64)
    known = [x for x in doc_ids if x is not None]
    first = known[0] if known else 0
    starts = EliasFano.build(np.cumsum(lengths) - lengths).dump()
    names = EliasFano.build(np.array([x - first for x in known], np.uint64)).dump()
    head = HEADER.pack(width, len(doc_ids) - len(known), len(ids), int(lengths.sum()), first, len(starts), len(names))
    return b"".join([MAGIC, head, starts, names, *[x.tobytes() for x in ids]])


class Shard:
    """A shard read back: doc(i) by select, or all documents in order."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        width, self.nulls, self.n_docs, self.n_ids, self.first, n_starts, n_names = HEADER.unpack_from(data, 8)
        view, at = memoryview(data), 8 + HEADER.size
        if len(data) != at + n_starts + n_names + self.n_ids * width:
            raise ValueError("a shard's length doesn't match its header")
        self.starts = EliasFano.load(view[at : at + n_starts])
        self.names = EliasFano.load(view[at + n_starts : at + n_starts + n_names])
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at + n_starts + n_names)

    def doc(self, i: int) -> tuple[int | None, np.ndarray]:
        end = self.starts.select(i + 1) if i + 1 < self.n_docs else self.n_ids
        name = None if i < self.nulls else self.first + self.names.select(i - self.nulls)
        return name, self.ids[self.starts.select(i) : end]

    def docs(self):
        """(doc_id, start in the shard, ids) of every document; boundaries come from the select structure."""
        names = chain(repeat(None, self.nulls), (self.first + x for x in self.names))
        for name, (a, b) in zip(names, pairwise(chain(self.starts, [self.n_ids])), strict=True):
            yield name, a, self.ids[a:b]


MANIFEST = "part int, path string, start long, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_ids: int = 1 << 22) -> DataFrame:
    """Encode (doc_id, text) into shards of about shard_ids ids; returns the manifest.

    Documents are dealt by ranges of doc_id, so shard order is doc_id order.
    A shard's name holds a random part: a repeated task writes files of its own
    and only those that its manifest rows name are read.
    """

    def write(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), tokens.encoder(tokenizer)
        names, ids, n, start = [], [], 0, 0
        rows = []

        def flush():
            nonlocal names, ids, n, start
            path = f"{folder}/ids-{part:06d}-{len(rows):06d}-{uuid.uuid4().hex}.efids"
            common.write_file(path, pack_shard(names, ids, encode.width))
            rows.append((part, path, start, len(names), n))
            names, ids, n, start = [], [], 0, start + n

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(name.as_py())
                ids.append(encode.ids(text.as_py(), end_id))
                n += len(ids[-1])
                if n >= shard_ids:
                    flush()
        if names:
            flush()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "path", "start", "n_docs", "n_ids"), r, strict=True)) for r in rows], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = dealt.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return common.written(common.mapped(dealt, write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents of the manifest's shards: doc_id, start, n_tokens, ids_crc32, ids (binary)."""
    task = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.join(task.select("part", before.alias("base")), "part").select("path", (F.col("base") + F.col("start")).alias("base"))

    def docs(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
                for name, start, ids in Shard(common.read_file(path)).docs():
                    for k, v in zip(rows, (name, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tobytes()), strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))

    spread = shards.repartition(max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "path")
    return common.mapped(spread, docs, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write shards of docs to the shared folder and read every document back."""
    folder = common.new_folder(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, folder, tokenizer or tokens.default_path(), end_id))


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    return token_files(common.read(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
