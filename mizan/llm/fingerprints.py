"""Threshold-scaled document fingerprints (operator 4).

A fingerprint keeps every five-word shingle hash below a fixed fraction of the
hash space, whatever the document's length. The union of two fingerprints is
the fingerprint of the union, and the kept hashes estimate both resemblance and
containment, also between a short document and a very long one.

As a string it is the base64 of the kept hashes, ascending, five bytes each.

Defined results: null text counts as empty; a text of one to four words has its
whole word sequence as one shingle; texts whose shingles all lie above the
threshold have the empty fingerprint, which says nothing of them: two such
texts have likeness 1 if their shingle sets are equal (as those of two texts
without words) and else 0; an empty and a non-empty fingerprint have 0. Rows that share a doc_id follow
each other in an order fixed by their text; null doc_ids come last in
descending order; a table of one row has itself as next; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.llm import common, kernels

FRACTION = 0.25
K = 5
BYTES = 5


def sketches(column, fraction: float = FRACTION, k: int = K) -> list[np.ndarray]:
    """For each text the kept shingle hashes, distinct and ascending, as 40-bit integers."""
    buf, offsets = kernels.text_bytes(column)
    starts, ends, first = kernels.words(buf, offsets)
    h = kernels.word_hashes(buf, starts, ends, kernels.LOWER)
    seq = kernels.sequence_hashes(h, k)
    limit = int(fraction * 2**64)
    owner, inside = kernels.window_owner(first, k, len(h))
    at = np.flatnonzero(inside & (seq < np.uint64(min(limit, 2**64 - 1))))
    unit = np.uint64(-(-limit // 2 ** (8 * BYTES)))
    values, owner = seq[at] // unit, owner[at]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    bounds = np.searchsorted(owner, np.arange(len(first)))
    out = [values[a:b] for a, b in pairwise(bounds)]
    for i in np.flatnonzero((np.diff(first) < k) & (np.diff(first) > 0)):
        a, b = first[i], first[i + 1]
        whole = kernels.mix(kernels.sequence_hashes(h[a:b], int(b - a)) + np.uint64(b - a))
        out[i] = whole[whole < np.uint64(min(limit, 2**64 - 1))] // unit
    return out


def as_text(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :]
    return base64.b64encode(raw.tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BYTES :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merged(*sets: np.ndarray) -> np.ndarray:
    """Fingerprint of all the documents together."""
    return np.unique(np.concatenate(sets))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def likeness(a: np.ndarray, b: np.ndarray, same: bool = False) -> float:
    """Estimated share of the two documents' shingles that both have; same: whether their sets are known to be equal."""
    both = _shared(a, b)
    union = len(a) + len(b) - both
    return both / union if union else float(same)


def containment(a: np.ndarray, b: np.ndarray, same: bool = False) -> float:
    """Estimated share of a's shingles that b has; same: whether their sets are known to be equal."""
    return _shared(a, b) / len(a) if len(a) else float(same)


def equal_sets(a: str, b: str, k: int = K) -> bool:
    """Whether two texts have the same shingles."""
    return bool(np.array_equal(*kernels.shingle_sets(pa.array([a, b], pa.large_string()), k)))


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, fingerprint of every document; no shuffle."""

    def run(batches):
        for batch in kernels.text_batches(batches):
            texts = batch.column(1).fill_null("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.utf8_length(texts), pa.int64()), pa.array([as_text(x) for x in sketches(texts, fraction)], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.mapped(rows, run, "doc_id long, n_chars long, fingerprint string")


def in_descending_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, peek, doc_id, text): ranges of doc_id, each in descending order.

    Where a range ends, the row that follows it in the next lower range (after
    the lowest: in the highest) is there once more with peek set. So every task
    sees each of its documents and the next one, and each text moves once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    points = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    # a binary search in the JVM; as doubles the ids keep their order, and equal ids stay together
    splits = [-float("inf"), *sorted({float(x) for x in points} or {0.0}), float("inf")]
    keyed = rows.withColumn("text_key", F.xxhash64("text")).withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    keyed = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(keyed)
    keyed = keyed.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("range").cast("int"))).drop("place", "range")
    # one row per range
    heads = keyed.groupBy("bucket").agg(F.max(F.struct("doc_id", "text_key")).alias("h")).collect()
    heads = sorted((r["bucket"], r["h"]["doc_id"], r["h"]["text_key"]) for r in heads)
    above = {b: heads[(i + 1) % len(heads)][0] for i, (b, _, _) in enumerate(heads)}
    if not heads:
        return keyed.select("bucket", F.lit(False).alias("peek"), "doc_id", "text")
    peeks = spark.createDataFrame([(name, key, above[b]) for b, name, key in heads], "p_id long, p_key long, p_to int")
    found = keyed.join(F.broadcast(peeks), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")), "left")
    places = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("peek")), F.when(F.col("p_to").isNotNull(), F.struct(F.col("p_to").alias("bucket"), F.lit(True).alias("peek")))))
    found = found.select(F.explode(places).alias("at"), "doc_id", "text_key", "text").select("at.bucket", "at.peek", "doc_id", "text_key", "text")
    dealt = found.repartition(n // 4, "bucket")
    return dealt.sortWithinPartitions("bucket", "peek", F.desc_nulls_last("doc_id"), F.desc("text_key")).select("bucket", "peek", "doc_id", "text")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edited(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each document and of its text with the last third replaced by the next document's start."""

    def same(a, b, one, other):
        return not len(a) and not len(b) and equal_sets(one, other)

    def rows_of(names, texts):
        """All but the last row, each against the row after it."""
        own = sketches(pa.array(texts, pa.large_string()), fraction)
        edited = [t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] for t, nxt in pairwise(texts)]
        other = sketches(pa.array(edited, pa.large_string()), fraction)
        n = len(edited)
        columns = [
            names[:n],
            [len(t) for t in texts[:n]],
            [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [as_text(x) for x in own[:n]],
            [as_text(x) for x in other],
            [likeness(a, b, same(a, b, *t)) for a, b, t in zip(own[:n], other, zip(texts[:n], edited, strict=True), strict=True)],
            [likeness(a, b, same(a, b, *t)) for (a, b), t in zip(pairwise(own), pairwise(texts), strict=True)],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in COMPARED.split(", ")])

    def run(batches):
        names, texts, size, at = [], [], 0, None
        for batch in batches:
            for bucket, peek, name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != at:
                    names, texts, size, at = [], [], 0, bucket
                if peek and not names:
                    continue  # a second copy of the row that follows
                names.append(name)
                texts.append(text)
                size += len(text)
                if peek or (size > 2 << 20 and len(names) > 1):
                    yield rows_of(names, texts)
                    names, texts = ([], []) if peek else (names[-1:], texts[-1:])
                    size = sum(map(len, texts))

    return common.mapped(in_descending_order(docs), run, COMPARED)


def op4_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_edited(common.read(spark, sf_dir, "documents"))
