"""Best-fit packing from a histogram of lengths (operator 9).

Documents become pieces of at most `capacity` ids. Only the counts of each
length (at most `capacity` of them) reach the driver, which plans best-fit
decreasing over counts: a plan row says that pieces rank_from..rank_to of one
length go, one each, to consecutive sequences at one offset. Pieces then find
their row by their length and their rank within it, by binary search.

Defined results: null or empty text is one piece with the end id alone; a text
of exactly `capacity` ids is one piece; null doc_ids are packed like others;
repeated rows are packed each; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    head = n % capacity
    cuts = [(0, head)] if head else []
    return cuts + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds its ids as little-endian 32-bit integers."""

    def cut(batches):
        encode = tokens.encoder(tokenizer)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode.ids(text.as_py(), end_id).astype("<u4")
                for k, (at, n) in enumerate(cut_points(len(ids), capacity)):
                    raw = ids[at : at + n].tobytes()
                    rows.append((name.as_py(), k, at, n, zlib.crc32(raw)) + (raw,) * with_ids)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.mapped(rows, cut, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, sequence, offset).

    Ranks rank_from <= r < rank_to of a length go to sequence + (r - rank_from).
    Open sequences are runs of consecutive numbers with the same room left, so
    the plan's size depends on the capacity and not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fit = min((r for r in room if r >= length and room[r]), default=None)
            if fit is None:
                fit, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = room[fit].pop()
            each = fit // length  # the best fit fills one sequence before the next
            full = min(many, left // each)
            for slot in range(each if full else 0):
                rows.append((length, rank, rank + full, first, capacity - fit + slot * length))
                rank += full
            left -= full * each
            if full:
                room[fit - each * length].append((first, full))
            if full < many and left:
                for slot in range(left):
                    rows.append((length, rank, rank + 1, first + full, capacity - fit + slot * length))
                    rank += 1
                room[fit - left * length].append((first + full, 1))
                full, left = full + 1, 0
            if full < many:
                room[fit].append((first + full, many - full))
    return rows


def ranked(cut: DataFrame, by_length: list[tuple[int, int]], group: int = 1000, most_groups: int = 1 << 16) -> DataFrame:
    """Adds rank, 0 to n - 1 within each length.

    The pieces of a length are dealt to groups by a hash, so a length that most
    pieces share is ranked by many tasks; a group's ranks begin where the
    counts of the groups before it end.
    """
    most = max([1, *(n for _, n in by_length)])
    groups = min(most_groups, -(-most // group))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    counts = dealt.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    place = dealt.withColumn("_at", F.row_number().over(order) - 1).join(base, ["length", "_group"])
    return place.withColumn("rank", F.col("_base") + F.col("_at")).drop("_group", "_base", "_at")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; with_ids keeps the ids themselves."""
    spark = docs.sparkSession
    cut = common.written(pieces(docs, tokenizer or tokens.default_path(), capacity, end_id, with_ids), "pieces")
    by_length = [(int(r[0]), int(r[1])) for r in cut.groupBy("length").count().collect()]
    rows = plan(dict(by_length), capacity)
    return placed(ranked(cut, by_length), rows)


#: Bits of a key below the length: more pieces of one length than that can't be ranked.
RANK_BITS = 44


def placed(pieces: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Pieces with a rank by their plan rows, found by binary search over (length, rank_from).

    The plan goes to the tasks: at most a few rows for each pair of length and
    room, bounded by the capacity alone.
    """
    length, rank_from, _, first, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    keys = (length << RANK_BITS) | rank_from
    columns = [c for c in pieces.columns if c != "rank"]

    def find(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << RANK_BITS) | rank, side="right") - 1
            found = [pa.array(first[at] + rank - rank_from[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *found], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.select(columns).dtypes)
    return common.mapped(pieces, find, f"{schema}, sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
