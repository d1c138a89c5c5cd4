"""Cascading erasure against brute force, odd tables, and what files still say."""

import hashlib
import math
import os
import zlib
from collections import Counter
from datetime import datetime
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mizan.llm import erasure

LINKED = {"clients": "master_id", "clicks": "client_id", "sales": "client_id", "sale_lines": "sale_id"}


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def ascending(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def by_brute_force(tables, files=250):
    """tables: name -> (columns, rows as tuples)."""
    at = {t: {c: i for i, c in enumerate(columns)} for t, (columns, _) in tables.items()}
    col = lambda t, r, c: r[at[t][c]]
    own = {}
    for r in tables["sales"][1]:
        if (s := col("sales", r, "sale_id")) is not None:
            own.setdefault(s, []).append(col("sales", r, "client_id"))
    own = {s: min((c for c in held if c is not None), default=None) for s, held in own.items()}
    clicks = Counter(col("clicks", r, "client_id") for r in tables["clicks"][1])
    of = {}
    for r in tables["clients"][1]:
        if col("clients", r, "master_id") is not None:
            of.setdefault(col("clients", r, "master_id"), set()).add(col("clients", r, "client_id"))
    masters = {m for m in of if crc(m) % 200 == 0}
    if of:
        masters.add(min(of, key=lambda m: (-sum(clicks[c] for c in of[m] if c is not None), m)))
    keys = {"clients": masters}
    keys["clicks"] = keys["sales"] = {col("clients", r, "client_id") for r in tables["clients"][1] if col("clients", r, "master_id") in masters} - {None}
    keys["sale_lines"] = {col("sales", r, "sale_id") for r in tables["sales"][1] if col("sales", r, "client_id") in keys["sales"]} - {None}
    found = {}
    for t, (columns, rows) in tables.items():
        client = (lambda r: own.get(r[0])) if t == "sale_lines" else (lambda r, t=t: col(t, r, "client_id"))
        rows = sorted(rows, key=lambda r: (crc(client(r)), ascending(r)))
        size = 1 + len(rows) // files
        for no in range(-(-len(rows) // size)):
            whole = rows[no * size : (no + 1) * size]
            left = [r for r in whole if col(t, r, LINKED[t]) not in keys[t]]
            if left:
                cents = sum(math.floor(100 * x + 0.5) for r in left if (x := col(t, r, erasure.AMOUNTS[t])) is not None)
                ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in left).encode()).hexdigest()
                found[t, no] = (len(left), len(whole) - len(left), cents, len(left) < len(whole), ids, ",".join(columns), left)
    return found


def rows_of(folder, name):
    t = pq.read_table(f"{folder}/{name}.parquet")
    return t.column_names, [tuple(r.values()) for r in t.to_pylist()]


def same(spark, got, want, schemas):
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r["columns"]) for r in got} == {k: v[:6] for k, v in want.items()}
    paths = {urlparse(r.path).path: (r.table_name, r.file_no) for r in got}
    assert len(paths) == len(got)
    for path, key in paths.items():
        file = pq.ParquetFile(path)
        rows = [tuple(r.values()) for r in file.read().to_pylist()]
        assert rows == want[key][6] and file.schema_arrow.names == schemas[key[0]]
        for i in range(file.metadata.num_row_groups):
            s = file.metadata.row_group(i).column(0).statistics
            ids = [r[0] for r in rows if r[0] is not None]
            assert not ids or (s.has_min_max and (s.min >= min(ids) and s.max <= max(ids)) and s.null_count <= len(rows) - len(ids))
    roots = {os.path.dirname(os.path.dirname(p)) for p in paths}
    assert len(roots) <= 1
    for root in roots:
        assert {os.path.join(d, f) for d, _, names in os.walk(root) for f in names} == set(paths)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_erasure_by_brute_force(spark, size):
    folder = f"/root/testdata/sf{size}"
    tables = {t: rows_of(folder, t) for t in erasure.AMOUNTS}
    got = erasure.op13_cascading_erasure(spark, folder).collect()
    want = by_brute_force(tables)
    same(spark, got, want, {t: c for t, (c, _) in tables.items()})
    assert any(v[3] for v in want.values()) and not all(v[3] for v in want.values())


SCHEMAS = {
    "clients": "client_id long, master_id long, balance double, `row` string, `c0` int, `a.b` string",
    "clicks": "click_id long, client_id long, value double, link string, position int",
    "sales": "sale_id long, client_id long, total double, `sort_key` string, at timestamp_ntz",
    "sale_lines": "sale_id long, line_no int, amount double, `key` string, `salt` int",
}


def odd_tables(spark, **rows):
    held = {t: rows.get(t, []) for t in SCHEMAS}
    frames = {t: spark.createDataFrame(held[t], SCHEMAS[t]) for t in SCHEMAS}
    return {t: (frames[t].columns, held[t]) for t in SCHEMAS}, frames


def ruled():
    return [m for m in range(3000) if crc(m) % 200 == 0]


@pytest.mark.parametrize("files", [1, 3, 250])
def test_odd_tables(spark, files):
    a, b = ruled()[:2]
    when = datetime(2024, 1, 2, 3, 4, 5, 678901)
    tables, frames = odd_tables(
        spark,
        clients=[(1, a, 1.5, "x", 1, "é"), (1, a, 1.5, "x", 1, "é"), (2, None, None, None, None, None), (None, b, 0.005, "", 0, ""), (3, 7, -0.5, "y" * 100_000, 2, "z"), (4, 8, 2.0, None, 1, None)],
        clicks=[(i, [1, 2, 3, None][i % 4], i / 7, str(i), i) for i in range(40)] + [(None, 1, None, None, None)] * 3,
        sales=[(i, [1, 3, None, 9][i % 4], float(i), "s", when) for i in range(20)] + [(None, 3, None, None, None), (None, 1, 1.0, None, None)],
        sale_lines=[(i % 25, i % 3, i / 3, "k", i) for i in range(60)] + [(None, None, None, None, None)] * 4 + [(0, 1, 2.0, "k", 1)] * 5,
    )
    victims = erasure.victim_masters(frames["clients"], frames["clicks"])
    manifest = erasure.erase_masters(spark, frames, victims, files)
    got = erasure.digests(manifest, erasure.AMOUNTS).collect()
    want = by_brute_force(tables, files)
    same(spark, got, want, {t: c for t, (c, _) in tables.items()})


@pytest.mark.parametrize("given", [{}, {"clients": [(1, None, 1.0, None, None, None)]}, {"clients": [(1, 5, 1.0, None, None, None), (2, 4, 1.0, None, None, None)]}])
def test_tables_without_rows(spark, given):
    tables, frames = odd_tables(spark, **given)
    got = erasure.digests(erasure.erase_masters(spark, frames, erasure.victim_masters(frames["clients"], frames["clicks"])), erasure.AMOUNTS).collect()
    want = by_brute_force(tables)  # of masters without clicks the smallest goes
    same(spark, got, want, {t: c for t, (c, _) in tables.items()})


def test_a_hot_master_empties_files(spark):
    tables, frames = odd_tables(
        spark,
        clients=[(i, 5 if i % 3 else i, 1.0, None, i, None) for i in range(1, 300)],
        clicks=[(i, 7, 1.0, None, None) for i in range(400)] + [(1000 + i, 3 * (i % 50), 2.0, None, None) for i in range(400)],
        sales=[(i, 7 if i < 500 else 3 * (i % 90), 1.0, None, None) for i in range(900)],
        sale_lines=[(5 if i < 300 else i, 1, 1.0, None, None) for i in range(900)],
    )
    got = erasure.digests(erasure.erase_masters(spark, frames, erasure.victim_masters(frames["clients"], frames["clicks"]), 100), erasure.AMOUNTS).collect()
    want = by_brute_force(tables, 100)
    same(spark, got, want, {t: c for t, (c, _) in tables.items()})
    assert len([k for k in want if k[0] == "clicks"]) < 80  # some were emptied


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(3)
    for n in (1, 7, 5000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        bits = erasure.bloom(h)
        assert all(erasure.may_hold(bits, h[i : i + 1]) for i in range(len(h)))
        other = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        assert sum(erasure.may_hold(bits, other[i : i + 1]) for i in range(len(other))) <= 4
    keys = erasure.Keys()
    for _ in range(3):
        keys.add(pa.array([5, 5, None, -7, 2**62], pa.int64()))
    assert sum(len(bits) for _, bits in keys.filters(1)) == 1024 // 8


def test_shortlist_finds_every_file_and_few_others(spark, tmp_path):
    d = spark.range(4000).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"))
    table = erasure.lay_out(spark, f"file://{tmp_path}/t", "t", erasure.positioned(d, F.col("a")), ["a", "b"], "b", 100)
    assert len(table.files) == 98 and {n for _, n in table.files.values()} == {41, 4000 - 97 * 41}
    keys = spark.createDataFrame([(7 * i,) for i in (0, 41, 3999)] + [(7 * i + 1,) for i in range(200)] + [(None,)], "key long")
    short = erasure.shortlist(table, keys)
    assert {0, 1, 97} <= set(short) and len(short) < 10
    gone = erasure.confirmed(spark, table, keys, short)
    assert {(r.file_no, r.position) for r in gone.collect()} == {(0, 0), (1, 0), (97, 22)}


def test_sweep_removes_what_lost_attempts_left(spark, tmp_path):
    d = spark.range(10).select(F.col("id").alias("a"))
    folder = f"file://{tmp_path}/t"
    table = erasure.lay_out(spark, folder, "t", erasure.positioned(d, F.col("a")), ["a"], "a", 2)
    (tmp_path / "t/t/t-000000-lost.parquet").write_bytes(b"part of a file")
    left = erasure.erase(spark, folder, [(table, None)], spark.createDataFrame([(3,)], "key long")).collect()
    assert {os.path.basename(r.path) for r in left} == set(os.listdir(tmp_path / "t/t"))
    assert sorted((r.file_no, r.n_rows, r.n_erased, r.rewritten) for r in left) == [(0, 5, 1, True), (1, 4, 0, False)]
