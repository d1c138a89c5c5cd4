"""Series queries over tables in several files."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from mizan import catalogue


def test_monthly_sums_follow_the_order_of_the_table(spark, tmp_path):
    # 2 ** 53 + 1 + 1 is 2 ** 53 in doubles, 2 ** 53 + (1 + 1) isn't: sums by file give another cell than the rows in order
    at = datetime.datetime
    files = [[(2.0**53, "A", "O", at(1996, 9, 13))], [(1.0, "A", "O", at(1996, 9, 1)), (1.0, "A", "O", at(1996, 9, 30)), (0.5, "A", "F", None)], [(7.25, None, "F", at(1996, 9, 2)), (None, "R", "O", at(1996, 9, 3))]]
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    schema = pa.schema([("l_extendedprice", pa.float64()), ("l_returnflag", pa.string()), ("l_linestatus", pa.string()), ("l_shipdate", pa.timestamp("us"))])
    for i, rows in enumerate(files):
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema), folder / f"part-{i}.parquet")

    con = duckdb.connect(config={"threads": 1})  # more threads add up in an order of their own, which changes from run to run
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    asked = con.execute(catalogue.oracle_sql()["monthly_table"])
    columns = [c[0] for c in asked.description]
    found = catalogue.queries()["monthly_table"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, asked.fetchall()))
    assert ("1996-09", "A", "9,007,199,254,740,992") in {(r["month"], r["name"], r["total"]) for r in found}
