"""Cascading erasure from sorted files (operator 13).

`lay_out` writes a table's rows in order as Parquet files of equally many
consecutive rows. Each file's writer also builds a Bloom filter of the file's
link keys (the column by which rows are found for erasure) from their xxhash64,
in blocks: a key's hash names its block, and every block has bits for the keys
that the file has of it. `erase` goes down the cascade: the keys to erase meet
the blocks of all files that their hash names (a join on the block, so that no
task has more than a block of each file and that block's share of the keys),
which gives the files that may hold them; an exact join of those files' rows
with the keys finds the rows that go, and these rows' own keys are the keys of
the next tables. Files that hold such rows are streamed through pyarrow by one
task each, which leaves out the rows at the found positions and writes the
others anew. The files replaced are deleted when all new ones are there.

A file is written by one task, streaming, and its order and bounds are exact;
so a task's share is a file's (`files` sets their number) or that of several
small ones, while sorting and joins are dealt by Spark. Writers name files by attempt; what an attempt that
was lost has left is swept away at the end.

Defined results: null keys link nothing and are never erased by a link; rows
that repeat are rows each; sales that repeat a sale_id with different clients
order its lines by the smallest; amounts that aren't finite count as 0; tables
without rows have no files; without anything to erase all files stay; columns
of any name but maps (which have no order) pass through, and names are never
looked at but for those that a link, order or sum names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm import common, kernels

#: Keys of a block of a file's filter, about, and bits for each key.
BLOCK_KEYS, KEY_BITS, PROBES = 1024, 32, 16
#: A task writes one file, or as many as hold about so many bytes.
TASK_BYTES = 32 << 20
#: Rows and bytes of a row group at most (one row more, if it is longer).
GROUP_ROWS, GROUP_BYTES = 1 << 17, 32 << 20


def _positions(h: np.ndarray, bits: int, i: int) -> np.ndarray:
    """The i-th place of each hash among so many bits."""
    step = kernels.mix(h) | np.uint64(1)
    return (((h ^ (h >> np.uint64(29))) + np.uint64(i) * step) >> np.uint64(8)) % np.uint64(bits)


def blocks_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (kernels.mix(h ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)) % np.uint64(blocks)


def bloom(h: np.ndarray) -> bytes:
    """A Bloom filter of distinct hashes."""
    bits = np.zeros(max(1024, KEY_BITS * len(h)), bool)
    for i in range(PROBES):
        bits[_positions(h, len(bits), i)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(data: bytes, h: np.ndarray) -> bool:
    """Whether a filter may hold any of the hashes; never False if it was built from one of them."""
    bits = np.frombuffer(data, np.uint8)
    for at in range(0, len(h), 1 << 14):  # a hit ends it
        some = h[at : at + (1 << 14)]
        for i in range(PROBES):
            place = _positions(some, 8 * len(bits), i)
            some = some[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(some):
                break
        if len(some):
            return True
    return False


class Rows:
    """Writes Arrow batches to one Parquet file in row groups of bounded size."""

    def __init__(self, path: str, schema: pa.Schema):
        fs, name = common.store(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(name, compression=None)
        self.writer = pq.ParquetWriter(self.out, schema)
        self.schema, self.held, self.rows, self.bytes, self.n = schema, [], 0, 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        self.held.append(batch)
        self.rows += batch.num_rows
        self.bytes += batch.nbytes
        self.n += batch.num_rows
        if self.rows >= GROUP_ROWS or self.bytes >= GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema).combine_chunks(), row_group_size=self.rows)
        self.held, self.rows, self.bytes = [], 0, 0

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.out.close()


class Keys:
    """Distinct hashes of a file's keys; rows of a key mostly come together."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.last = None

    def add(self, column: pa.Array) -> None:
        h = column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if len(h):
            new = np.append(self.last is None or h[0] != self.last, h[1:] != h[:-1])
            self.held.append(h[new])
            self.last = h[-1]
            if len(self.held) >= 256:
                self.held = [np.unique(np.concatenate(self.held))]

    def filters(self, blocks: int) -> Iterator[tuple[int, bytes]]:
        """(block, bits) of every block that has keys."""
        h = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.held]))
        block = blocks_of(h, blocks).astype(np.int64)
        order = np.argsort(block, kind="stable")
        h, block = h[order], block[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
            if b > a:
                yield int(block[a]), bloom(h[a:b])


def hashed(key: Column) -> Column:
    """The hash of a link key; none if it is null."""
    return F.when(key.isNotNull(), F.xxhash64(key.cast("string")))


def decimal_crc(key: Column) -> Column:
    """crc32 of a key as decimal text, that of the empty string for null."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


@dataclass
class Table:
    """A table of files: its columns, the one that links it to what is erased, and where its files are."""

    name: str
    link: str
    schema: object  # that of the DataFrame it was written from
    blocks: int
    tasks: int  # that write or rewrite its files
    files: dict[int, tuple[str, int]]  # path and rows by file_no: as many as were asked for, at most
    filters: DataFrame | None  # file_no, block, bits


WRITTEN = "file_no long, path string, n_rows long, block long, bits binary"
_WRITTEN = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("block", pa.int64()), ("bits", pa.binary())])


def _path(folder: str, name: str, file_no: int) -> str:
    return f"{folder}/{name}/{name}-{file_no:06d}-{uuid.uuid4().hex}.parquet"


def lay_out(spark: SparkSession, folder: str, name: str, rows: DataFrame, columns: list[str], link: str, files: int = 250) -> Table:
    """Write rows as files of 1 + floor(n / files) consecutive rows (the last: the rest).

    rows: sort_key, then the table's columns as c0, c1, ...; the order is that of
    all of them from left to right, ascending, nulls first.
    """
    fields = [f"c{i}" for i in range(len(columns))]
    schema = rows.select(*[F.col(f).alias(c) for f, c in zip(fields, columns, strict=True)]).schema
    order = [F.col(f).asc_nulls_first() for f in ("sort_key", *fields)]
    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # no key is so frequent that one task gets it whole, as all columns are in the order
    ordered = rows.repartitionByRange(n_tasks, *order).sortWithinPartitions(*order).drop("sort_key")
    made = common.new_folder(spark, f"ordered-{name}")
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())
    ordered.write.parquet(made)
    ordered = spark.read.schema(ordered.schema).parquet(made)
    task = F.shiftrightunsigned("place", 33)
    counts = sorted(ordered.groupBy(task.alias("task")).count().collect())  # one row a task
    n = sum(r[1] for r in counts)
    if not n:
        return Table(name, link, schema, 1, 1, {}, None)
    size, before, starts = 1 + n // files, 0, []
    for t, many in counts:
        starts.append((t, before))
        before += many
    blocks, count = -(-size // BLOCK_KEYS), -(-n // size)
    tasks = min(count, max(n_tasks, -(-common.size(spark, made) // TASK_BYTES)))
    starts = F.broadcast(spark.createDataFrame(starts, "task long, start long"))  # one row a task
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    key = F.col(fields[columns.index(link)])
    ranked = ordered.withColumn("task", task).join(starts, "task").withColumn("rank", rank)
    ranked = ranked.select(F.expr(f"rank div {size}").alias("file_no"), "rank", hashed(key).alias("link"), *fields)
    dealt = ranked.repartitionById(tasks, F.expr(f"int(file_no * {tasks} div {count})")).sortWithinPartitions("rank").drop("rank")

    def write(batches):
        out = now = keys = path = None

        def done():
            out.close()
            found = [(now, path, out.n, block, bits) for block, bits in keys.filters(blocks)] or [(now, path, out.n, None, None)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _WRITTEN.types, strict=True)], schema=_WRITTEN)

        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if now != int(number[a]):
                    if out is not None:
                        yield done()
                    now, keys = int(number[a]), Keys()
                    path = _path(folder, name, now)
                    out = Rows(path, pa.schema([pa.field(c, f.type) for c, f in zip(columns, list(batch.schema)[2:], strict=True)]))
                keys.add(part.column(1))
                out.add(pa.RecordBatch.from_arrays(part.columns[2:], schema=out.schema))
        if out is not None:
            yield done()

    found = common.written(common.mapped(dealt, write, WRITTEN), f"files-{name}")
    common.remove(spark, made)
    held = {r[0]: (r[1], r[2]) for r in found.select("file_no", "path", "n_rows").distinct().collect()}  # one row a file
    return Table(name, link, schema, blocks, tasks, held, found.select("file_no", "block", "bits").where("bits IS NOT NULL"))


def shortlist(table: Table, keys: DataFrame) -> list[int]:
    """Files that may hold rows linked to the keys (column key): all that do, and few others."""
    if table.filters is None:
        return []
    blocks = table.blocks
    hashes = keys.select(hashed(F.col("key")).alias("h")).where("h IS NOT NULL")

    def of_block(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks_of(h, blocks).astype(np.int64))], names=["h", "block"])

    def probe(filters: pa.Table, victims: pa.Table) -> pa.Table:
        h = victims.column("h").to_numpy().view(np.uint64)
        hits = [no for no, bits in zip(filters.column("file_no").to_pylist(), filters.column("bits"), strict=True) if len(h) and may_hold(bits.as_py(), h)]
        return pa.table({"file_no": pa.array(hits, pa.int64())})

    dealt = common.mapped(hashes, of_block, "h long, block long")
    found = table.filters.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(probe, "file_no long")
    return sorted(r[0] for r in found.distinct().collect())  # at most one row a file


def confirmed(spark: SparkSession, table: Table, keys: DataFrame, files: list[int]) -> DataFrame:
    """file_no, position and columns (struct row) of the rows of these files that are linked to the keys."""
    rows = spark.read.schema(table.schema).parquet(*[table.files[no][0] for no in files])
    number = F.regexp_extract("_metadata.file_name", r"-(\d{6,})-[0-9a-f]{32}\.parquet$", 1).cast("long")
    rows = rows.select(number.alias("file_no"), F.col("_metadata.row_index").alias("position"), rows[f"`{table.link}`"].alias("key"), F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row"))
    return rows.join(keys, "key", "left_semi")


REWRITTEN = "file_no long, path string, n_rows long, n_erased long"


def rewrite(table: Table, gone: DataFrame, folder: str) -> DataFrame:
    """Files without the rows at the positions in gone (file_no, position); path is null where none is left."""
    name, paths = table.name, {no: path for no, (path, _) in table.files.items()}

    def positions(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), strict=True)

    def survivors(no: int, first: int, rest):
        """Rewrites a file; returns its row and the next file's first place."""
        fs, path = common.store(paths[no])
        at, n_erased, out, new = 0, 0, None, None
        place: tuple | None = (no, first)
        with fs.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1 << 16):
                keep = np.ones(batch.num_rows, bool)
                while place is not None and place[0] == no and place[1] < at + batch.num_rows:
                    keep[place[1] - at] = False
                    n_erased += 1
                    place = next(rest, None)
                if keep.any():
                    if out is None:
                        new = _path(folder, name, no)
                        out = Rows(new, batch.schema.remove_metadata())
                    out.add(batch.filter(pa.array(keep)))
                at += batch.num_rows
        if out is not None:
            out.close()
        return (no, new, at - n_erased, n_erased), place

    def run(batches):
        rest = positions(batches)
        place = next(rest, None)
        while place is not None:
            row, place = survivors(int(place[0]), int(place[1]), rest)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file_no", "path", "n_rows", "n_erased"])

    dealt = gone.select("file_no", "position").repartitionById(table.tasks, F.expr(f"int(file_no * {table.tasks} div {len(paths)})")).sortWithinPartitions("file_no", "position")
    return common.mapped(dealt, run, REWRITTEN)


MANIFEST = "table_name string, file_no long, path string, n_rows long, n_erased long, rewritten boolean"


def erase(spark: SparkSession, folder: str, tables: list[tuple[Table, tuple[str, str] | None]], victims: DataFrame) -> DataFrame:
    """Erase what is linked to the victims (column key), table by table; returns the files that are left.

    With each table comes the earlier table and its column whose erased values
    are this one's keys; none for a table that the victims themselves link.
    """
    erased: dict[str, DataFrame] = {}
    files, replaced = [], []
    for table, of in tables:
        keys = victims if of is None else erased[of[0]].select(F.col("row").getField(of[1]).alias("key")) if of[0] in erased else None
        short, done = [], {}
        if keys is not None and table.files:
            keys = common.written(keys.where("key IS NOT NULL").distinct(), f"keys-{table.name}")
            short = shortlist(table, keys)
        if short:
            gone = common.written(confirmed(spark, table, keys, short), f"gone-{table.name}")
            done = {r["file_no"]: r for r in common.written(rewrite(table, gone, folder), f"rewritten-{table.name}").collect()}  # one row a file
            erased[table.name] = gone
        for no, (path, n) in sorted(table.files.items()):
            if no in done:
                replaced.append(path)
                path, n = done[no]["path"], done[no]["n_rows"]
            if path is not None:
                files.append((table.name, no, path, n, done[no]["n_erased"] if no in done else 0, no in done))
    common.remove(spark, *replaced)
    sweep(spark, folder, {path for _, _, path, *_ in files})
    return spark.createDataFrame(files, MANIFEST)  # one row a file


def sweep(spark: SparkSession, folder: str, keep: set[str]) -> None:
    """Delete the files of a folder but those to keep: what attempts that were lost have left."""
    names = {p.rpartition("/")[2] for p in keep}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        found = fs.listFiles(path, True)
        while found.hasNext():
            file = found.next().getPath()
            if file.getName() not in names:
                fs.delete(file, False)


DIGESTS = "table_name string, file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string, path string"


def digests(manifest: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """What the files hold, read from the files: rows, the sum of a column in cents, the first column's hash."""

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = common.store(r["path"])
                ids, n, cents = hashlib.sha256(), 0, 0
                with fs.open_input_file(path) as source:
                    file = pq.ParquetFile(source)
                    names = file.schema_arrow.names
                    amount = amounts.get(r["table_name"])
                    for rows in file.iter_batches(batch_size=1 << 16, columns=list(dict.fromkeys([names[0], *([amount] if amount else [])]))):
                        text = ",".join("" if x is None else str(x) for x in rows.column(names[0]).to_pylist())
                        ids.update((("," if n else "") + text).encode())
                        n += rows.num_rows
                        if amount:
                            x = pc.fill_null(pc.cast(rows.column(amount), pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                            cents += sum(np.floor(100 * np.where(np.isfinite(x), x, 0.0) + 0.5).astype(np.int64).tolist())
                row = (r["table_name"], r["file_no"], n, r["n_erased"], cents, r["rewritten"], ids.hexdigest(), ",".join(names), r["path"])
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in DIGESTS.split(", ")])

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return common.mapped(manifest.repartition(tasks, "path"), read, DIGESTS)


def positioned(df: DataFrame, sort_key: Column) -> DataFrame:
    """sort_key, and all columns as c0, c1, ..., so that no name can clash."""
    return df.select(sort_key.alias("sort_key"), *[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(df.columns)])


def lines_by_client(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """sale_lines with the crc32 of their sale's client as sort_key."""
    own = sales.select(sales["sale_id"].alias("s_id"), sales["client_id"].alias("s_client")).where("s_id IS NOT NULL")
    # written, so that either side of the join is a plain exchange and a hot sale's lines can be split
    own = common.written(own.groupBy("s_id").agg(F.min("s_client").alias("s_client")).withColumn("salt", F.lit(0).cast("long")), "clients-of-sales")
    fields = [f"c{i}" for i in range(len(lines.columns))]
    rows = positioned(lines, lines["sale_id"]).withColumnRenamed("sort_key", "s_id")
    # lines without a sale match nothing; dealt by their values they don't meet in one task
    rows = rows.withColumn("salt", F.when(F.col("s_id").isNull(), F.xxhash64(*fields)).otherwise(0))
    return rows.join(own, ["s_id", "salt"], "left").select(decimal_crc(F.col("s_client")).alias("sort_key"), *fields)


def victim_masters(clients: DataFrame, clicks: DataFrame, every: int = 200) -> DataFrame:
    """key: masters whose crc32 is divisible by `every`, and the one whose clients have most clicks (of equals the smallest)."""
    pairs = clients.select(clients["client_id"].alias("client"), clients["master_id"].alias("key")).where("key IS NOT NULL").distinct()
    counts = clicks.select(clicks["client_id"].alias("client")).where("client IS NOT NULL").groupBy("client").agg(F.count("*").alias("n"))
    each = pairs.join(counts, "client", "left").groupBy("key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    most = each.orderBy(F.desc("n"), "key").limit(1).select("key")
    ruled = pairs.select("key").where(decimal_crc(F.col("key")) % every == 0)
    return common.written(ruled.union(most).distinct(), "victims")


#: The column of each table of the shop that is summed.
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def erase_masters(spark: SparkSession, tables: dict[str, DataFrame], victims: DataFrame, files: int = 250) -> DataFrame:
    """The files of clients, clicks, sales and sale_lines without the victims' rows: a manifest."""
    folder = common.new_folder(spark, "erased")
    laid = {}
    for name, link in (("clients", "master_id"), ("clicks", "client_id"), ("sales", "client_id"), ("sale_lines", "sale_id")):
        df = tables[name]
        rows = lines_by_client(df, tables["sales"]) if name == "sale_lines" else positioned(df, decimal_crc(df["client_id"]))
        laid[name] = lay_out(spark, folder, name, rows, df.columns, link, files)
    cascade = [(laid["clients"], None), (laid["clicks"], ("clients", "client_id")), (laid["sales"], ("clients", "client_id")), (laid["sale_lines"], ("sales", "sale_id"))]
    return erase(spark, folder, cascade, victims)


def op13_cascading_erasure(spark, sf_dir: str) -> DataFrame:
    tables = {name: common.read(spark, sf_dir, name) for name in AMOUNTS}
    manifest = erase_masters(spark, tables, victim_masters(tables["clients"], tables["clicks"]))
    return digests(manifest, AMOUNTS)
