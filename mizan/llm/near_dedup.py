"""MinHash near-duplicates by a signature-coordinate inverted join (operator 7).

A document's signature has one minimum for each of `coordinates` hash
functions. Each (coordinate, value) pair posts the documents that have it;
documents as alike as the threshold agree in at least `matches` coordinates
but with probability `MISS`. Two documents with so many common postings share
one among the coordinates - matches + 1 postings of either that are rarest in
the whole corpus (prefix merging), so postings of frequent passages drop out,
and a document that shares fewer than `matches` postings has no link at all.

Pairs come from the lists of the prefix postings, their collisions are counted
on the signatures, and those that collide often enough are confirmed on the
full shingle sets. Lists are never expanded to all pairs; pairs that are
connected already are skipped (skip merging):

1. each member of a list with the list's hub, its member with the most common
   postings; the best hub of each document is tried. So a group of copies of one
   document is connected by as many pairs as it has members.
2. lists where all but `MINOR` members are connected: those members with all
   others. This takes at most MINOR pairs a member.
3. what is left, lists of which many members aren't connected, exactly and in
   blocks: documents that share such lists form cells; a large cell is dealt as
   pairs of hash blocks, and each task counts collisions over its inverted lists.

Links are confirmed ones only: copies are never expanded to all pairs, yet no
component is lost. With exact=True the postings are the shingles themselves
and the prefix is that of the shingle set, so that no link is missed at any
probability; it posts every shingle, at about the cost of 100 coordinates.

Defined results: null or wordless text has an empty set, links with nothing
and is kept; one to four words are one shingle; rows with a null doc_id are
linked with nothing, have component null and are not kept; rows that share a
doc_id are linked each by its own text; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common, kernels

COORDINATES = 64
#: Probability that a pair exactly at the threshold isn't a candidate.
MISS = 1e-7
#: So many of the likeliest candidates of a document are confirmed one by one.
FIRST = 4
#: Members of a list that aren't connected with most others and are still paired with all of them.
MINOR = 16
#: A block of a cell has at most about the first number of bytes, so that two fit a task.
#: A cell is cut into smaller ones, down to the second number, while there are idle tasks for their pairs.
BLOCK_BYTES, LEAST_BLOCK_BYTES = 8 << 20, 1 << 19


def least_matches(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """Largest t with P(fewer than t of the coordinates agree) <= miss at this similarity."""
    below = 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


@lru_cache(4)
def _family(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**64, coordinates, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, coordinates, dtype=np.uint64)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Postings (coordinate << 32 | value) of each non-empty set."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), coordinates), np.uint64)
    for j, (a, b) in enumerate(zip(*_family(coordinates), strict=True)):
        low = np.minimum.reduceat(values * a + b, starts)
        out[:, j] = (low >> np.uint64(32)) | (np.uint64(j) << np.uint64(32))
    return out


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, as two signed integers."""
    values = np.concatenate([*sets, np.zeros(1, np.uint64)])
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    empty = np.array([len(s) == 0 for s in sets], bool)
    out = []
    for salt in (0x51ED270B7A3C2F15, 0x9AC5E3F1D86B4027):
        total = np.add.reduceat(kernels.mix(values ^ np.uint64(salt)), starts) if len(sets) else values[:0]
        out.append(np.where(empty, np.uint64(0), total).view(np.int64))
    return out[0], out[1]


SKETCH = "doc_id long, text_key long, n_shingles long, key_a long, key_b long, posts array<long>"


def sketch(docs: DataFrame, k: int, coordinates: int, exact: bool = False) -> DataFrame:
    """Set size, set key and postings (exact: the whole set) of every row."""

    def run(batches):
        for batch in kernels.text_batches(batches, 2 << 20):
            sets = kernels.shingle_sets(batch.column(2), k)
            a, b = set_keys(sets)
            some = [s for s in sets if len(s)]
            posts = iter(some if exact else signatures(some, coordinates) if some else ())
            lists = [next(posts).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), column], names=[c.split()[0] for c in SKETCH.split(", ")])

    return common.mapped(docs.select("doc_id", "text_key", "text"), run, SKETCH)


def prefix_postings(classes: DataFrame, least: Column) -> DataFrame:
    """(rep, post, score): the postings that two documents with `least` common ones must share one of.

    The score grows with the lists a document is in: the hub of a group has the highest.
    """
    posts = classes.select("rep", least.alias("least"), F.explode("posts").alias("post"))
    # a class posts a value once, so this counts classes
    shared = common.written(posts.groupBy("post").agg(F.count("*").alias("many")).where("many > 1"), "shared-posts")
    found = posts.join(shared, "post")
    own = Window.partitionBy("rep")
    found = found.withColumn("rank", F.row_number().over(own.orderBy("many", "post"))).withColumn("n", F.count("*").over(own)).withColumn("score", F.sum("many").over(own))
    return found.where(F.col("rank") <= F.col("n") - F.col("least") + 1).select("rep", "post", "score")


class Overlaps:
    """Intersections of one set with all others, by an inverted list of their values."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    def of(self, x: int) -> np.ndarray:
        first = np.searchsorted(self.values, self.sets[x], "left")
        n = np.searchsorted(self.values, self.sets[x], "right") - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = common_count(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(sets: list[np.ndarray], coordinates: int, matches: int, percent: int, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, beyond those that equal labels stand for.

    Lists of the documents seen so far are merged for each document in turn; a
    pair is looked at if it collides often enough and isn't connected yet. With
    matches = 0 every pair is.
    """
    n = len(sets)
    if n == 2:
        return [(0, 1)] if (not labels or labels[0] != labels[1]) and linked(sets[0], sets[1], percent) else []
    posts = signatures(sets, coordinates)
    values, lists = np.unique(posts, return_inverse=True)
    lists = lists.reshape(n, coordinates)
    order = np.argsort(lists.ravel(), kind="stable")
    members = (order // coordinates).astype(np.int32)
    bounds = np.searchsorted(lists.ravel()[order], np.arange(len(values) + 1))
    sizes = np.array([len(s) for s in sets])
    # those that collide most come first and connect the others early
    turn = np.argsort(-np.diff(bounds)[lists].sum(axis=1), kind="stable")
    place = np.empty(n, np.int64)
    place[turn] = np.arange(n)
    label, links, overlaps = np.unique(labels, return_inverse=True)[1] if labels else np.arange(n), [], None

    def join(x: int, y: int) -> None:
        links.append((x, y))
        label[label == label[y]] = label[x]

    for x in turn.tolist():
        merged = np.concatenate([members[bounds[i] : bounds[i + 1]] for i in lists[x] if bounds[i + 1] - bounds[i] > 1] or [members[:0]])
        if not len(merged) and matches:
            continue
        hits = np.bincount(merged, minlength=n)
        near = np.flatnonzero((hits >= matches) & (place < place[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])))
        near = near[np.argsort(-hits[near], kind="stable")]
        for y in near[:FIRST].tolist():
            if label[x] != label[y] and linked(sets[x], sets[y], percent):
                join(x, y)
        near = near[FIRST:][label[near[FIRST:]] != label[x]]
        if len(near):  # many left: all at once
            overlaps = overlaps or Overlaps(sets)
            both = overlaps.of(x)[near]
            for y in near[100 * both >= percent * (sizes[near] + sizes[x] - both)].tolist():
                if label[x] != label[y]:
                    join(x, y)
    return links


def pack(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())


def unpack(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8").astype(np.uint64) for x in column.to_pylist()]


def with_sets(rows: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """active (rep, rep_key, n_shingles, posts) with the shingle sets."""

    def run(batches):
        for batch in kernels.text_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pack(kernels.shingle_sets(batch.column(3), k))], names=["rep", "n_shingles", "posts", "shingles"])

    held = rows.join(active, (F.col("doc_id") == F.col("rep")) & (F.col("text_key") == F.col("rep_key")))
    # equal rows are one class
    held = held.dropDuplicates(["rep", "rep_key"]).select("rep", "n_shingles", "posts", "text")
    return common.written(common.mapped(held, run, "rep long, n_shingles long, posts array<long>, shingles binary"), "sets")


def colliding(pairs: DataFrame, active: DataFrame, enough, percent: int) -> DataFrame:
    """(a, b, both) of the pairs (a, b) that have enough postings in common and sizes that allow a link."""
    pairs = common.written(pairs, "pairs")  # so that a hub's rows can be split
    side = lambda x: active.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("posts").alias(f"posts_{x}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b")
    found = found.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    found = found.withColumn("both", F.size(F.array_intersect("posts_a", "posts_b")))
    return found.where(enough(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b", "both")


def linking(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which the shingle sets are alike enough."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = [linked(x, y, percent) for x, y in zip(unpack(batch.column(2)), unpack(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: active.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return common.written(common.mapped(held, run, "a long, b long"), "links")


def star_labels(stars: DataFrame) -> DataFrame:
    """(rep, label) of linked stars (a, b), one b for each a: the hub, or the hub's own hub. Equal labels are connected."""
    up = stars.select(F.col("a").alias("b"), F.col("b").alias("top"))
    found = stars.join(up, "b", "left").select("a", F.coalesce("top", "b").alias("label"))
    return common.written(found.select(F.col("a").alias("rep"), "label"), "labels")


def open_lists(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """(post, rep, label, most, minor): members of lists that aren't all connected.

    most is the label that most members of the list have, minor how many have another.
    """
    named = posts.select("rep", "post").join(labels, "rep", "left").select("post", "rep", F.coalesce("label", "rep").alias("label"))
    named = common.written(named, "lists")
    by_label = named.groupBy("post", "label").agg(F.count("*").alias("n"))
    lists = by_label.groupBy("post").agg(F.max_by("label", F.struct("n", "label")).alias("most"), (F.sum("n") - F.max("n")).alias("minor")).where("minor > 0")
    return common.written(named.join(common.written(lists, "open"), "post"), "open-lists")


def minor_pairs(lists: DataFrame, most_minor: int) -> DataFrame:
    """Pairs (a, b) of the lists that have at most so many minor members: each of those with all others."""
    light = lists.where(F.col("minor") <= most_minor)
    few = light.where(F.col("label") != F.col("most")).select("post", F.col("rep").alias("x"), F.col("label").alias("x_label"))
    pairs = light.select("post", "rep", "label").join(common.written(few, "minor"), "post").where((F.col("label") != F.col("x_label")) & (F.col("rep") != F.col("x")))
    return pairs.select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct()


def task_keys(spark, n: int) -> list[int]:
    """For each of n tasks an integer that repartition() sends there."""
    places = spark.range(64 * n).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("task")).agg(F.min("i").alias("i")).collect()
    found = {r["task"]: r["i"] for r in places}
    return [found.get(i, i) for i in range(n)]


def links_in_cells(rows: DataFrame, coordinates: int, matches: int, percent: int) -> DataFrame:
    """Links (a, b) of the reps of every (cell, part); rows hold rep, label and shingles.

    Blocks are dealt to tasks by a plan, the largest first.
    """
    spark = rows.sparkSession

    def found(names, labels, sets):
        pairs = confirmed(sets, coordinates, matches, percent, labels) if len(names) > 1 else []
        return [(names[i], names[j]) for i, j in pairs]

    def run(batches):
        at, held, out = None, ([], [], []), []
        for batch in batches:
            for cell, part, rep, label, shingles in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (cell, part) != at:
                    out += found(*held)
                    at, held = (cell, part), ([], [], [])
                for own, x in zip(held, (rep, label, np.frombuffer(shingles, "<u8").astype(np.uint64)), strict=True):
                    own.append(x)
        out += found(*held)
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # one row a block
    blocks = rows.groupBy("cell", "part").agg(F.sum("n_shingles").alias("size")).withColumn("at", F.row_number().over(Window.orderBy(F.desc("size"), "cell", "part")) - 1)
    keys = F.array(*[F.lit(x) for x in task_keys(spark, n)])
    blocks = common.written(blocks.select("cell", "part", F.element_at(keys, (F.col("at") % n + 1).cast("int")).alias("task")), "blocks")
    dealt = rows.join(blocks, ["cell", "part"]).repartition(n, "task").sortWithinPartitions("cell", "part", "rep")
    return common.mapped(dealt.select("cell", "part", "rep", "label", "shingles"), run, "a long, b long")


def block_links(lists: DataFrame, active: DataFrame, coordinates: int, matches: int, percent: int, block_bytes: int) -> DataFrame:
    """Links among the members of the lists, whatever their number, by blocks."""
    spark = lists.sparkSession
    low = lists.groupBy("post").agg(F.min("rep").alias("b"))
    cells = common.components(lists.join(common.written(low, "list-heads"), "post").select(F.col("rep").alias("a"), "b"), "cells")
    labels = lists.select("rep", "label").distinct()
    sized = active.select("rep", "n_shingles").join(cells.select(F.col("node").alias("rep"), F.col("component").alias("cell")), "rep").join(labels, "rep")
    sized = common.written(sized, "cell-members")
    # the set, and the signature with its inverted lists
    size = F.sum(F.col("n_shingles") * 8 + coordinates * 16)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.least(F.ceil(size / min(LEAST_BLOCK_BYTES, block_bytes)), F.lit(ceil((2 * tasks) ** 0.5)))
    blocks = F.greatest(F.ceil(size / block_bytes), spread).cast("int").alias("blocks")
    sized = sized.join(common.written(sized.groupBy("cell").agg(blocks), "cell-sizes"), "cell")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != block)
    pair = F.transform(others, lambda o: F.least(o, block) * F.col("blocks") + F.greatest(o, block))
    parts = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(pair)
    members = sized.select("rep", "label", "cell", F.explode(parts).alias("part"))
    held = members.join(active.select("rep", "n_shingles", "shingles"), "rep")
    return common.written(links_in_cells(held, coordinates, matches, percent), "links")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, coordinates: int = COORDINATES, block_bytes: int = BLOCK_BYTES, minor: int = MINOR, exact: bool = False) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    matches = 0 if exact else least_matches(coordinates, percent / 100)
    made = common.written(sketch(rows, k, coordinates, exact), "sketch")
    key = ["n_shingles", "key_a", "key_b"]
    usable = made.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets are one class with the smallest doc_id for all
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    classes = usable.groupBy(key).agg(first, F.first("posts").alias("posts"))
    classes = common.written(classes.select(*key, F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"), "posts"), "classes")

    if exact:
        least = F.ceil(F.col("n_shingles") * percent / 100).cast("int")
        enough = lambda both, a, b: 100 * both >= percent * (a + b - both)
    else:
        least = F.lit(matches)
        enough = lambda both, a, b: both >= matches
    posts = common.written(prefix_postings(classes, least), "prefix")
    hubs = posts.groupBy("post").agg(F.max(F.struct("score", "rep")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    posts = common.written(posts.join(common.written(hubs.select("post", F.col("hub.rep").alias("hub")), "hubs"), "post"), "shared-prefix")
    active = classes.join(common.written(posts.select("rep").distinct(), "active"), "rep", "left_semi").select("rep", "rep_key", "n_shingles", "posts")
    active = with_sets(rows, active, k)

    near = colliding(posts.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), active, enough, percent)
    best = near.groupBy("a").agg(F.max(F.struct("both", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = linking(common.written(best, "stars"), active, percent)
    lists = open_lists(posts, star_labels(links))
    links = links.union(linking(common.written(colliding(minor_pairs(lists, minor), active, enough, percent), "candidates").select("a", "b"), active, percent))
    lists = lists.where(F.col("minor") > minor)
    if not lists.isEmpty():
        links = links.union(block_links(lists, active, coordinates, matches, percent, block_bytes))
    labels = common.components(links, "components").select(F.col("node").alias("rep"), F.col("component").alias("label"))

    named = classes.select(*key, "rep").join(labels, "rep", "left").select(*key, F.coalesce("label", "rep").alias("component"))
    named = common.written(named, "named")
    same = [F.col(x) == F.col(f"c_{x}") for x in key]
    result = made.join(named.select(*[F.col(x).alias(f"c_{x}") for x in key], "component"), same[0] & same[1] & same[2], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = result.withColumn("component_id", component)
    return result.select("doc_id", "text_key", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
