"""Full-text search by a stored index of positions.

A segment has the postings of the documents of one batch: for every term, its
documents with the positions of the term, in blocks of about BLOCK_DOCS
documents, and with each block the term's greatest number of hits in one of
them. Segments are tables of a store (`sources.snapshots`), as is the table of
which segment has a document's last text; so a batch adds blocks of its own
terms and touches no others, and its documents and postings can be one commit.

A search reads the asked terms' blocks only, the small columns first. The
blocks that have all terms of a query are taken in the order of the rank that
they could have at most: the first few give a rank that the others must be able
to reach, and those that can't are never read.

A document's rank is at most COVER_WEIGHT for each cover; one occurrence of a
term is in as many covers as the query has terms at most, as each begins with
the last hit of a term before it. So there are no more covers than the terms'
number times the hits of the least frequent one.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mizan.operators import search
from mizan.sources import snapshots

#: Documents of a block, about, and blocks of each query that are read first.
BLOCK_DOCS, FIRST_BLOCKS = 1024, 8
PREFIX, OWNERS = "postings-", "postings_owners"


def inverted(docs: pa.Table) -> pa.Table:
    """postings of one block's documents (block, key, category, tokens)."""
    docs = docs.sort_by("key").combine_chunks()
    tokens = docs["tokens"].combine_chunks() if docs.num_rows else pa.array([], pa.list_(pa.string()))
    tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
    n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    words = pc.list_flatten(tokens).dictionary_encode()
    term = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    place = np.arange(len(doc), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    # by term; documents and places keep their order
    order = np.argsort(term, kind="stable")
    order = order[np.searchsorted(term[order], 0) :]
    term, doc, place = term[order], doc[order], place[order].astype(np.int32)
    new_term = np.diff(term, prepend=-1) != 0
    first = np.flatnonzero(new_term | (np.diff(doc, prepend=-1) != 0))  # of a term in a document
    hits = np.diff(first, append=len(term))
    row = np.flatnonzero(new_term[first])  # of a term
    at = pa.array(doc[first])
    ends = lambda begin, end: pa.array(np.append(begin, end).astype(np.int32))
    positions = pa.ListArray.from_arrays(ends(first, len(term)), pa.array(place))
    each = pa.StructArray.from_arrays([*[docs[c].combine_chunks().take(at) for c in ("key", "category")], positions], names=["key", "category", "positions"])
    most = np.maximum.reduceat(hits, row).astype(np.int32) if len(row) else np.zeros(0, np.int32)
    block = np.full(len(row), docs["block"][0].as_py() if docs.num_rows else 0, np.int32)
    found = [words.dictionary.take(pa.array(term[first][row])), pa.array(block), pa.array(most), pa.ListArray.from_arrays(ends(row, len(first)), each)]
    return pa.table(found, names=["term", "block", "most", "hits"])


def postings(docs: DataFrame, blocks: int) -> DataFrame:
    """term, block, most (hits in a document), hits (key, category, positions); docs: key, category, tokens; keys are distinct.

    A block's documents come together once and are inverted there, so that no
    posting is shuffled; a task holds one block, and writes its blocks in the
    order of their terms, so that a filter on terms meets few pages of each file.
    """
    kind, category = (docs.schema[c].dataType.simpleString() for c in ("key", "category"))
    dealt = docs.where("key IS NOT NULL").select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "category", "tokens")
    schema = f"term string, block int, most int, hits array<struct<key: {kind}, category: {category}, positions: array<int>>>"
    return dealt.groupBy("block").applyInArrow(inverted, schema).sortWithinPartitions("term", "block")


def ranked(found: DataFrame) -> DataFrame:
    """query_id, key, rank from rows query_id, need, terms, key, term, positions of which every document has all its terms."""
    each = found.groupBy("query_id", "need", "terms", "key").agg(F.collect_list(F.struct("term", "positions")).alias("own")).where(F.size("own") == F.col("need"))
    hits = F.array_sort(F.flatten(F.transform("own", lambda o: F.transform(o["positions"], lambda p: F.struct(p.alias("pos"), o["term"].alias("term"))))))
    return each.select("query_id", "key", search.cover_rank(hits, F.col("terms")).alias("rank"))


class TextIndex:
    """The index in a store's folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, snapshots.Store(spark, folder)

    def changes(self, docs: DataFrame, state: snapshots.State) -> dict[str, snapshots.Change]:
        """What a commit adds for documents (key, category, tokens), new ones or new texts of old ones."""
        keys = docs.where("key IS NOT NULL").select("key")
        n, touched = keys.agg(F.count("*"), F.collect_set(snapshots.part_of("key"))).first()
        if not n:
            return {}
        name, touched = f"{PREFIX}{uuid.uuid4().hex}", tuple(sorted(touched))
        kind = docs.schema["key"].dataType.simpleString()
        old = self.store.read(OWNERS, f"key {kind}, segment string", list(touched), state)
        owners = old.select("key", "segment").join(keys, "key", "left_anti").union(keys.select("key", F.lit(name)))
        return {name: snapshots.Change(postings(docs, -(-n // BLOCK_DOCS))), OWNERS: snapshots.Change(owners, "key", touched)}

    def add(self, docs: DataFrame) -> snapshots.State:
        return self.store.update(lambda state: self.changes(docs, state) or None)

    def remove(self, keys: DataFrame) -> snapshots.State:
        """Forget documents (column key); their postings stay until the next compact()."""
        touched = tuple(sorted(r[0] for r in keys.select(snapshots.part_of("key")).distinct().collect()))

        def change(state):
            old = self.store.read(OWNERS, None, list(touched), state)
            return None if old is None else {OWNERS: snapshots.Change(old.select("key", "segment").join(keys, "key", "left_anti"), "key", touched)}

        return self.store.update(change)

    def segments(self, state: snapshots.State) -> list[str]:
        return sorted(t for t, parts in state.tables.items() if t.startswith(PREFIX) and parts.get(0))

    def compact(self) -> snapshots.State:
        """Make one segment of all, without what was replaced or removed."""

        def change(state):
            names = self.segments(state)
            if not names:
                return None
            each = self._live(self._rows(state, names), state).select("term", "h.key", "h.category", "h.positions")
            n = each.select("key").distinct().count()
            name = f"{PREFIX}{uuid.uuid4().hex}"
            block = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // BLOCK_DOCS)))).cast("int")
            held = each.withColumn("block", block).groupBy("term", "block").agg(F.max(F.size("positions")).alias("most"), F.array_sort(F.collect_list(F.struct("key", "category", "positions"))).alias("hits"))
            tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            owners = self.store.read(OWNERS, None, None, state).select("key", F.lit(name).alias("segment"))
            every = tuple(range(snapshots.PARTS))
            return dict.fromkeys(names) | {name: snapshots.Change(held.repartitionByRange(tasks, "term", "block").sortWithinPartitions("term", "block")), OWNERS: snapshots.Change(owners, "key", every)}

        return self.store.update(change)

    def _rows(self, state: snapshots.State, names: list[str]) -> DataFrame:
        found = None
        for name in names:
            one = self.store.read(name, None, None, state).withColumn("segment", F.lit(name))
            found = one if found is None else found.unionByName(one)
        return found

    def _live(self, rows: DataFrame, state: snapshots.State) -> DataFrame:
        """One row a posting (struct h), of those whose segment has the document's last text."""
        owners = self.store.read(OWNERS, None, None, state).select(F.col("key").alias("o_key"), F.col("segment").alias("o_segment"))
        each = rows.withColumn("h", F.explode("hits")).drop("hits")
        return each.join(owners, (F.col("h.key") == F.col("o_key")) & (F.col("segment") == F.col("o_segment")), "left_semi")

    def search(self, queries: DataFrame, limit: int = search.FTS_LIMIT, threshold: float | None = search.FTS_THRESHOLD, clean: bool = True, category: str | None = None) -> DataFrame:
        """query_id, key, rank, position as search.fts gives them for the same documents."""
        state = self.store.state()
        names = self.segments(state)
        terms = search.query_terms(queries, clean)
        if not names:
            return terms.select("query_id", F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("rank"), F.lit(0).alias("position")).limit(0)
        asked = [r["term"] for r in terms.select("term").distinct().limit(search.INSIDE_TERMS + 1).collect()]
        rows = self._rows(state, names)
        if len(asked) <= search.INSIDE_TERMS:  # reaches the scan
            rows = rows.where(F.col("term").isin(asked))
        own = terms.groupBy("query_id").agg(F.count("*").cast("int").alias("need"), F.array_sort(F.collect_list("term")).alias("terms"))
        blocks = self.blocks(rows, terms, own)
        first = self._ranked(rows, blocks.where(F.col("turn") <= FIRST_BLOCKS), terms, own, state, len(names) > 1, category)
        # of a few blocks' documents
        least = first.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("rank"), asc=False), limit - 1).alias("least"))
        rest = blocks.where(F.col("turn") > FIRST_BLOCKS).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-9))
        found = first.unionByName(self._ranked(rows, rest, terms, own, state, len(names) > 1, category))
        order = Window.partitionBy("query_id").orderBy(F.desc("rank"), "key")
        best = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
        return best if threshold is None else best.where(F.col("rank") >= threshold)

    @staticmethod
    def blocks(rows: DataFrame, terms: DataFrame, own: DataFrame) -> DataFrame:
        """query_id, segment, block, bound, turn: the blocks that have all terms of a query, the highest possible rank first."""
        heads = rows.select("segment", "block", "term", "most").join(terms, "term").groupBy("query_id", "segment", "block").agg(F.count("*").alias("n"), F.min("most").alias("most"))
        heads = heads.join(own.select("query_id", "need"), "query_id").where(F.col("n") == F.col("need"))
        bound = F.lit(search.COVER_WEIGHT) * F.col("need") * F.col("most")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        return heads.select("query_id", "segment", "block", bound.alias("bound")).withColumn("turn", F.row_number().over(order))

    def _ranked(self, rows: DataFrame, blocks: DataFrame, terms: DataFrame, own: DataFrame, state: snapshots.State, replaced: bool, category: Column | str | None) -> DataFrame:
        wanted = blocks.select("query_id", "segment", "block").join(terms, "query_id")
        found = rows.select("segment", "block", "term", "hits").join(wanted, ["segment", "block", "term"])
        each = self._live(found, state) if replaced else found.withColumn("h", F.explode("hits"))
        if category is not None:
            each = each.where(F.col("h.category") == category)
        return ranked(each.select("query_id", "h.key", "term", "h.positions").join(own, "query_id"))
