"""Keyword, full-text, vector and hybrid retrieval.

Queries are tables with a query_id wherever ranks are taken, so no window has
all rows in one partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.functions import text

#: Fixed values of the ranking.
RRF_K = 60
FTS_LIMIT, FTS_THRESHOLD = 50, 0.01
VECTOR_FETCH_FACTOR, VECTOR_FETCH_MAX = 5, 100
RELEVANCE_THRESHOLD, GAP, GATE = 0.50, 0.08, 0.65
HIGH, MEDIUM = 0.70, 0.50
COVER_WEIGHT = 0.1
#: Characters of a snippet, candidates that a model ranks anew.
SNIPPET_CHARS, RERANK_FIRST = 800, 20
#: Words of a headline, at least (where the document has so many) and at most.
FRAGMENT_WORDS = (20, 40)
#: Distinct terms of all queries together that are looked up and ranked inside the token arrays; more join the tokens.
INSIDE_TERMS = 256
#: Query vectors that go to the tasks together, and values of rows with queries that are computed at once.
QUERY_BLOCK, CELLS = 2000, 1 << 19


def in_scope(title: Column, category: Column, categories: tuple[str, ...], substrings: tuple[str, ...]) -> Column:
    """Neither an excluded category nor an excluded part of the title (plain lower case)."""
    kept = ~F.coalesce(category, F.lit("")).isin(*categories) if categories else F.lit(True)
    for s in substrings:
        kept = kept & ~F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(s.lower()))
    return kept


def category_contains(category: Column, wanted: str) -> Column:
    return F.contains(text.lower_tr(F.coalesce(category, F.lit(""))), text.lower_tr(F.lit(wanted)))


def in_period(date: Column, first: str | None, last: str | None) -> Column:
    """Closed range of textual dates; undated rows go only if a readable bound is set."""
    d, kept = text.parse_date(date), F.lit(True)
    for bound, test in ((first, lambda b: d >= b), (last, lambda b: d <= b)):
        if bound is not None:
            b = text.parse_date(F.lit(bound))
            kept = kept & F.when(b.isNull(), F.lit(True)).otherwise(F.coalesce(test(b), F.lit(False)))
    return kept


def in_trailing_days(date: Column, now: str, days: int) -> Column:
    """Dotted dates from today to `days` days back; `now` is a timestamp text."""
    d = F.try_to_timestamp(date, F.lit("d.M.yyyy"))
    age = F.floor((F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(d)) / 86400)
    return F.coalesce((age >= 0) & (age <= days), F.lit(False))


def keyword_score(keywords: str, title: Column, *fields: Column) -> Column:
    """Sum over words: 3 in the title, 2 by stem, 1 in any field; null unless every word is found."""
    words = [w for w in keywords.split() if w]
    if not words:
        return F.lit(None).cast("int")
    folded = text.lower_tr(F.coalesce(title, F.lit("")))
    everything = F.concat_ws(" ", folded, *[text.lower_tr(F.coalesce(f, F.lit(""))) for f in fields])
    stems = F.array_join(F.transform(F.filter(F.split(everything, r"(?U)\s+"), lambda w: w != ""), text.stem_tr), " ")
    total = F.lit(0)
    for w in words:
        word = text.lower_tr(F.lit(w))
        total = total + F.when(F.contains(folded, word), 3).when(F.contains(stems, text.stem_tr(word)), 2).when(F.contains(everything, word), 1)
    return total


def page_of(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of the ordered rows, with the number of all."""
    total = rows.agg(F.count("*").alias("total_results"))  # one row
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def keyword_search(catalog: DataFrame, keywords: str, category: str | None = None, first: str | None = None, last: str | None = None, page: int = 1, size: int = 10) -> DataFrame:
    """Catalog rows (document_id, title, category, decision_date, decision_number) by score, ties by id."""
    rows = catalog
    if category:
        rows = rows.where(category_contains(F.col("category"), category))
    rows = rows.where(in_period(F.col("decision_date"), first, last))
    score = keyword_score(keywords, F.col("title"), F.col("decision_date"), F.col("decision_number"), F.col("category"))
    return page_of(rows.withColumn("score", score).where(F.col("score").isNotNull()), [F.desc("score"), "document_id"], page, size)


def covers(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Minimal intervals that hold all terms: query_id, key, first and last position, and the numbers of those hits.

    hits: query_id, key, pos, term; terms: query_id, term (distinct). One term
    makes each hit a cover. Only windows over one query and document.
    """
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    own = Window.partitionBy("query_id", "key").orderBy("pos")
    hits = hits.withColumn("k", F.row_number().over(own))
    # for every hit and query term, the last hit of that term so far
    spread = hits.join(F.broadcast(terms.withColumnRenamed("term", "q")), "query_id")
    last = Window.partitionBy("query_id", "key", "q").orderBy("pos")
    at = F.when(F.col("term") == F.col("q"), F.struct("pos", "k"))
    spread = spread.withColumn("last", F.max(at).over(last))
    ends = spread.groupBy("query_id", "key", "pos", "k").agg(F.min("last").alias("begin"), F.count("last").alias("seen"))
    ends = ends.join(F.broadcast(need), "query_id").where(F.col("seen") == F.col("need"))
    ends = ends.withColumn("before", F.lag("begin.pos").over(own))
    minimal = ends.where(F.col("before").isNull() | (F.col("begin.pos") > F.col("before")))
    return minimal.select("query_id", "key", F.col("begin.pos").alias("first"), F.col("pos").alias("last"), F.col("begin.k").alias("first_k"), F.col("k").alias("last_k"))


def cover_density(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Rank by cover density: 0.1 / (1 + noise) for every cover; noise are the words in it that aren't hits."""
    noise = (F.col("last") - F.col("first")) - (F.col("last_k") - F.col("first_k"))
    return covers(hits, terms).groupBy("query_id", "key").agg(F.sum(F.lit(COVER_WEIGHT) / (1 + noise)).alias("rank"))


def cover_rank(hits: Column, terms: Column) -> Column:
    """Rank by cover density of one document: hits (pos, term), in order, and the query's distinct terms."""
    own = F.filter(F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), F.array_position(terms, h["term"]).alias("t"))), lambda h: h["t"] > 0)
    none = F.transform(terms, lambda t: F.lit(None).cast("struct<pos: int, k: int>"))
    start = F.struct(none.alias("last"), F.lit(0).alias("k"), F.lit(-1).alias("before"), F.lit(0.0).alias("rank"))

    def seen(state: Column, hit: Column) -> Column:
        """The last hit of each term, and how many hits there are."""
        here = F.struct(hit["pos"].alias("pos"), (state["k"] + 1).alias("k"))
        last = F.transform(state["last"], lambda x, i: F.when(i + 1 == hit["t"], here).otherwise(x))
        return F.struct(last.alias("last"), (state["k"] + 1).alias("k"), state["before"].alias("before"), state["rank"].alias("rank"), hit["pos"].alias("pos"))

    def judged(state: Column) -> Column:
        """Adds the cover that ends here, if every term has been there and it begins after the one before."""
        begin = F.array_min(state["last"])
        new = F.forall(state["last"], lambda x: x.isNotNull()) & (begin["pos"] > state["before"])
        noise = (state["pos"] - begin["pos"]) - (state["k"] - begin["k"])
        return F.struct(
            state["last"].alias("last"), state["k"].alias("k"), F.when(new, begin["pos"]).otherwise(state["before"]).alias("before"),
            (state["rank"] + F.when(new, F.lit(COVER_WEIGHT) / (1 + noise)).otherwise(0.0)).alias("rank"),
        )

    # a one-element array gives the state a name, so that it is made once
    step = lambda state, hit: F.element_at(F.transform(F.array(seen(state, hit)), judged), 1)
    return F.aggregate(own, start, step, lambda state: state["rank"])


def anchored(terms: DataFrame) -> DataFrame:
    """query_id, anchor, terms: one term of each query, the longest, by which documents meet it."""
    found = terms.groupBy("query_id").agg(F.max(F.struct(F.length("term").alias("n"), "term")).alias("a"), F.collect_list("term").alias("terms"))
    return found.select("query_id", F.col("a.term").alias("anchor"), "terms")


def ranked_inside(docs: DataFrame, terms: DataFrame, asked: list[str], key: str) -> DataFrame:
    """query_id, key, rank of the documents that hold all terms of a query; asked: the terms of all queries.

    Hits are found and ranked inside each document's row, so nothing of it is shuffled.
    """
    wanted = F.array(*[F.lit(t) for t in sorted(asked)]) if asked else F.array().cast("array<string>")
    found = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("term"))), lambda x: F.array_contains(wanted, x["term"]))
    # at most INSIDE_TERMS terms; explode_outer, as the inner form would split every text twice, first to test for an empty array
    held = docs.select(F.col(key).alias("key"), F.explode_outer(F.array(found)).alias("hits")).where(F.size("hits") > 0)
    held = held.withColumn("own", F.array_distinct(F.transform("hits", lambda h: h["term"])))
    both = held.withColumn("anchor", F.explode("own")).join(F.broadcast(anchored(terms)), "anchor").where(F.size(F.array_except("terms", "own")) == 0)
    return both.select("query_id", "key", cover_rank(F.col("hits"), F.col("terms")).alias("rank")).where("rank > 0")


def hits_of(docs: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """query_id, key, pos, term wherever a query's term stands."""
    at = docs.select(F.col(key).alias("key"), F.posexplode_outer("tokens").alias("pos", "term"))
    return at.join(F.broadcast(terms), "term").select("query_id", "key", "pos", "term")


def fts_matches(docs: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query_id, key of the documents that hold all terms of a query; one without terms matches all.

    Documents meet the terms one by one, and a query whose terms they all have;
    a query without terms asks for the empty one, which all documents hold if it is asked.
    """
    asked = queries.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("terms"))
    asked = asked.withColumn("terms", F.when(F.size("terms") == 0, F.array(F.lit(""))).otherwise(F.col("terms")))
    terms = asked.select("query_id", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    every = not terms.where("term = ''").isEmpty()
    own = F.array_distinct("tokens")
    held = docs.select(F.col(key).alias(key), F.explode(F.array_append(own, F.lit("")) if every else own).alias("term"))
    return held.join(F.broadcast(terms), "term").groupBy("query_id", "need", key).agg(F.count("*").alias("n")).where("n = need").select("query_id", key)


def query_terms(queries: DataFrame, clean: bool = True) -> DataFrame:
    """query_id, term: the distinct terms of each query."""
    term = text.clean_query(F.col("query")) if clean else F.col("query")
    return queries.select("query_id", F.explode(F.array_distinct(text.tokens(term))).alias("term"))


def fts(docs: DataFrame, queries: DataFrame, key: str, limit: int = FTS_LIMIT, threshold: float | None = FTS_THRESHOLD, clean: bool = True, category: str | None = None) -> DataFrame:
    """query_id, key, rank of the best rows of each query; docs hold `key` and `tokens`, and `category` if one is asked.

    Rows below the threshold go after the limit, as it may shorten a full list.
    """
    terms = query_terms(queries, clean)
    some = docs if category is None else docs.where(F.col("category") == category)
    asked = [r["term"] for r in terms.select("term").distinct().limit(INSIDE_TERMS + 1).collect()]
    # a document that lacks a term has no cover, and so no rank
    ranked = ranked_inside(some, terms, asked, key) if len(asked) <= INSIDE_TERMS else cover_density(hits_of(some, terms, key), terms)
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), "key")
    best = ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    if threshold is not None:
        best = best.where(F.col("rank") >= threshold)
    return best.select("query_id", F.col("key").alias(key), "rank", "position")


def best_fragment(hits: Column, terms: Column, n: Column) -> Column:
    """Struct of start and stop (words) of the fragment that shows a document of n words best; null without a cover of all terms.

    hits: (pos, term) of the query's distinct terms, in order. Every cover is
    stretched to FRAGMENT_WORDS[0] words, to the right and at the end of the
    document to the left, or cut to FRAGMENT_WORDS[1]; the one with the most hits
    is the best, then the first. A fragment's hits are counted among the next
    FRAGMENT_WORDS[1] ones only, so the work follows the hits.
    """
    least, most = FRAGMENT_WORDS
    own = F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), F.array_position(terms, h["term"]).alias("t")))
    none = F.transform(terms, lambda t: F.lit(None).cast("struct<pos: int, k: int>"))
    best = F.lit(None).cast("struct<hits: int, start: int, stop: int>")
    begin = F.struct(none.alias("last"), F.lit(0).alias("k"), F.lit(-1).alias("before"), best.alias("best"))

    def seen(state: Column, hit: Column) -> Column:
        """The last hit of each term, and how many hits there are."""
        here = F.struct(hit["pos"].alias("pos"), (state["k"] + 1).alias("k"))
        last = F.transform(state["last"], lambda x, i: F.when(i + 1 == hit["t"], here).otherwise(x))
        return F.struct(last.alias("last"), (state["k"] + 1).alias("k"), state["before"].alias("before"), state["best"].alias("best"), hit["pos"].alias("pos"))

    def shown(first: Column, k: Column, last: Column) -> Column:
        """The fragment of a cover that begins at the k-th hit."""
        words = last - first + 1
        moved = (words < least) & (first + least > n)
        start = F.when(moved, F.greatest(n - least, F.lit(0))).otherwise(first)
        stop = F.when(words > most, first + most).when(words >= least, last + 1).otherwise(F.least(first + least, n))
        ahead = F.size(F.filter(F.slice(hits, k, F.lit(most)), lambda h: h["pos"] < stop))
        at_end = F.size(F.filter(F.slice(hits, F.greatest(F.size(hits) - least + 1, F.lit(1)), F.lit(least)), lambda h: h["pos"] >= n - least))
        return F.struct((-F.when(moved, at_end).otherwise(ahead)).alias("hits"), start.alias("start"), stop.alias("stop"))

    def judged(state: Column) -> Column:
        """Adds the cover that ends here, if every term has been there and it begins after the one before."""
        first = F.array_min(state["last"])
        new = F.forall(state["last"], lambda x: x.isNotNull()) & (first["pos"] > state["before"])
        return F.struct(
            state["last"].alias("last"), state["k"].alias("k"), F.when(new, first["pos"]).otherwise(state["before"]).alias("before"),
            F.when(new, F.least(state["best"], shown(first["pos"], first["k"], state["pos"]))).otherwise(state["best"]).alias("best"),
        )

    # a one-element array gives the state a name, so that it is made once
    step = lambda state, hit: F.element_at(F.transform(F.array(seen(state, hit)), judged), 1)
    return F.aggregate(own, begin, step, lambda state: state["best"])


def headlines(found: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, key, snippet of found documents (query_id, key, tokens): words of the best fragment, hits between >>> and <<<.

    Without a cover of all terms the first FRAGMENT_WORDS[0] words are shown. The
    fragment is found inside each row, so that a task holds one document at a
    time and nothing is shuffled; only the queries' terms go to all tasks.
    """
    wanted = F.broadcast(terms.groupBy("query_id").agg(F.collect_list("term").alias("terms")))
    # explode_outer of one element: made once, and not anew wherever it is used
    rows = found.select("query_id", "key", F.explode_outer(F.array("tokens")).alias("tokens")).join(wanted, "query_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    hits = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("term"))), lambda x: F.array_contains("terms", x["term"]))
    rows = rows.select("query_id", "key", "tokens", "terms", F.explode_outer(F.array(hits)).alias("hits"))
    best = best_fragment(F.col("hits"), F.col("terms"), F.size("tokens"))
    shown = rows.select("query_id", "key", "tokens", "terms", F.explode_outer(F.array(best)).alias("best"))
    start = F.coalesce("best.start", F.lit(0))
    cut = F.slice("tokens", start + 1, F.coalesce("best.stop", F.lit(FRAGMENT_WORDS[0])) - start)
    marked = F.transform(cut, lambda t: F.when(F.array_contains("terms", t), F.concat(F.lit(">>>"), t, F.lit("<<<"))).otherwise(t))
    return shown.select("query_id", "key", F.array_join(marked, " ").alias("snippet"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def products(e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot product of each row of e with each of q, summed in order, so that equal rows give equal values."""
    out = np.zeros((len(e), len(q)))
    for j in range(e.shape[1]):
        out += e[:, j, None] * q[:, j]
    return out


def cosine_distances(e: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        norms = [np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1]) for x in (e, q)]
        return np.round(1 - products(e, q) / (norms[0][:, None] * norms[1]), 12)


def sigmoid_below_zero(e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sigmoid of the dot product, negative, as small values are the best."""
    return -np.round(1 / (1 + np.exp(-products(e, q))), 4)


def nearest(chunks: DataFrame, queries: DataFrame, fetch: int, measure) -> DataFrame:
    """query_id, doc_id, chunk_index, category, value: for each query the rows with the smallest measure.

    Queries (query_id, embedding) go to the tasks in blocks, and all chunks are
    read for each block; a task hands on its best `fetch` rows of a query only.
    Ties by doc_id, chunk_index. Vectors that are null, of another length than
    most queries or without a value (norm 0) are never found.
    """
    spark = chunks.sparkSession
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q IS NOT NULL AND size(q) > 0")
    size, total = asked.agg(F.mode(F.size("q")), F.count("*")).first()
    asked = asked.where(F.size("q") == F.lit(size))
    rows = chunks.select("doc_id", "chunk_index", "category", F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == F.lit(size))
    kinds = {c.name: c.dataType.simpleString() for c in [queries.schema["query_id"], *rows.schema[:3]]}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items()) + ", value double"

    def run_with(ids: pa.Array, q: np.ndarray):
        def best(table: pa.Table, at: np.ndarray, value: np.ndarray):
            order = np.lexsort((table["chunk_index"].to_numpy(), table["doc_id"].to_numpy(), value, at))
            first = np.searchsorted(at[order], at[order])
            order = order[np.arange(len(order)) - first < fetch]
            return table.take(pa.array(order)), at[order], value[order]

        def run(batches):
            held, bound = None, np.full(len(q), np.inf)
            step = max(1, CELLS // len(q))
            for batch in batches:
                for begin in range(0, batch.num_rows, step):
                    part = batch.slice(begin, step)
                    values = measure(part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), q)
                    values[np.isnan(values)] = np.inf
                    if part.num_rows >= fetch:
                        bound = np.minimum(bound, np.partition(values, fetch - 1, axis=0)[fetch - 1])
                    row, at = np.nonzero((values <= bound) & (values < np.inf))
                    more = pa.Table.from_batches([part.select([0, 1, 2])]).take(pa.array(row)), at, values[row, at]
                    held = more if held is None else (pa.concat_tables([held[0], more[0]]), *(np.concatenate(x) for x in zip(held[1:], more[1:], strict=True)))
                    if len(held[1]) > 2 * fetch * len(q):
                        held = best(*held)
            if held is not None:
                table, at, value = best(*held)
                out = pa.table([ids.take(pa.array(at)), *table.columns, pa.array(value)], names=[*kinds, "value"])
                yield from out.to_batches(max_chunksize=10_000)

        return run

    found = spark.createDataFrame([], schema)
    blocks = -(-total // QUERY_BLOCK)
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            q = own["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            found = found.unionByName(rows.mapInArrow(run_with(own["query_id"].combine_chunks(), q), schema))
    order = Window.partitionBy("query_id").orderBy("value", "doc_id", "chunk_index")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= fetch).drop("at")


def vector_search(chunks: DataFrame | None, queries: DataFrame, limit: int, category: str | None = None, index=None) -> DataFrame:
    """Best documents of each query: distance, relevance. chunks: doc_id, chunk_index, category, embedding.

    Takes min(5 * limit, 100) nearest chunks first, then the best chunk of each
    document, then the limit. With a VectorIndex the nearest chunks are those of
    the lists that it probes, and chunks aren't read.
    """
    fetch = min(VECTOR_FETCH_FACTOR * limit, VECTOR_FETCH_MAX)
    if index is not None:
        near = index.nearest(queries, fetch, category=category)
    else:
        near = nearest(chunks if category is None else chunks.where(F.col("category") == category), queries, fetch, cosine_distances)
    near = near.withColumnRenamed("value", "distance")
    near = near.withColumn("own", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("distance", "chunk_index"))).where("own = 1")
    near = near.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))).where(F.col("position") <= limit)
    return near.select("query_id", "doc_id", "category", "distance", F.round(1 - F.col("distance"), 4).alias("relevance"), "position")


def fts_of_texts(docs: DataFrame, queries: DataFrame, category: str | None = None) -> DataFrame:
    """fts for many queries of which many have the same text: each text is searched once."""
    texts = queries.groupBy("query").agg(F.min("query_id").alias("text_id"))
    found = fts(docs, texts.withColumnRenamed("text_id", "query_id"), "doc_id", threshold=None, clean=False, category=category).withColumnRenamed("query_id", "text_id")
    return queries.select("query_id", "query").join(texts, "query").select("query_id", "text_id").join(found, "text_id").drop("text_id")


def fuse(vector: DataFrame, full_text: DataFrame, k: int = RRF_K, gate: float = GATE) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, position) lists; a text-only hit has relevance 0.

    Relevance is lowered by the gate for queries without any text hit; halves round up.
    """
    v = vector.select("query_id", "doc_id", F.col("relevance"), F.lit(None).cast("double").alias("fts_rank"), (1 / (k + F.col("position"))).alias("part"))
    t = full_text.select("query_id", "doc_id", F.lit(None).cast("double").alias("relevance"), F.col("rank").alias("fts_rank"), (1 / (k + F.col("position"))).alias("part"))
    some = F.max(F.col("fts_rank").isNotNull()).over(Window.partitionBy("query_id"))
    low = F.round(F.col("relevance") * gate + 1e-10, 4)
    both = v.unionByName(t).withColumn("some", some).withColumn("relevance", F.when(F.col("some"), F.col("relevance")).otherwise(low))
    both = both.groupBy("query_id", "doc_id")
    return both.agg(F.coalesce(F.max("relevance"), F.lit(0.0)).alias("relevance"), F.max("fts_rank").alias("fts_rank"), F.round(F.sum("part"), 6).alias("rrf_score"))


def confidence(relevance: Column) -> Column:
    return F.when(relevance >= HIGH, "high").when(relevance >= MEDIUM, "medium").otherwise("low")


def sigmoid(x: Column) -> Column:
    return F.round(1 / (1 + F.exp(-x)), 4)


def scorer(predict: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32) -> Callable:
    """A model that scores (query, text) pairs as an Arrow UDF; it sees `batch` pairs at a time."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = list(zip(queries, texts, strict=True))
        return pd.Series([float(x) for at in range(0, len(pairs), batch) for x in predict(pairs[at : at + batch])], dtype="float64")

    return run


def reranked(fused: DataFrame, queries: DataFrame, texts: DataFrame, score, first: int = RERANK_FIRST) -> DataFrame:
    """The first rows of each query by rrf_score get the model's score, and its sigmoid as relevance.

    score: a column function of query and snippet; texts: doc_id, snippet.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "doc_id")
    placed = fused.withColumn("place", F.row_number().over(order))
    # only the rows that the model sees meet their texts
    seen = placed.where(F.col("place") <= first).join(texts, "doc_id").join(queries.select("query_id", "query"), "query_id")
    scored = seen.select("query_id", "doc_id", score(F.col("query"), F.coalesce("snippet", F.lit(""))).alias("rerank_score"))
    out = placed.join(scored, ["query_id", "doc_id"], "left")
    return out.withColumn("relevance", F.coalesce(sigmoid(F.col("rerank_score")), F.col("relevance"))).drop("place")


def within_gap(found: DataFrame, gap: float = GAP) -> DataFrame:
    """Rows of each query that are not more than the gap behind its best, with their confidence."""
    best = F.max("relevance").over(Window.partitionBy("query_id"))
    some = found.withColumn("top", best).where(F.col("top") - F.col("relevance") <= gap).drop("top")
    return some.withColumn("confidence", confidence(F.col("relevance")))


def hybrid_search(
    chunks: DataFrame, docs: DataFrame, queries: DataFrame, limit: int = 10, threshold: float = RELEVANCE_THRESHOLD, category: str | None = None, score=None, texts: DataFrame | None = None, index=None
) -> DataFrame:
    """Vector and full-text search fused; queries: query_id, query, embedding; score and texts as in reranked; index as in vector_search.

    Below the threshold rows go, then those more than the gap behind the best.
    """
    fused = fuse(vector_search(chunks, queries, 50, category, index), fts_of_texts(docs, queries, category))
    if score is not None:
        fused = reranked(fused, queries, texts, score)
    fused = within_gap(fused.where(F.col("relevance") >= threshold))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("rrf_score"), "doc_id")
    return fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def with_snippets(found: DataFrame, texts: DataFrame, keys: list[str], chars: int = SNIPPET_CHARS) -> DataFrame:
    """Results with the beginning of their text; texts: keys and text."""
    own = texts.select(*keys, F.substring("text", 1, chars).alias("snippet"))
    return found.join(own, keys, "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def with_versions(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Results with how many earlier versions of the document there are and the latest's number."""
    own = versions.join(found.select("document_id").distinct(), "document_id", "left_semi")
    counts = own.groupBy("document_id").agg(F.count("*").alias("versions"), F.max("version").alias("latest"))
    return found.join(counts, "document_id", "left").withColumn("versions", F.coalesce("versions", F.lit(0)))


def document_tokens(docs: DataFrame) -> DataFrame:
    """document_id, category and the tokens of title, content and category, positions running on.

    The table to store: a search then reads tokens instead of splitting texts.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "markdown_content", "category")]
    return docs.select("document_id", "category", text.tokens(F.concat_ws(" ", *parts)).alias("tokens"))


def document_search(docs: DataFrame, tokens: DataFrame | None, queries: DataFrame, limit: int = FTS_LIMIT, category: str | None = None, index=None) -> DataFrame:
    """Best documents of each query with title, date, category and a headline of the content.

    tokens: as document_tokens makes them, or none with a TextIndex of them.
    Only the found documents' texts are read for headlines.
    """
    if index is not None:
        found = index.search(queries, limit, category=category).withColumnRenamed("key", "document_id")
    else:
        found = fts(tokens, queries, "document_id", limit, category=category)
    terms = query_terms(queries)
    own = docs.select("document_id", "title", "category", "markdown_content").join(found, "document_id")
    words = own.select("query_id", F.col("document_id").alias("key"), text.tokens(F.col("markdown_content")).alias("tokens"))
    own = own.join(headlines(words, terms).withColumnRenamed("key", "document_id"), ["query_id", "document_id"])
    return own.select("query_id", "document_id", "title", "category", "rank", "position", "snippet")


def institutions(rows: DataFrame, keyword: str | None = None, kind: str | None = None, active_only: bool = True, active: str = "Aktif") -> DataFrame:
    """Directory rows by status, then by type (all types if none fits), then by a word in name or type."""
    some = rows.where(F.col("status") == active) if active_only else rows
    if kind:
        some = of_type_or_all(some, "type", kind)
    if keyword:
        word = text.lower_tr(F.lit(keyword))
        some = some.where(F.contains(text.lower_tr(F.col("name")), word) | F.contains(text.lower_tr(F.col("type")), word))
    return some


def of_type_or_all(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows whose column holds the text; all rows if none does."""
    hit = F.contains(F.lower(column), F.lit(wanted.lower()))
    some = rows.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("some"))  # one row
    return rows.crossJoin(F.broadcast(some)).where(hit | ~F.col("some")).drop("some")


def first_contained(x: Column, table: dict[str, str], default: str) -> Column:
    """The value of the first key that the folded text holds, else the default."""
    low, out = text.lower_tr(x), None
    for word, value in table.items():
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def resolve_aliases(requests: DataFrame, sources: list[DataFrame], prefixes: tuple[str, ...]) -> DataFrame:
    """First of the id and its prefixed forms, then first of the sources, that has a document.

    Sources hold document_id and content; only digits get prefixes.
    """
    plain = F.array(F.col("requested"))
    forms = F.when(F.col("requested").rlike("^[0-9]+$"), F.concat(plain, F.array(*[F.concat(F.lit(p), F.col("requested")) for p in prefixes]))).otherwise(plain)
    wanted = requests.select("requested", F.posexplode(forms).alias("form", "document_id"))
    every = None
    for i, source in enumerate(sources):
        one = source.select("document_id", "content", F.lit(i).alias("source"))
        every = one if every is None else every.unionByName(one)
    found = wanted.join(every, "document_id")
    best = Window.partitionBy("requested").orderBy("form", "source")
    return found.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("requested", "document_id", "source", "content")
