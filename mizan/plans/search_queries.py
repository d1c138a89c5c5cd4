"""Retrieval queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import text
from mizan.functions.text import ACCENTS
from mizan.operators import reading, search, store
from mizan.operators.text_index import TextIndex
from mizan.operators.vector_index import VectorIndex
from mizan.plans.registry import query
from mizan.plans.text_queries import FOLD, STEM
from mizan.sources.folders import new_folder
from mizan.sources.tables import DOCS, documents, read

#: The searches that the queries below make: (query_id, text).
ASKED = [(0, "the of"), (1, "ent"), (2, "de la"), (3, "kein treffer hier")]

_FTS_FOLD = f"lower(translate({{}}, '{ACCENTS[0]}', '{ACCENTS[1]}'))"
_TOKENS = "list_filter(string_split_regex(" + _FTS_FOLD + ", '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def keyword_sql(words: list[str], table: str, where: str = "true") -> str:
    """SQL of keyword_score over a table with document_id, title, decision_date, decision_number, category."""
    fold, everything = FOLD.format("title"), "lower(translate(title, 'İIŞÇÜÖĞ', 'iışçüöğ')) || ' ' || " + " || ' ' || ".join(FOLD.format(c) for c in ("decision_date", "decision_number", "category"))
    stems = f"list_aggregate(list_transform(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''), lambda w: {STEM.format('w')}), 'string_agg', ' ')"
    parts = []
    for w in words:
        f = FOLD.format(f"'{w}'")
        parts.append(f"CASE WHEN contains(t, {f}) THEN 3 WHEN contains(s, {STEM.format(f)}) THEN 2 WHEN contains(x, {f}) THEN 1 END")
    return (
        f"f AS (SELECT *, {fold} AS t, {everything} AS x FROM {table} WHERE {where}), g AS (SELECT *, {stems} AS s FROM f), scored AS (SELECT *, {' + '.join(parts)} AS score FROM g) "
    )


_CATALOG = "c AS (SELECT CAST(p_partkey AS VARCHAR) AS document_id, p_name AS title, p_type AS category, strftime(DATE '2020-01-01' + CAST(p_size AS INT) * 20, '%d.%m.%Y') AS decision_date, CAST(p_partkey * 7 AS VARCHAR) AS decision_number FROM part)"


def _catalog(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_size") * 20).cast("int"))
    return p.select(F.col("p_partkey").cast("string").alias("document_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.date_format(day, "dd.MM.yyyy").alias("decision_date"), (F.col("p_partkey") * 7).cast("string").alias("decision_number"))


@query(f"WITH {_CATALOG}, {keyword_sql(['part', '1'], 'c')} SELECT document_id, title, CAST(score AS INT) AS score, (SELECT count(*) FROM scored WHERE score IS NOT NULL) AS total_results FROM scored WHERE score IS NOT NULL ORDER BY score DESC, document_id LIMIT 10 OFFSET 10")
def keyword_search(spark, sf_dir):
    return search.keyword_search(_catalog(spark, sf_dir), "part 1", page=2).select("document_id", "title", "score", "total_results")


@query(
    f"WITH {_CATALOG}, {keyword_sql(['7'], 'c', chr(39).join(['contains(lower(translate(category, ', 'İIŞÇÜÖĞ', ', ', 'iışçüöğ', ')), lower(', 'st', '))']) + ' AND strptime(decision_date, ' + chr(39) + '%d.%m.%Y' + chr(39) + ') BETWEEN DATE ' + chr(39) + '2020-03-01' + chr(39) + ' AND DATE ' + chr(39) + '2021-12-31' + chr(39))} "
    "SELECT document_id, title, CAST(score AS INT) AS score, (SELECT count(*) FROM scored WHERE score IS NOT NULL) AS total_results FROM scored WHERE score IS NOT NULL ORDER BY score DESC, document_id LIMIT 50"
)
def keyword_search_filtered(spark, sf_dir):
    return search.keyword_search(_catalog(spark, sf_dir), "7", category="st", first="1.3.2020", last="31/12/2021", size=50).select("document_id", "title", "score", "total_results")


TITLES = ["Bankaların Kredi İşlemleri Yönetmeliği", "Kredi Kartları Tebliği", "IŞIK ve İNŞAAT Genelgesi", "Sermaye Yeterliliği Rehberi"]


@query("SELECT * FROM (VALUES (-1, 6, NULL), (-2, NULL, 9), (-3, NULL, NULL), (-4, NULL, NULL)) t(id, kredi_banka, kredi_kartlar) UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 6 END, CASE WHEN p_partkey % 3 = 0 THEN 9 END FROM part")
def keyword_scores(spark, sf_dir):
    own = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Kredi Kartları Tebliği ' WHEN 1 THEN 'Bankaların Kredi İşlemleri ' ELSE '' END || p_name").alias("title"))
    d = own.union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TITLES)], "id long, title string"))
    return d.select("id", search.keyword_score("KREDİ banka", F.col("title")).alias("kredi_banka"), search.keyword_score("kredi kartlar tebliği", F.col("title")).alias("kredi_kartlar"))


def _asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


_ASKED = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") q(query_id, query)"


#: A text for every vector that is asked: those of ASKED in turn.
_ASKED_EVERY = f"(SELECT CAST(vec_id // 50 AS INT), a.query FROM embeddings JOIN {_ASKED.replace('q(query_id', 'a(k')} ON vec_id // 50 % {len(ASKED)} = a.k WHERE vec_id % 50 = 0) q(query_id, query)"


def fts_sql(source: str, key: str, asked: str = _ASKED) -> str:
    """SQL of the cover-density ranking of the asked searches over a table (key, x)."""
    return (
        f"tok AS (SELECT {key} AS key, {_TOKENS.format('x')} AS tokens FROM {source}), places AS (SELECT key, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM tok), "
        f"terms AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('query')}) AS term FROM {asked}), need AS (SELECT query_id, count(*) AS need FROM terms GROUP BY 1), "
        "h0 AS (SELECT query_id, key, pos, term FROM places JOIN terms USING (term)), ok AS (SELECT query_id, key FROM h0 GROUP BY 1, 2 HAVING count(DISTINCT term) = (SELECT need FROM need n WHERE n.query_id = h0.query_id)), "
        "h AS (SELECT h0.*, row_number() OVER (PARTITION BY query_id, key ORDER BY pos) AS k FROM h0 JOIN ok USING (query_id, key)), "
        "s AS (SELECT h.query_id, h.key, h.pos, h.k, max(CASE WHEN h.term = t.term THEN h.pos END) OVER w AS lp, max(CASE WHEN h.term = t.term THEN h.k END) OVER w AS lk FROM h JOIN terms t USING (query_id) WINDOW w AS (PARTITION BY h.query_id, h.key, t.term ORDER BY h.pos)), "
        "e AS (SELECT query_id, key, pos, k, min(lp) AS b, min(lk) AS kb, count(lp) AS seen FROM s GROUP BY 1, 2, 3, 4), c AS (SELECT e.* FROM e JOIN need USING (query_id) WHERE seen = need), "
        "m AS (SELECT *, lag(b) OVER (PARTITION BY query_id, key ORDER BY pos) AS pb FROM c), r AS (SELECT query_id, key, sum(0.1 / (1 + (pos - b) - (k - kb))) AS rank FROM m WHERE pb IS NULL OR b > pb GROUP BY 1, 2), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, key) AS position FROM r)"
    )


def _ranked(found):
    return found.withColumn("rank", F.round("rank", 6))


@query(f"WITH {fts_sql('(SELECT doc_id, text AS x FROM documents)', 'doc_id')} SELECT query_id, key AS doc_id, round(rank, 6) AS rank, position FROM best WHERE position <= 50 AND rank >= 0.01")
def fts_rank(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    return _ranked(search.fts(d, _asked(spark), "doc_id")).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {fts_sql('(SELECT doc_id, text AS x FROM documents)', 'doc_id')} SELECT query_id, key AS doc_id, round(rank, 6) AS rank, position FROM best WHERE position <= 50 AND rank >= 0.01")
def text_index_rank(spark, sf_dir):
    """fts_rank by way of a stored index, made in two batches."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("category"), text.tokens(F.col("text")).alias("tokens"))
    index = TextIndex(spark, new_folder(spark, "text-index"))
    for batch in (d.where("key % 2 = 0"), d.where("key % 2 <> 0")):
        index.add(batch)
    return _ranked(index.search(_asked(spark))).withColumnRenamed("key", "doc_id").withColumn("position", F.col("position").cast("long"))


@query(f"WITH tok AS (SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents) SELECT query_id, doc_id FROM tok, {_ASKED} WHERE len(list_filter({_TOKENS.format('query')}, lambda t: NOT list_contains(tokens, t))) = 0")
def fts_match(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    return search.fts_matches(d, _asked(spark), "doc_id")


_CHUNK_FTS = (
    f"{DOCS}, cut AS (SELECT doc_id, CASE WHEN length(markdown_content) <= 1000 THEN [markdown_content] ELSE list_transform(range(0, length(markdown_content), 800), lambda s: substring(markdown_content, s + 1, 1000)) END AS parts FROM docs), "
    "ch AS (SELECT CAST(doc_id * 10000 AS BIGINT) + unnest(range(len(parts))) AS chunk, unnest(parts) AS x FROM cut)"
)


@query(f"WITH {_CHUNK_FTS}, {fts_sql('ch', 'chunk')}, l AS (SELECT *, key // 10000 AS doc_id FROM best WHERE position <= 50), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY position) AS rn FROM l) SELECT query_id, doc_id, round(rank, 6) AS rank FROM o WHERE rn = 1")
def fts_chunk_search(spark, sf_dir):
    d = documents(spark, sf_dir)
    c = store.chunk_table(d).select((F.col("document_id").cast("long") * 10000 + F.col("chunk_index")).alias("chunk"), text.tokens(F.col("chunk_text")).alias("tokens"))
    found = search.fts(c, _asked(spark), "chunk", threshold=None, clean=False).withColumn("doc_id", F.floor(F.col("chunk") / 10000))
    from mizan.operators.evaluation import first_of

    best = first_of(found.withColumn("k", F.struct("query_id", "doc_id")), "k", ["position"])
    return _ranked(best).select("query_id", "doc_id", "rank")


_VECTORS = "v AS (SELECT vec_id AS doc_id, vec_id % 3 AS chunk_index, CAST(label AS VARCHAR) AS category, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qv AS (SELECT CAST(doc_id // 50 AS INT) AS query_id, e AS q FROM v WHERE doc_id % 50 = 0), ch AS (SELECT doc_id // 2 AS doc_id, doc_id % 2 AS chunk_index, category, e FROM v)"
_NEAR = (
    f"{_VECTORS}, d AS (SELECT query_id, doc_id, chunk_index, category, round(1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 12) AS distance FROM ch, qv WHERE {{}}), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id, chunk_index) AS nth FROM d), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY distance, chunk_index) AS own FROM f WHERE nth <= {}), "
    "vs AS (SELECT query_id, doc_id, category, distance, round(1 - distance, 4) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS position FROM o WHERE own = 1)"
)


def _vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    chunks = v.select(F.floor(F.col("vec_id") / 2).alias("doc_id"), (F.col("vec_id") % 2).alias("chunk_index"), F.col("label").cast("string").alias("category"), "embedding")
    asked = v.where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).cast("int").alias("query_id"), "embedding")
    return chunks, asked


def _shown(found):
    return found.select("query_id", "doc_id", "category", F.round("distance", 6).alias("distance"), "relevance", F.col("position").cast("long").alias("position"))


@query(f"WITH {_NEAR.format('true', 50)} SELECT query_id, doc_id, category, round(distance, 6) AS distance, relevance, position FROM vs WHERE position <= 10")
def vector_topk(spark, sf_dir):
    return _shown(search.vector_search(*_vectors(spark, sf_dir), limit=10))


@query(f"WITH {_NEAR.format(chr(39).join(['category = ', '3', '']), 100)} SELECT query_id, doc_id, category, round(distance, 6) AS distance, relevance, position FROM vs WHERE position <= 20")
def vector_topk_category(spark, sf_dir):
    return _shown(search.vector_search(*_vectors(spark, sf_dir), limit=20, category="3"))


@query()
def vector_index_topk(spark, sf_dir):
    """vector_topk by way of a stored index of all rows."""
    chunks, asked = _vectors(spark, sf_dir)
    return _shown(search.vector_search(None, asked, limit=10, index=VectorIndex.build(chunks, new_folder(spark, "vector-index"))))


@query()
def vector_index_recall(spark, sf_dir):
    """How many of each query's ten nearest rows the index finds."""
    chunks, asked = _vectors(spark, sf_dir)
    keys = ["query_id", "doc_id", "chunk_index"]
    found = VectorIndex.build(chunks, new_folder(spark, "vector-index")).nearest(asked, 10).select(*keys, F.lit(1).alias("found"))
    true = search.nearest(chunks, asked, 10, search.cosine_distances)
    return true.join(found, keys, "left").groupBy("query_id").agg(F.count("*").alias("n_true"), F.count("found").alias("n_found"))


_FUSED = (
    f"{_NEAR.format('true', 100)}, {fts_sql('(SELECT doc_id, text AS x FROM documents)', 'doc_id', _ASKED_EVERY)}, ft AS (SELECT query_id, key AS doc_id, rank, position FROM best WHERE position <= 50), "
    "gv AS (SELECT query_id, doc_id, position, CASE WHEN query_id IN (SELECT query_id FROM ft) THEN relevance ELSE round(relevance * 0.65 + 1e-10, 4) END AS relevance FROM vs WHERE position <= 50), "
    "u AS (SELECT query_id, doc_id, relevance, NULL AS fts_rank, 1.0 / (60 + position) AS part FROM gv UNION ALL SELECT query_id, doc_id, NULL, rank, 1.0 / (60 + position) FROM ft), "
    "fused AS (SELECT query_id, doc_id, coalesce(max(relevance), 0.0) AS relevance, max(fts_rank) AS fts_rank, round(sum(CAST(part AS DOUBLE)), 6) AS rrf_score FROM u GROUP BY 1, 2)"
)


def _both(spark, sf_dir):
    chunks, vectors = _vectors(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    texts = _asked(spark).withColumnRenamed("query_id", "k")
    return chunks, docs, vectors.join(texts, F.col("query_id") % len(ASKED) == F.col("k")).drop("k")


@query(f"WITH {_FUSED} SELECT query_id, doc_id, relevance, round(fts_rank, 6) AS fts_rank, rrf_score FROM fused")
def rrf_fusion(spark, sf_dir):
    chunks, docs, asked = _both(spark, sf_dir)
    fused = search.fuse(search.vector_search(chunks, asked, 50), search.fts_of_texts(docs, asked))
    return fused.withColumn("fts_rank", F.round("fts_rank", 6))


@query(
    f"WITH {_FUSED}, b AS (SELECT *, max(relevance) OVER (PARTITION BY query_id) AS top FROM fused WHERE relevance >= 0.5), "
    "z AS (SELECT query_id, doc_id, relevance, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rrf_score DESC, doc_id) AS position FROM b WHERE top - relevance <= 0.08) "
    "SELECT query_id, doc_id, relevance, rrf_score, position, CASE WHEN relevance >= 0.7 THEN 'high' WHEN relevance >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM z WHERE position <= 10"
)
def hybrid_search(spark, sf_dir):
    found = search.hybrid_search(*_both(spark, sf_dir))
    return found.select("query_id", "doc_id", "relevance", "rrf_score", F.col("position").cast("long").alias("position"), "confidence")


@query(
    "WITH s AS (SELECT CAST(p_partkey % 40 AS INT) AS query_id, p_partkey AS doc_id, round(p_size / 50.0::DOUBLE, 4) AS relevance FROM part), t AS (SELECT *, max(relevance) OVER (PARTITION BY query_id) AS top FROM s) "
    "SELECT query_id, doc_id, relevance, CASE WHEN relevance >= 0.7 THEN 'high' WHEN relevance >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM t WHERE top - relevance <= 0.08::DOUBLE"
)
def score_gap(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    d = p.select((F.col("p_partkey") % 40).cast("int").alias("query_id"), F.col("p_partkey").alias("doc_id"), F.round(F.col("p_size") / F.lit(50.0), 4).alias("relevance"))
    return search.within_gap(d).select("query_id", "doc_id", "relevance", "confidence")


@query(f"WITH {_VECTORS}, s AS (SELECT query_id, doc_id, chunk_index, round(1 / (1 + exp(-list_dot_product(e, q))), 4) AS score FROM ch, qv) SELECT query_id, doc_id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rn FROM s) WHERE rn <= 20")
def rerank_sigmoid(spark, sf_dir):
    found = search.nearest(*_vectors(spark, sf_dir), 20, search.sigmoid_below_zero)
    return found.select("query_id", "doc_id", "chunk_index", (-F.col("value")).alias("score"))


def headline_sql(words: str, pairs: str) -> str:
    """SQL of headlines: tables words (key, tokens), terms (query_id, term) and need, and pairs (query_id, key); makes `shown` (query_id, key, snippet)."""
    return (
        f"hh AS (SELECT p.query_id, p.key, u.pos, u.term, row_number() OVER (PARTITION BY p.query_id, p.key ORDER BY u.pos) AS k FROM {pairs} p JOIN (SELECT key, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM {words}) u USING (key) JOIN terms t ON t.query_id = p.query_id AND t.term = u.term), "
        "hs AS (SELECT hh.query_id, hh.key, hh.pos, max(CASE WHEN hh.term = t.term THEN hh.pos END) OVER w AS lp FROM hh JOIN terms t USING (query_id) WINDOW w AS (PARTITION BY hh.query_id, hh.key, t.term ORDER BY hh.pos)), "
        "he AS (SELECT query_id, key, pos, min(lp) AS b, count(lp) AS seen FROM hs GROUP BY 1, 2, 3), hc AS (SELECT *, lag(b) OVER (PARTITION BY query_id, key ORDER BY pos) AS pb FROM he JOIN need USING (query_id) WHERE seen = need), "
        f"hw AS (SELECT DISTINCT query_id, key, CASE WHEN pos - b + 1 < 20 AND b + 20 > len(tokens) THEN greatest(len(tokens) - 20, 0) ELSE b END AS s, CASE WHEN pos - b + 1 > 40 THEN b + 40 WHEN pos - b + 1 >= 20 THEN pos + 1 ELSE least(b + 20, len(tokens)) END AS e FROM hc JOIN {words} USING (key) WHERE pb IS NULL OR b > pb), "
        "hn AS (SELECT hw.query_id, hw.key, s, e, count(*) AS n FROM hw JOIN hh ON hh.query_id = hw.query_id AND hh.key = hw.key AND hh.pos >= s AND hh.pos < e GROUP BY ALL), hb AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY n DESC, s, e) AS rn FROM hn), "
        f"shown AS (SELECT p.query_id, p.key, array_to_string(list_transform(tokens[coalesce(s, 0) + 1:coalesce(e, 20)], lambda word: CASE WHEN list_contains(own.terms, word) THEN '>>>' || word || '<<<' ELSE word END), ' ') AS snippet "
        f"FROM {pairs} p JOIN {words} USING (key) LEFT JOIN (SELECT query_id, list(term) AS terms FROM terms GROUP BY 1) own ON own.query_id = p.query_id LEFT JOIN (SELECT * FROM hb WHERE rn = 1) hb ON hb.query_id = p.query_id AND hb.key = p.key)"
    )


@query(
    f"WITH t AS (SELECT doc_id AS key, {_TOKENS.format('text')} AS tokens FROM documents), terms AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('query')}) AS term FROM {_ASKED}), need AS (SELECT query_id, count(*) AS need FROM terms GROUP BY 1), "
    f"pairs AS (SELECT DISTINCT query_id, key FROM (SELECT key, unnest(tokens) AS term FROM t) JOIN terms USING (term)), {headline_sql('t', 'pairs')} SELECT query_id, key AS doc_id, snippet FROM shown"
)
def fts_headline(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.explode_outer(F.array(text.tokens(F.col("text")))).alias("tokens"))
    terms = search.query_terms(_asked(spark), clean=False)
    wanted = terms.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    asked = F.array(*[F.lit(r["term"]) for r in terms.select("term").distinct().collect()])  # those of ASKED
    held = d.withColumn("own", F.array_intersect("tokens", asked)).withColumn("term", F.explode("own")).join(F.broadcast(wanted.withColumn("term", F.explode("terms"))), "term")
    # a document that has several terms of a query meets it by the first of them
    found = held.where(F.col("term") == F.get(F.array_intersect("terms", "own"), 0)).select("query_id", "key", "tokens")
    return search.headlines(found, terms).withColumnRenamed("key", "doc_id")


_DOCUMENT_TEXT = "(SELECT document_id, coalesce(title, '') || ' ' || coalesce(markdown_content, '') || ' ' || coalesce(category, '') AS x FROM docs{})"


_FTS_TEXT = "coalesce(markdown_content, '')"


def document_search_sql(where: str = "") -> str:
    return (
        f"WITH {DOCS}, {fts_sql(_DOCUMENT_TEXT.format(where), 'document_id')}, pairs AS (SELECT query_id, key FROM best WHERE position <= 50 AND rank >= 0.01), "
        f"cw AS (SELECT document_id AS key, {_TOKENS.format(_FTS_TEXT)} AS tokens FROM docs WHERE document_id IN (SELECT key FROM pairs)), {headline_sql('cw', 'pairs')} "
        "SELECT query_id, key AS document_id, title, category, round(rank, 6) AS rank, position, snippet FROM shown JOIN best USING (query_id, key) JOIN docs ON docs.document_id = key"
    )


def _document_search(spark, sf_dir, category=None):
    docs = documents(spark, sf_dir)
    found = search.document_search(docs, search.document_tokens(docs), _asked(spark), category=category)
    return _ranked(found).withColumn("position", F.col("position").cast("long"))


@query(document_search_sql())
def document_search(spark, sf_dir):
    return _document_search(spark, sf_dir)


@query(document_search_sql(" WHERE category = 'src3'"))
def document_search_category(spark, sf_dir):
    return _document_search(spark, sf_dir, "src3")


@query(document_search_sql(" WHERE category = 'src3'"))
def text_index_search(spark, sf_dir):
    """document_search_category by way of a stored index of titles, contents and categories."""
    docs = documents(spark, sf_dir)
    index = TextIndex(spark, new_folder(spark, "text-index"))
    index.add(search.document_tokens(docs).withColumnRenamed("document_id", "key"))
    found = search.document_search(docs, None, _asked(spark), category="src3", index=index)
    return _ranked(found).withColumn("position", F.col("position").cast("long"))


_SCOPE = (("src1",), ("xyz",))


@query(
    f"WITH {DOCS}, c AS (SELECT document_id, title, category, '' AS decision_date, document_id AS decision_number FROM docs WHERE category NOT IN ('src1') AND NOT contains(lower(coalesce(title, '')), 'xyz')), {keyword_sql(['en'], 'c')}, "
    "p AS (SELECT document_id, title, CAST(score AS INT) AS score, (SELECT count(*) FROM scored WHERE score IS NOT NULL) AS total_results FROM scored WHERE score IS NOT NULL ORDER BY score DESC, document_id LIMIT 10), "
    "n AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, count(*) AS versions, CAST(max(quality) + 1 AS INT) AS latest FROM labels GROUP BY 1) SELECT p.*, coalesce(versions, 0) AS versions, latest FROM p LEFT JOIN n USING (document_id)"
)
def decision_search(spark, sf_dir):
    d = documents(spark, sf_dir).where(search.in_scope(F.col("title"), F.col("category"), *_SCOPE))
    catalog = d.select("document_id", "title", "category", F.lit("").alias("decision_date"), F.col("document_id").alias("decision_number"))
    versions = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("document_id"), (F.col("quality") + 1).cast("int").alias("version"))
    found = search.keyword_search(catalog, "en").select("document_id", "title", "score", "total_results")
    return search.with_versions(found, versions)


@query(f"WITH {_NEAR.format('true', 50)} SELECT query_id, vs.doc_id, relevance, position, coalesce(substring(text, 1, 800), '') AS snippet FROM vs LEFT JOIN documents USING (doc_id) WHERE position <= 10")
def vector_snippets(spark, sf_dir):
    found = search.vector_search(*_vectors(spark, sf_dir), limit=10).select("query_id", "doc_id", "relevance", F.col("position").cast("long").alias("position"))
    return search.with_snippets(found, read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def shared_words(pairs):
    """A stand-in for a rerank model: how many words of the query the text has, less one."""
    return [len(set(q.split()) & set(t.split())) - 1.0 for q, t in pairs]


_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"


@query(
    f"WITH {_FUSED}, pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS place FROM fused), "
    f"model AS (SELECT query_id, doc_id, len(list_intersect(list_distinct({_WORDS.format('query')}), list_distinct({_WORDS.format('substring(text, 1, 800)')}))) - 1 AS s FROM pl JOIN documents USING (doc_id) JOIN {_ASKED_EVERY} USING (query_id) WHERE place <= 20), "
    "rr AS (SELECT query_id, doc_id, rrf_score, s, CASE WHEN s IS NULL THEN relevance ELSE round(1 / (1 + exp(-s)), 4) END AS relevance FROM pl LEFT JOIN model USING (query_id, doc_id)), "
    "near_top AS (SELECT *, max(relevance) OVER (PARTITION BY query_id) AS top FROM rr WHERE relevance >= 0.5), "
    "z AS (SELECT query_id, doc_id, relevance, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rrf_score DESC, doc_id) AS position FROM near_top WHERE top - relevance <= 0.08) SELECT * FROM z WHERE position <= 10"
)
def reranked_search(spark, sf_dir):
    texts = search.with_snippets(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    found = search.hybrid_search(*_both(spark, sf_dir), score=search.scorer(shared_words), texts=texts)
    return found.select("query_id", "doc_id", "relevance", "rrf_score", F.col("position").cast("long").alias("position"))


_READ = (
    f"WITH {DOCS}, st AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN document_id WHEN doc_id % 3 = 1 THEN 'a_' || document_id ELSE 'b_' || document_id END AS id, title, category, extraction_method AS lang, markdown_content AS x, "
    "CAST(greatest(1, ceil(length(markdown_content) / 5000.0)) AS INT) AS n FROM docs), "
    "r AS (SELECT document_id AS requested, CAST(doc_id % 3 + 1 AS INT) AS page, doc_id FROM docs) "
)


@query(
    _READ + "SELECT requested, r.page, CASE WHEN r.page <= n AND x <> '' THEN id END AS document_id, CASE WHEN r.page <= n AND x <> '' THEN CASE WHEN r.doc_id % 2 = 0 AND trim(regexp_replace(x, '[\\s\\p{Z}]+', '', 'g')) <> '' THEN 0 ELSE 1 END END AS source, "
    "CASE WHEN r.page <= n AND x <> '' THEN n END AS total_pages, CASE WHEN r.page <= n AND x <> '' THEN substring(x, (r.page - 1) * 5000 + 1, 5000) END AS content, "
    "CASE WHEN r.page <= n AND x <> '' THEN CASE WHEN r.doc_id % 5 = 0 THEN id ELSE title END END AS title, CASE WHEN r.page <= n AND x <> '' THEN lang <> 'de' END AS warned FROM r JOIN st USING (doc_id)"
)
def document_pages(spark, sf_dir):
    d = documents(spark, sf_dir)
    prefix = F.element_at(F.array(F.lit(""), F.lit("a_"), F.lit("b_")), (F.col("doc_id") % 3 + 1).cast("int"))
    method = F.when(F.col("extraction_method") == "de", "chandra2_de").otherwise(F.col("extraction_method"))
    stored = d.withColumn("requested", F.col("document_id")).withColumn("document_id", F.concat(prefix, "document_id")).withColumn("extraction_method", method)
    catalog = stored.where("doc_id % 5 <> 0").select("document_id", "title", "category")
    requests = stored.select("requested", (F.col("doc_id") % 3 + 1).cast("int").alias("page"))
    found = reading.read_pages(requests, store.chunk_table(stored.where("doc_id % 2 = 0")), stored, catalog, ("a_", "b_"))
    warned = F.when(F.col("document_id").isNotNull(), F.col("warning").isNotNull())
    return found.select("requested", "page", "document_id", "source", "total_pages", "content", "title", warned.alias("warned"))


@query(
    f"WITH {DOCS}, r AS (SELECT document_id, markdown_content AS x, doc_id, CAST(doc_id % 2 + 1 AS INT) AS page, CAST(greatest(1, ceil(length(markdown_content) / 5000.0)) AS INT) AS n FROM docs) "
    "SELECT document_id AS requested, page, CASE WHEN doc_id % 2 = 1 OR x = '' OR page > n THEN 1 ELSE 0 END AS source, n AS total_pages, "
    "CASE WHEN page > n THEN 'Invalid page ' || page || ', document has ' || n || ' pages' ELSE substring(x, (page - 1) * 5000 + 1, 5000) END AS content FROM r"
)
def document_pages_fetched(spark, sf_dir):
    d = documents(spark, sf_dir)
    requests = d.select(F.col("document_id").alias("requested"), (F.col("doc_id") % 2 + 1).cast("int").alias("page"))
    pages, _ = reading.read_or_fetch(requests, d.where("doc_id % 2 = 0"), lambda ids: d.select("document_id", F.col("markdown_content").alias("content")).join(ids, "document_id", "left_semi"))
    return pages.select("requested", "page", "source", "total_pages", "content")
