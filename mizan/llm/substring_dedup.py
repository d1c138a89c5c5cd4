"""Substring dedup by De Bruijn compaction (operator 3).

Every `window` consecutive words of a document are an edge of the graph of
word sequences. Edges are not stored one by one: consecutive edges that have
the same minimizer (the smallest hash of their `anchor`-word parts, a function
of the edge's words alone) form a piece, so every copy of an edge lies in a
piece with the same minimizer. Then, with Spark joins:

1. pieces whose minimizer occurs once in the corpus drop out;
2. repeated equal pieces that always follow one another, in every copy, compact
   into nonbranching paths with the coordinates of their copies; the copy in
   the smallest document is the source. A copy is verified against the text at
   the source's coordinates: each piece of either carries a 128-bit digest of
   its words, made by two independent families of hashes, and the digests of
   all pieces, each with its place in the path, must agree; later copies are
   covered;
3. where a minimizer has different pieces the paths branch; there, and only
   there, the single edges are hashed and looked up in smaller documents.

The covered word positions of a document are merged and its other words kept.

Defined results: null and wordless texts have no words; texts shorter than a
window keep all; rows with a null doc_id are neither sources nor shortened;
rows that share a doc_id don't shorten each other, as no doc_id is smaller; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common, kernels

WINDOW = 50
ANCHOR = 20
_INVERSE = pow(kernels.SEQ_BASE, -1, 2**64)


def _power(base: int, n: int) -> np.ndarray:
    full = np.full(n, base, np.uint64)
    full[:1] = 1
    return np.multiply.accumulate(full)


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each h[start:end], whatever its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(kernels.SEQ_BASE, len(h)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power(_INVERSE, len(h))[starts]
    return kernels.mix(own ^ ((ends - starts).astype(np.uint64) * np.uint64(kernels.WORD_BASE)))


def minimizers(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    return kernels.sliding_minimum(kernels.sequence_hashes(h, anchor), window - anchor + 1)


PIECES = "doc_id long, text_key long, m long, id long, proof long, start int, n int"
#: Hashes words independently of kernels.EXACT.
PROOF = kernels.Alphabet(kernels.EXACT.is_word, lower=False, seed=kernels.BYTE_SEED + 1)


def pieces(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Runs of n edges from word `start` on that share minimizer m; id and proof together are the digest of their words."""

    def run(batches):
        for batch in kernels.text_batches(batches):
            buf, offsets = kernels.text_bytes(batch.column(2))
            starts, ends, first = kernels.words(buf, offsets)
            h = kernels.word_hashes(buf, starts, ends)
            if len(h) < window:
                continue
            owner, inside = kernels.window_owner(first, window, len(h))
            m = minimizers(h, window, anchor)
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1]) | (m[1:] != m[:-1])
            at = np.flatnonzero(begins)
            if not len(at):
                continue
            # edges up to the next piece, but for those that span two documents
            n = np.add.reduceat(inside.astype(np.int64), at)
            ids = span_hashes(h, at, at + n + window - 1)
            proof = span_hashes(kernels.word_hashes(buf, starts, ends, PROOF), at, at + n + window - 1)
            rows = owner[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(m[at].view(np.int64)), pa.array(ids.view(np.int64)), pa.array(proof.view(np.int64)), pa.array((at - first[rows]).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )

    return common.mapped(docs.where("doc_id IS NOT NULL").select("doc_id", "text_key", "text"), run, PIECES)


def repeated_pieces(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Pieces whose minimizer occurs more than once, each with its content's source document."""
    every = common.written(pieces(docs, window, anchor), "pieces")
    many = common.written(every.groupBy("m").agg(F.count("*").alias("many")).where("many > 1").select("m"), "anchors")
    some = common.written(every.join(many, "m").dropDuplicates(["doc_id", "text_key", "start"]), "shared-pieces")
    contents = some.groupBy("m", "id", "proof").agg(F.min("doc_id").alias("source"), F.count("*").alias("copies"))
    contents = common.written(contents, "contents")
    branching = contents.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1").select("m", F.lit(True).alias("branching"))
    contents = contents.join(common.written(branching, "branching"), "m", "left").select("m", "id", "proof", "source", "copies", F.coalesce("branching", F.lit(False)).alias("branching"))
    return common.written(some.join(common.written(contents, "sources"), ["m", "id", "proof"]), "repeated")


def paths(repeated: DataFrame, window: int) -> DataFrame:
    """Copies of nonbranching paths: doc_id, text_key, path, source, a, b (words a <= i < b), n, digest.

    A link p -> q is nonbranching if q follows p and p precedes q in all copies.
    Pieces are told apart by their 64-bit id here; a copy that another piece
    joined to a path by chance has another digest than its source.
    """
    place = Window.partitionBy("doc_id", "text_key").orderBy("start")
    near = repeated.where("copies > 1").select("doc_id", "text_key", "start", "n", "id", "proof", "copies", "source")
    after, before = F.lead(F.struct("id", "start")).over(place), F.lag(F.struct("id", "start", "n")).over(place)
    near = near.withColumn("after", after).withColumn("before", before)
    near = near.withColumn("next", F.when(F.col("after.start") == F.col("start") + F.col("n"), F.col("after.id")))
    near = near.withColumn("prev", F.when(F.col("before.start") + F.col("before.n") == F.col("start"), F.col("before.id")))
    near = common.written(near.drop("after", "before"), "neighbours")
    node = near.groupBy("id").agg(*[f(c).alias(f"{n}_{c}") for c in ("next", "prev") for n, f in (("min", F.min), ("max", F.max), ("has", F.count))], F.count("*").alias("copies"))
    only = lambda c: (F.col(f"min_{c}") == F.col(f"max_{c}")) & (F.col(f"has_{c}") == F.col("copies"))
    one_next = node.where(only("next")).select(F.col("id").alias("p"), F.col("min_next").alias("q"))
    one_prev = node.where(only("prev")).select(F.col("id").alias("q"), F.col("min_prev").alias("p"))
    inner = common.written(one_next.join(one_prev, ["p", "q"]).select(F.col("q").alias("id"), F.lit(1).alias("inner")), "links")
    walk = near.join(inner, "id", "left")
    run = F.max(F.when(F.col("inner").isNull(), F.col("start"))).over(place)  # a path's copy begins at the last piece without an inner link
    walk = walk.withColumn("run", run)
    # sums of 31 bits of a hash of each piece's digest and its place in the path
    part = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(i), F.col("start") - F.col("run"), "n", "id", "proof"), 33)).alias(f"digest_{i}") for i in range(4)]
    found = walk.groupBy("doc_id", "text_key", "run").agg(F.min_by("id", "start").alias("path"), F.min("source").alias("source"), F.sum("n").alias("n"), *part)
    digest = F.struct(*[f"digest_{i}" for i in range(4)]).alias("digest")
    copy = found.select("doc_id", "text_key", "path", "source", F.col("run").cast("long").alias("a"), (F.col("run") + F.col("n") + window - 1).alias("b"), "n", digest)
    return common.written(copy, "paths")


def verified_copies(copies: DataFrame) -> DataFrame:
    """Copies that lie after their source and have its length and digest."""
    source = copies.where(F.col("doc_id") == F.col("source")).groupBy("path").agg(F.min(F.struct("doc_id", "a", "n", "digest")).alias("s"))
    later = copies.where(F.col("doc_id") > F.col("source")).join(common.written(source, "path-sources"), "path")
    return later.where((F.col("n") == F.col("s.n")) & (F.col("digest") == F.col("s.digest")) & (F.col("s.doc_id") < F.col("doc_id"))).select("doc_id", "text_key", "a", "b")


EDGES = "doc_id long, text_key long, m long, w long, pos long"


def branch_edges(docs: DataFrame, repeated: DataFrame, window: int, anchor: int) -> DataFrame:
    """Words a <= i < b of single edges, in pieces where paths branch, that a smaller document has too."""
    own = repeated.where(F.col("branching") & (F.col("doc_id") == F.col("source")))
    spans = own.groupBy(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    held = docs.join(spans, (F.col("doc_id") == F.col("s_id")) & (F.col("text_key") == F.col("s_key"))).select("doc_id", "text_key", "text", "spans")

    def run(batches):
        for batch in kernels.text_batches(batches):
            buf, offsets = kernels.text_bytes(batch.column(2))
            starts, ends, first = kernels.words(buf, offsets)
            h = kernels.word_hashes(buf, starts, ends)
            w, m = kernels.sequence_hashes(h, window), minimizers(h, window, anchor)
            lists = batch.column(3)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            start, n = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos, row = np.repeat(start, n) + inside, np.repeat(rows, n)
            at = pos + first[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(m[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(pos)], names=[c.split()[0] for c in EDGES.split(", ")])

    edges = common.written(common.mapped(held, run, EDGES).distinct(), "edges")
    low = edges.groupBy("m", "w").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("m", "w", "low")
    found = edges.join(common.written(low, "edge-sources"), ["m", "w"]).where(F.col("doc_id") > F.col("low"))
    return found.select("doc_id", "text_key", F.col("pos").alias("a"), (F.col("pos") + window).alias("b"))


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and text (the kept words, by single spaces)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    repeated = repeated_pieces(rows, window, anchor)
    spans = verified_copies(paths(repeated, window)).union(branch_edges(rows, repeated, window, anchor))
    spans = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    held = rows.join(common.written(spans, "spans"), (F.col("doc_id") == F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left")

    def run(batches):
        for batch in kernels.text_batches(batches):
            out = []
            for name, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                found = text.as_py().encode().split() if text.is_valid else []
                n = len(found)
                if spans.is_valid:
                    gone = np.zeros(n + 1, np.int64)
                    pairs = spans.values
                    np.add.at(gone, np.asarray(pairs.field(0)), 1)
                    np.add.at(gone, np.asarray(pairs.field(1)), -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    found = [found[i] for i in np.flatnonzero(keep)]
                kept = b" ".join(found)
                out.append((name, n, n - len(found), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in KEPT.split(", ")])

    return common.mapped(held.select("doc_id", "text", "spans"), run, KEPT)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, unnest(range(len(ws) - 49)) AS p, unnest(list_transform(range(len(ws) - 49), lambda i: array_to_string(ws[i + 1:i + 50], ' '))) AS key FROM w WHERE len(ws) >= 50),
m AS (SELECT key, min(doc_id) AS low FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT k.doc_id, k.p + o AS pos FROM k JOIN m USING (key), range(50) t(o) WHERE k.doc_id > m.low),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words x ANTI JOIN c USING (doc_id, pos) GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
