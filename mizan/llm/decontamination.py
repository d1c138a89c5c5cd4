"""Benchmark decontamination (operator 6).

Seeds are all distinct three-word sequences of each benchmark item, however
many documents hold them; so a copy is aligned if an edit left any three words
in a row. Where seeds of an item lie close together in a document, the words
around them are a candidate passage, unless they have too few of the item's words
to reach the score in any order. Passages join the items they are held against
and are aligned by Smith-Waterman (match 2, mismatch and gap -1); the score as
a share of a full match tells copies, edited ones too, from chance. Scores of
many passages are computed together; only those that reach the share are traced
back.

Frequent seeds aren't dropped, as an edited copy may have no other left: those
that no document holds cost nothing, and the test of words keeps passages of
chance from the alignment.

The benchmark is the query set: its seeds go to the tasks in blocks of about
`block_bytes` bytes of hashed words, and all documents are read for each block.

Defined results: words are runs of letters and digits in lower case, sharp s
as ss, dotted and dotless i as i (other letters whose capital is several
letters, such as ligatures, stay as they are); null and wordless texts hold
nothing; items that have fewer than MIN_WORDS words are found where a document
has exactly their words in a row (score 1, one seed, the first such place);
items that are null or wordless are never found; very long items are aligned
whole; items that repeat are found each; repeated document rows give their rows each; null doc_ids are searched as well; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.llm import common, kernels

N = 3
MIN_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, 1
#: Words are runs of letters and digits, so that marks put between or after words don't hide a copy.
WORDS = kernels.LETTERS
#: Share of a full match from which a passage counts as a copy.
SCORE = 0.35


def folded(texts: pa.Array) -> pa.Array:
    """Texts in which a letter and its capital are the same."""
    # by way of capitals, so that letters that share one (i and dotless i, both forms of small sigma) become one
    return pc.replace_substring(pc.utf8_lower(pc.utf8_upper(texts)), "ß", "ss")


def _rows_of(passage: np.ndarray, item: np.ndarray):
    """Rows of the alignment matrix, one for each word of the passage."""
    ramp = GAP * np.arange(len(item) + 1, dtype=np.int32)
    last = np.zeros(len(item) + 1, np.int32)
    for word in passage:
        now = np.zeros(len(item) + 1, np.int32)
        now[1:] = np.maximum(last[:-1] + np.where(item == word, MATCH, MISMATCH), last[1:] - GAP)
        np.maximum(now, 0, out=now)
        # a gap in the item: the best start to the left, less the gap's length
        now = np.maximum.accumulate(now + ramp) - ramp
        last = now
        yield now


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the first and last + 1 word of the passage it spans."""
    best, end, column = 0, 0, 0
    for i, row in enumerate(_rows_of(passage, item)):
        if row.max() > best:
            best, end, column = int(row.max()), i + 1, int(row.argmax())
    if not best:
        return 0, 0, 0
    back = 0
    for i, row in enumerate(_rows_of(passage[:end][::-1], item[:column][::-1])):
        if row.max() >= best:
            back = i + 1
            break
    return best, end - back, end


#: Cells of the alignment matrices that are computed together, a row of each at a time, and words of their passages.
CELLS, HELD_WORDS = 1 << 16, 1 << 20


def windows(n_passage: int, n_item: int) -> list[tuple[int, int]]:
    """Parts of a passage of which one holds any alignment with a score above 0.

    Such an alignment matches at most n_item words, each worth MATCH, and every
    other word of the passage within it costs 1 at least, so it spans fewer than
    (1 + MATCH) * n_item words. Neighbouring parts share so many.
    """
    reach = (1 + MATCH) * n_item
    size = max(2 * reach, 256)
    if n_passage <= size:
        return [(0, n_passage)]
    return [(a, min(a + size, n_passage)) for a in range(0, n_passage - reach, size - reach)]


def best_scores(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each passage with its item, as `align` has it, and the first of its windows that has it.

    Windows of about the same length with items of about the same length are
    computed together, so that little is filled up, and a bounded number of
    words at a time, however long a passage is.
    """
    best, where = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    alike: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for i, (p, own) in enumerate(zip(passages, items, strict=True)):
        for a, b in windows(len(p), len(own)):
            alike.setdefault((len(own).bit_length(), (b - a).bit_length()), []).append((i, a, b))
    for every in alike.values():
        wide, long = max(len(items[i]) for i, _, _ in every), max(b - a for _, a, b in every)
        step = max(1, min(CELLS // max(wide, 1), HELD_WORDS // max(long, 1)))
        for at in range(0, len(every), step):
            some = every[at : at + step]
            for (i, a, _), score in zip(some, _scores([passages[i][a:b] for i, a, b in some], [items[i] for i, _, _ in some]).tolist(), strict=True):
                if score > best[i]:  # a passage's windows come in order
                    best[i], where[i] = score, a
    return best, where


def _scores(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    wide, long = max(map(len, items)), max(map(len, passages))
    ramp = GAP * np.arange(wide + 1, dtype=np.int32)
    # the fill of items (0) and that of passages (1) match nothing
    own, words = np.zeros((len(items), wide), np.uint64), np.ones((long, len(items)), np.uint64)
    for k, (p, item) in enumerate(zip(passages, items, strict=True)):
        own[k, : len(item)] = item
        words[: len(p), k] = p
    last, best = np.zeros((len(items), wide + 1), np.int32), np.zeros(len(items), np.int32)
    for word in words:
        now = np.zeros_like(last)
        now[:, 1:] = np.maximum(last[:, :-1] + np.where(own == word[:, None], np.int32(MATCH), np.int32(MISMATCH)), last[:, 1:] - GAP)
        np.maximum(now, 0, out=now)
        last = np.maximum.accumulate(now + ramp, axis=1) - ramp
        np.maximum(best, last.max(axis=1), out=best)
    return best


class Lookup:
    """Which hashes are among the keys: a bit map first, then a search."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[keys >> np.uint64(64 - self.BITS)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, index into the keys) of every hash that is a key."""
        at = np.flatnonzero(self.map[h >> np.uint64(64 - self.BITS)])
        key = np.searchsorted(self.keys, h[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == h[at]
        return at[same], key[same]


def clusters(pos: np.ndarray, reach: int):
    """Slices of the ascending positions that lie within `reach` of each other."""
    cuts = np.flatnonzero(np.diff(pos) > reach) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)], strict=True)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the first of each text (len + 1)."""
    buf, offsets = kernels.text_bytes(folded(texts))
    starts, ends, first = kernels.words(buf, offsets, WORDS)
    return kernels.word_hashes(buf, starts, ends, WORDS), first


class Block:
    """Items of one block: their words, and an index from a seed's hash to the items that have it.

    `short` has the items of fewer than MIN_WORDS words: by number of words, items by the hash of all words.
    """

    def __init__(self, keys: list[int], words: list[np.ndarray]):
        self.short: dict[int, dict[int, list[int]]] = {}
        for key, h in zip(keys, words, strict=True):
            if 0 < len(h) < MIN_WORDS:
                self.short.setdefault(len(h), {}).setdefault(int(kernels.sequence_hashes(h, len(h))[0]), []).append(key)
        long = [(k, h) for k, h in zip(keys, words, strict=True) if len(h) >= MIN_WORDS]
        self.items, self.words = [k for k, _ in long], [h for _, h in long]
        grams = [np.unique(kernels.sequence_hashes(h, N)) for h in self.words]
        every = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(every, kind="stable")
        self.seeds, first = np.unique(every[order], return_index=True)
        self.owners, self.bounds = owner[order], np.append(first, len(every))

    def candidates(self, h: np.ndarray, pos: np.ndarray, seed: np.ndarray, score: float):
        """(item's place, first word, passage, seeds) where an item has seeds at these places of one document.

        A passage that has too few of the item's words for the score, however they stand, is left out.
        """
        n = self.bounds[seed + 1] - self.bounds[seed]
        at = np.repeat(self.bounds[seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, pos, seed = self.owners[at], np.repeat(pos, n), np.repeat(seed, n)
        order = np.lexsort((pos, item))
        item, pos, seed = item[order], pos[order], seed[order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)], strict=True):
            which = int(item[a]) if b > a else 0
            own, near = self.words[which] if b > a else None, pos[a:b]
            for c, d in clusters(near, len(own)) if b > a else ():
                first = max(0, int(near[c]) - len(own))
                passage = h[first : int(near[d - 1]) + N + len(own)]
                if np.isin(own, passage).sum() >= score * len(own):
                    yield which, first, passage, len(np.unique(seed[a + c : a + d]))

    def exact(self, h: np.ndarray, first: np.ndarray, lookups: dict[int, Lookup]):
        """(document, item, first word) of each short item's first place in each document."""
        for n, lookup in lookups.items():
            owner, inside = kernels.window_owner(first, n, len(h))
            at, key = lookup.hits(kernels.sequence_hashes(h, n))
            at, key = at[inside[at]], key[inside[at]]
            _, places = np.unique(owner[at] * len(lookup.keys) + key, return_index=True)
            for a, k in zip(at[places].tolist(), key[places].tolist(), strict=True):
                for item in self.short[n][int(lookup.keys[k])]:
                    yield int(owner[a]), item, a - int(first[owner[a]])


ITEMS = "item_key long, words binary"
PASSAGES = "row long, doc_id long, text_key long, item_key long, first_word long, n_seeds long, passage binary"
FOUND = "row long, doc_id long, text_key long, item_key long, score double, first_word long, last_word long, n_seeds long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def passages(docs: DataFrame, block: Block, score: float) -> DataFrame:
    """Passages of all documents that hold seeds of an item; without words where a short item stands exactly."""

    def run(batches):
        lookup = Lookup(block.seeds)
        lookups = {n: Lookup(np.array(sorted(own), np.uint64)) for n, own in block.short.items()}
        for batch in kernels.text_batches(batches):
            h, first = hashed_words(batch.column(3))
            owner, inside = kernels.window_owner(first, N, len(h))
            at, seed = lookup.hits(kernels.sequence_hashes(h, N))
            at, seed = at[inside[at]], seed[inside[at]]
            found = []
            for i in np.unique(owner[at]).tolist():
                own = slice(*np.searchsorted(owner[at], [i, i + 1]))
                found += [(i, block.items[which], a, n, p.tobytes()) for which, a, p, n in block.candidates(h[first[i] : first[i + 1]], at[own] - first[i], seed[own], score)]
            found += [(i, item, a, 1, None) for i, item, a in block.exact(h, first, lookups)]
            names = [c.to_pylist() for c in batch.columns[:3]]
            yield _batch([(*(c[i] for c in names), *rest) for i, *rest in found], PASSAGES)

    return common.mapped(docs.select("row", "doc_id", "text_key", "text"), run, PASSAGES)


def aligned(held: DataFrame, score: float) -> DataFrame:
    """Passages, each with its item's words, that reach the score."""

    def run(batches):
        for batch in kernels.text_batches(batches):
            rows, out, tried = batch.to_pylist(), [], []
            for r in rows:
                r["words"] = np.frombuffer(r["words"], np.uint64)
                if r["passage"] is None:
                    out.append((r, 1.0, r["first_word"], r["first_word"] + len(r["words"])))
                else:
                    r["passage"] = np.frombuffer(r["passage"], np.uint64)
                    tried.append(r)
            for r, p, at in zip(tried, *(x.tolist() for x in best_scores([r["passage"] for r in tried], [r["words"] for r in tried])), strict=True):
                if (share := p / (MATCH * len(r["words"]))) >= score:
                    # any better place before would be in a window before
                    end = next(b for a, b in windows(len(r["passage"]), len(r["words"])) if a == at)
                    _, a, b = align(r["passage"][at:end], r["words"])
                    out.append((r, share, r["first_word"] + at + a, r["first_word"] + at + b))
            yield _batch([(r["row"], r["doc_id"], r["text_key"], r["item_key"], share, a, b, r["n_seeds"]) for r, share, a, b in out], FOUND)

    return common.mapped(held.select(*[f.split()[0] for f in PASSAGES.split(", ")], "words"), run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each document and item of which it holds a copy: the best passage, the first of equal ones."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("many")).withColumn("item_key", F.monotonically_increasing_id())
    items = common.written(items, "items")

    def words(batches):
        for batch in kernels.text_batches(batches):
            h, first = hashed_words(batch.column(1))
            yield _batch([(k, h[a:b].tobytes()) for k, a, b in zip(batch.column(0).to_pylist(), first[:-1], first[1:], strict=True)], ITEMS)

    own = common.written(common.mapped(items.select("item_key", "text"), words, ITEMS).where(F.length("words") > 0), "item-words")
    size = own.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks, found = -(-size // block_bytes), []
    for b in range(blocks):
        # one block of the query set, about block_bytes of hashed words
        held = own.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == b).collect()
        found.append(passages(rows, Block([r["item_key"] for r in held], [np.frombuffer(r["words"], np.uint64) for r in held]), score))
    if not found:
        return spark.createDataFrame([], "doc_id long, text_key long, item_id long, score double, first_word long, last_word long, n_seeds long")
    # dealt anew, so that a document with very many passages isn't aligned by one task
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = reduce(DataFrame.union, found).repartition(n, "row", "item_key", "first_word")
    best = aligned(dealt.join(own, "item_key"), score).groupBy("row", "doc_id", "text_key", "item_key")
    best = best.agg(F.min(F.struct(-F.col("score"), "first_word", "last_word", "n_seeds")).alias("b"))
    best = best.join(items.select("item_key", "item_id", "many"), "item_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("many"))))
    return best.select("doc_id", "text_key", "item_id", (-F.col("b.col1")).alias("score"), "b.first_word", "b.last_word", "b.n_seeds")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "last_word", "n_seeds")
