"""Language identification (operator 8).

Features are TF-IDF weights of hashed character n-grams (1 to 3 letters; what
isn't a letter counts as one space). Document frequencies come from all
learning documents. A sparse multinomial logistic regression is trained by
follow-the-regularised-leader (FTRL-Proximal) with elastic-net penalties on a
bounded sample, `per_language` documents of each language at most and
`documents` in all, of the `languages` languages with the most documents; its
scores are calibrated by one temperature on a part of the sample that it was
not trained on.

Defined results: null texts and texts without a letter are `und` with score 0;
so is everything if there is nothing to learn from; documents with null doc_id
are predicted, not held out and not learnt from; null lang isn't learnt from;
repeated rows are predicted each; an empty table gives no rows; columns other
than doc_id, text and lang are ignored, and lang only where it is learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common, kernels

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """Parameters of the training."""

    per_language: int = 1000
    documents: int = 16_000  # the share of each language falls where there are more than 16
    languages: int = 400  # those with the most learning documents, the smaller name first among equals
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 0.01
    l1: float = 1e-4
    l2: float = 1e-3
    held_back: int = 5  # every fifth document of the sample calibrates


@lru_cache(1)
def _letters() -> np.ndarray:
    """Every code point as itself if it is a letter, else as a space."""
    codes = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, codes, np.uint32(32))


def grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each order the bucket of every n-gram and its document bounds; n-grams and letters of each text.

    Bounds are pairs of indexes into the buckets, first and last + 1 of a text.
    """
    joined = pc.utf8_lower(texts.fill_null("")).to_pylist()
    codes = _letters()[np.frombuffer(" ".join(["", *joined, ""]).encode("utf-32-le"), np.uint32)]
    lengths = np.array([len(t) for t in joined], np.int64)
    begin = np.cumsum(lengths + 1) - lengths  # each text, with the space before and after it
    first, last = begin - 1, begin + lengths + 1
    space = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[first] = True  # the space before a text is also the one after the text before
    place = np.cumsum(keep) - 1
    first_kept = place[first]
    # a text ends with a kept space: its own trailing one or the next text's first
    last_kept = np.append(place[last[:-1] - 1], place[-1]) + 1 if len(first) else first
    codes = codes[keep].astype(np.uint64)
    letters = np.add.reduceat((codes != 32).astype(np.int64), first_kept) if len(first) else first
    total, out = np.zeros(len(first), np.int64), []
    for n in ORDERS:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j]
        h = ((h * np.uint64(0xD1342543DE82EF95)) >> np.uint64(48)).astype(np.int32)
        start = np.minimum(first_kept, len(h))
        end = np.maximum(start, np.minimum(last_kept - n + 1, len(h)))
        total += end - start
        out.append((h, np.stack([start, end], axis=1)))
    return out, total, letters


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[a:b] for every row (a, b) of bounds; b may equal a."""
    padded = np.append(values, values.dtype.type(0))
    return np.where(bounds[:, 1] > bounds[:, 0], np.add.reduceat(padded, bounds.ravel())[::2], 0)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, over all rows, and the number of rows."""

    def run(batches):
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in kernels.text_batches(batches, 2 << 20):
            orders, _, _ = grams(batch.column(0))
            for i in range(batch.num_rows):
                seen = np.zeros(BUCKETS, bool)
                for h, bounds in orders:
                    seen[h[bounds[i, 0] : bounds[i, 1]]] = True
                df[:-1] += seen
            n += batch.num_rows
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])

    # one row a bucket: bounded by BUCKETS
    rows = common.mapped(docs.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in rows:
        df[bucket] = n
    return df[:-1], int(df[-1])


def sample_features(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, share of the n-grams) of each row, in a fixed order; for the bounded sample only."""

    def run(batches):
        for batch in kernels.text_batches(batches, 2 << 20):
            orders, total, _ = grams(batch.column(0))
            buckets, shares = [], []
            for i in range(batch.num_rows):
                found, count = np.unique(np.concatenate([h[b[i, 0] : b[i, 1]] for h, b in orders]), return_counts=True)
                buckets.append(found.astype("<i4").tobytes())
                shares.append((count / max(1, total[i])).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], names=["lang", "turn", "buckets", "shares"])

    rows = common.mapped(docs.select("text", "lang", "turn"), run, "lang string, turn long, buckets binary, shares binary").collect()
    rows.sort(key=lambda r: (r["turn"], r["lang"], bytes(r["buckets"])))
    return [(r["lang"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["shares"], "<f4").astype(float)) for r in rows]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression by FTRL-Proximal, one learning rate per weight."""

    def __init__(self, classes: int, fit: Fit):
        self.fit = fit
        self.z = np.zeros((BUCKETS, classes))
        self.n = np.zeros((BUCKETS, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, f = self.z[at], self.fit
        w = -(z - np.sign(z) * f.l1) / ((f.beta + np.sqrt(self.n[at])) / f.alpha + f.l2)
        return np.where(np.abs(z) > f.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.fit.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm.

    Targets are smoothed by one error in len(labels) + 2, so that a sample
    without errors doesn't end in certainty.
    """
    if not len(labels):
        return 1.0
    classes = logits.shape[1]
    target = np.full(logits.shape, 1 / (len(labels) + 2) / max(1, classes - 1))
    target[np.arange(len(labels)), labels] = 1 - 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((target * (np.log(np.exp(z).sum(axis=1, keepdims=True)) - z)).sum(axis=1).mean())

    a, b, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # classes x buckets: weight times IDF
    temperature: float

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every text, and how many letters it has."""
        orders, total, letters = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for c, row in enumerate(self.table):
            for h, bounds in orders:
                out[:, c] += sums(row[h], bounds)
        return out / np.maximum(total, 1)[:, None] / self.temperature, letters


def train(learn: DataFrame, fit: Fit) -> Model:
    """learn: rows (doc_id, text, lang) without nulls."""
    df, n = frequencies(learn)
    idf = np.log((1 + n) / (1 + df)) + 1
    # by hash and count first, so that the window sees little more than it keeps; counts has at most
    # fit.languages rows and is sent to the tasks lest all rows meet by language
    counts = common.written(learn.groupBy("lang").agg(F.count("*").alias("many")).orderBy(F.desc("many"), "lang").limit(fit.languages), "languages")
    per_language = max(1, min(fit.per_language, fit.documents // max(1, counts.count())))
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language + 50) / F.col("many"))
    some = learn.withColumn("turn", F.xxhash64("doc_id")).select("doc_id", "lang", "turn")
    some = some.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where((F.col("turn") / 2.0**64 + 0.5) <= F.col("share"))
    by_lang = Window.partitionBy("lang").orderBy("turn", "doc_id")
    some = some.withColumn("rank", F.row_number().over(by_lang)).where(F.col("rank") <= per_language)
    chosen = some.select(F.col("doc_id").alias("s_id"), "turn").distinct()
    rows = sample_features(learn.join(chosen, F.col("doc_id") == F.col("s_id")).select("text", "lang", "turn"))
    languages = sorted({r[0] for r in rows})
    label = {x: i for i, x in enumerate(languages)}
    ftrl = Ftrl(len(languages), fit)
    fitted = [r for i, r in enumerate(rows) if i % fit.held_back or len(rows) < 5 * fit.held_back]
    held = [r for i, r in enumerate(rows) if not i % fit.held_back]
    for _ in range(fit.epochs):
        for lang, at, share in fitted:
            ftrl.learn(at, share * idf[at], label[lang])
    w = ftrl.weights()
    logits = np.array([(share * idf[at]) @ w[at] for _, at, share in held]).reshape(len(held), len(languages))
    t = temperature(logits, np.array([label[r[0]] for r in held], int))
    return Model(languages, np.ascontiguousarray((w * idf[:, None]).T.astype(np.float32)), t)


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def learning_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 3 <> 1")


def with_language(docs: DataFrame, extra: list[str] | None = None, fit: Fit | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; extra columns pass through."""
    model = train(learning_rows(docs), fit or Fit())
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"), F.struct(*[docs[f"`{c}`"] for c in extra or []], *([] if extra else [F.lit(0).alias("_")])).alias("row"))

    def run(batches):
        for batch in kernels.text_batches(batches, 2 << 20):
            texts = batch.column(2)
            if model.languages:
                logits, letters = model.logits(texts)
                p, best = softmax(logits), logits.argmax(axis=1)
                known = (letters > 0) & texts.is_valid().to_numpy(zero_copy_only=False)
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, p[np.arange(len(best)), best], 0.0)
            else:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), texts, batch.column(3)], names=["doc_id", "held_out", "lang_pred", "score", "text", "row"])

    return common.mapped(rows, run, f"{PREDICTED}, text string, row {rows.schema['row'].dataType.simpleString()}")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return with_language(common.read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
