"""Quality scores by a byte-level convolutional network in numpy (operator 12).

Every byte of a text's UTF-8 has a learned vector; learned filters run over
each `WIDTH` bytes in a row. Their responses are max-pooled over chunks of two
blocks of `BLOCK` bytes that overlap by one, which cover the whole text; the
mean and the maximum of the chunks, with the logarithm of the length, are
combined into one probability by a logistic layer.

The network is trained on the driver by Adam on a bounded sample (see Fit) of
the documents that have a label and aren't held out; the counts that weight the
labels come from all of them. Scoring runs in the tasks, block after block, so
that a text of any length takes a bounded multiple of its bytes.

Defined results: null texts are empty; empty texts have no chunk, and their
score is that of the last layer alone; rows with a null doc_id are scored, not
held out and not learnt from; a doc_id of which labels disagree counts as 1,
null labels and those other than 0 and 1 not at all; with labels of one kind
only, or none, every score is their share (0.5 of none); repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mizan.llm import common, kernels

BLOCK = 256
WIDTH = 6
#: Blocks that are computed together.
RUN = 512


@dataclass(frozen=True)
class Fit:
    """Parameters of the training."""

    per_label: int = 2000  # documents learnt from, those with the smallest hash of their id
    longest: int = 1 << 14  # and at most so many bytes long
    filters: int = 32
    vector: int = 8
    batch: int = 24
    steps: int = 500
    rate: float = 0.01
    decay: float = 1e-4


class Blocks:
    """Texts as one array of bytes, each from a new block on and followed by WIDTH - 1 zeros at least."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.lengths = np.diff(offsets)
        self.n = -(-self.lengths // BLOCK)  # blocks of each text
        held = -(-(self.lengths + WIDTH - 1) // BLOCK) * (self.lengths > 0)
        self.first = np.cumsum(held) - held
        self.data = np.zeros(int(held.sum()) * BLOCK + WIDTH, np.uint8)
        place = np.repeat(self.first * BLOCK - offsets[:-1], self.lengths)
        self.data[place + np.arange(len(buf))] = buf
        #: windows of each block that begin in its text; the last block of some has none
        owner = np.repeat(np.arange(len(held)), held)
        at = np.arange(len(owner)) - self.first[owner]
        self.windows = np.clip(self.lengths[owner] - at * BLOCK, 0, BLOCK)
        self.n_chunks = np.where(self.n > 0, np.maximum(1, self.n - 1), 0)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second block of each chunk, counted among used blocks, and the text of each chunk."""
        many = self.n_chunks
        text = np.repeat(np.arange(len(many)), many)
        first_used = np.cumsum(self.n) - self.n
        at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        a = first_used[text] + at
        return a, np.where(self.n[text] > 1, a + 1, a), text


def pooled(blocks: Blocks, pairs: list[np.ndarray], bias: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's largest response (0 at least) in every used block, and with `places` the window that has it."""
    best, where = [np.zeros((0, len(bias)), np.float32)], [np.zeros((0, len(bias)), np.int64)]
    for at in range(0, len(blocks.windows), RUN):
        windows = blocks.windows[at : at + RUN]
        n = len(windows) * BLOCK
        part = blocks.data[at * BLOCK : at * BLOCK + n + WIDTH].astype(np.uint16)
        two = (part[:-1] << np.uint16(8)) | part[1:]
        out = pairs[0].take(two[:n], axis=0)
        for j in range(1, len(pairs)):
            out += pairs[j].take(two[2 * j : 2 * j + n], axis=0)
        out = out.reshape(len(windows), BLOCK, -1)
        for i in np.flatnonzero(windows < BLOCK):
            out[i, windows[i] :] = -np.inf
        if places:
            at_most = out.argmax(axis=1)
            where.append(at_most + (at + np.arange(len(windows)))[:, None] * BLOCK)
            best.append(np.take_along_axis(out, at_most[:, None], axis=1)[:, 0])
        else:
            half = BLOCK
            while half > 1:
                half //= 2
                np.maximum(out[:, :half], out[:, half : 2 * half], out=out[:, :half])
            best.append(out[:, 0].copy())
    found = np.maximum(np.concatenate(best)[blocks.windows > 0] + bias, 0)
    return found, np.concatenate(where)[blocks.windows > 0] if places else None


class Network:
    """Byte vectors E, filters W (WIDTH, vector, filters) and b, last layer v (mean, maximum, length) and c."""

    def __init__(self, fit: Fit, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.5, (256, fit.vector)).astype(np.float32)
        self.W = rng.normal(0, (2 / (WIDTH * fit.vector)) ** 0.5, (WIDTH, fit.vector, fit.filters)).astype(np.float32)
        self.b = np.zeros(fit.filters, np.float32)
        self.v = rng.normal(0, 0.05, 2 * fit.filters + 1).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.E, self.W, self.b, self.v, self.c]

    def pairs(self) -> list[np.ndarray]:
        """For each two neighbouring places of the filters: their responses to every two bytes."""
        single = np.einsum("ed,jdk->jek", self.E, self.W)
        return [np.ascontiguousarray((single[j][:, None] + single[j + 1][None]).reshape(1 << 16, -1), np.float32) for j in range(0, WIDTH, 2)]

    def combined(self, blocks: Blocks, best: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Mean, maximum and length of every text, from its blocks; and what the gradients need."""
        a, b, text = blocks.chunks()
        second = best[b] > best[a]
        chunk, k = np.where(second, best[b], best[a]), best.shape[1]
        x = np.zeros((len(blocks.n), 2 * k + 1), np.float32)
        x[:, -1] = np.log1p(blocks.lengths) / 10
        some = np.flatnonzero(blocks.n > 0)
        if len(some):
            starts = np.searchsorted(text, some)
            x[some, :k] = np.add.reduceat(chunk, starts, axis=0) / blocks.n_chunks[some, None]
            x[some, k : 2 * k] = np.maximum.reduceat(chunk, starts, axis=0)
        return x, (a, b, text, second, chunk)

    def scores(self, texts: pa.Array, pairs: list[np.ndarray]) -> np.ndarray:
        blocks = Blocks(*kernels.text_bytes(texts))
        x, _ = self.combined(blocks, pooled(blocks, pairs, self.b)[0])
        return 1 / (1 + np.exp(-(x @ self.v + self.c).astype(float)))

    def gradients(self, blocks: Blocks, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of the mean weighted log loss, in the order of parameters()."""
        best, place = pooled(blocks, self.pairs(), self.b, places=True)
        x, (a, b, text, second, chunk) = self.combined(blocks, best)
        g = (weights * (1 / (1 + np.exp(-(x @ self.v + self.c))) - labels) / len(labels)).astype(np.float32)
        k = len(self.b)
        # back to the chunks: the mean reaches all of a text's, the maximum those that have it in equal parts
        top = (chunk == x[text, k : 2 * k]).astype(np.float32)
        many = np.ones((len(blocks.n), k), np.float32)
        if len(text):
            some = np.flatnonzero(blocks.n > 0)
            many[some] = np.add.reduceat(top, np.searchsorted(text, some), axis=0)
        d = g[text, None] * (self.v[:k] / blocks.n_chunks[text, None] + top / many[text] * self.v[k : 2 * k])
        to_blocks = np.zeros_like(best)
        np.add.at(to_blocks, a, np.where(second, 0, d))
        np.add.at(to_blocks, b, np.where(second, d, 0))
        to_blocks *= best > 0
        held = blocks.data[place[..., None] + np.arange(WIDTH)]
        dW = np.einsum("nk,nkjd->jdk", to_blocks, self.E[held])
        dE = np.zeros_like(self.E)
        np.add.at(dE, held.ravel(), (to_blocks[..., None, None] * self.W.transpose(2, 0, 1)).reshape(-1, self.E.shape[1]))
        return [dE, dW, to_blocks.sum(axis=0), g @ x, g.sum(keepdims=True)]


def trained(texts: list[str], labels: np.ndarray, weights: np.ndarray, fit: Fit) -> Network:
    """Fitted by Adam, its rate falling to nothing; the same sample gives the same network."""
    net, rng = Network(fit), np.random.default_rng(7)
    share = float((labels * weights).sum() / weights.sum())
    net.c[:] = np.log(share / (1 - share))
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    order = np.zeros(0, int)
    for step in range(1, fit.steps + 1):
        if len(order) < fit.batch:
            order = np.append(order, rng.permutation(len(texts)))
        some, order = order[: fit.batch], order[fit.batch :]
        blocks = Blocks(*kernels.text_bytes(pa.array([texts[i] for i in some], pa.string())))
        rate = fit.rate * (1 - (step - 1) / fit.steps) * min(1, step / 20)
        for p, g, m, v in zip(net.parameters(), net.gradients(blocks, labels[some], weights[some]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + fit.decay * p)
    return net


def sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights to learn from; weights restore the labels' shares among all that may be learnt from."""
    own = labels.select(labels["doc_id"].cast("long").alias("l_id"), labels["quality"].cast("int").alias("quality")).where("l_id IS NOT NULL AND quality IN (0, 1)")
    own = own.where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("quality").alias("quality"))
    own = common.written(own, "quality-labels")
    rows = docs.select(docs["doc_id"].cast("long").alias("l_id"), docs["text"].cast("string").alias("text")).where("l_id IS NOT NULL")
    ids = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= fit.longest).select("l_id").distinct()
    counts = {r[0]: r[1] for r in own.groupBy("quality").count().collect()}  # two rows
    turn = F.xxhash64("l_id")
    # by their hash first, so that the window sees little more than it keeps
    share = F.least(F.lit(1.0), F.lit(2.0 * fit.per_label + 100) / F.when(F.col("quality") == 1, counts.get(1, 1)).otherwise(counts.get(0, 1)))
    some = own.withColumn("turn", turn).where(F.col("turn") / 2.0**64 + 0.5 <= share).join(ids, "l_id")
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("quality").orderBy("turn", "l_id"))).where(F.col("rank") <= fit.per_label)
    found = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= fit.longest).join(F.broadcast(some.select("l_id", "quality", "turn")), "l_id")  # 2 * per_label rows
    found = found.groupBy("l_id", "turn", "quality").agg(F.min("text").alias("text")).orderBy("turn", "l_id").collect()
    y = np.array([r["quality"] for r in found], np.float32)
    taken = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    weights = np.array([counts[r["quality"]] / taken[r["quality"]] for r in found], np.float32)
    return [r["text"] or "" for r in found], y, weights / weights.mean() if len(weights) else weights


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


SCORED = "doc_id long, held_out boolean, score double"


def with_quality(docs: DataFrame, labels: DataFrame, fit: Fit | None = None) -> DataFrame:
    """doc_id, held_out and score of every row."""
    fit = fit or Fit()
    texts, y, weights = sample(docs, labels, fit)
    share = float((y * weights).sum() / weights.sum()) if len(y) else 0.5
    net = trained(texts, y, weights, fit) if len(y) and 0 < share < 1 else None
    parts = [p.tobytes() for p in net.parameters()] if net else None
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"].cast("long")).alias("held_out"), docs["text"].cast("string").alias("text"))

    def run(batches):
        own, pairs = None, None
        for batch in kernels.text_batches(batches, 1 << 20):
            if parts is None:
                score = np.full(batch.num_rows, share)
            else:
                if own is None:
                    own = Network(fit)
                    for p, data in zip(own.parameters(), parts, strict=True):
                        p[...] = np.frombuffer(data, np.float32).reshape(p.shape)
                    pairs = own.pairs()
                score = own.scores(batch.column(2), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    return common.mapped(rows, run, SCORED)


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    found = with_quality(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
