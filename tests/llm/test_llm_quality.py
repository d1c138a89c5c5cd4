"""The byte network against a plain convolution, numeric gradients and held-out labels."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mizan.llm import byte_network as net
from mizan.llm import kernels

SMALL = net.Fit(per_label=200, filters=6, vector=3, batch=8, steps=60)


def plain_scores(network, texts):
    """Windows, chunks and texts one after the other."""
    out = []
    for t in texts:
        raw = (t or "").encode()
        data = np.frombuffer(raw + bytes(net.WIDTH), np.uint8)
        r = np.array([np.einsum("jd,jdk->k", network.E[data[i : i + net.WIDTH]], network.W) + network.b for i in range(len(raw))]).reshape(len(raw), len(network.b))
        blocks = [np.maximum(r[a : a + net.BLOCK].max(axis=0), 0) for a in range(0, len(raw), net.BLOCK)]
        chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:], strict=False)] or blocks
        k = len(network.b)
        x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) if chunks else np.zeros(2 * k)
        out.append(1 / (1 + np.exp(-(np.append(x, np.log1p(len(raw)) / 10) @ network.v + network.c[0]))))
    return np.array(out)


TEXTS = ["", None, "a", "é" * 3, "x" * 250, "ab " * 84, "q" * 252, "w" * 256, "pé" * 171, "lang " * 400, "\0\0", "z" * 251 + "y" * 300]


def test_scores_are_those_of_a_plain_convolution():
    network = net.Network(SMALL)
    network.b[:] = np.linspace(-1, 1, 6)
    got = network.scores(pa.array(TEXTS, pa.string()), network.pairs())
    assert got == pytest.approx(plain_scores(network, TEXTS), abs=1e-5)
    for i, t in enumerate(TEXTS):  # whatever stands beside a text
        assert network.scores(pa.array([t], pa.string()), network.pairs())[0] == pytest.approx(got[i], abs=1e-6)


def test_gradients_are_numeric_ones():
    network = net.Network(SMALL, seed=9)
    for p in network.parameters():
        p += np.random.default_rng(1).normal(0, 0.1, p.shape).astype(np.float32)
    texts = ["hello there", "x" * 600, "", "abc " * 200, "é"]
    y, w = np.array([1, 0, 1, 0, 1], np.float32), np.array([1, 2, 1, 0.5, 1], np.float32)
    blocks = net.Blocks(*kernels.text_bytes(pa.array(texts, pa.string())))

    def loss():
        s = plain_scores(network, texts)
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    rng = np.random.default_rng(2)
    for p, g in zip(network.parameters(), network.gradients(blocks, y, w), strict=True):
        for i in rng.choice(p.size, min(p.size, 12), replace=False):
            at = np.unravel_index(i, p.shape)
            if p is network.E:
                at = (ord("helox"[i % 5]), i % 3)
            old = p[at]
            p[at] = old + 4e-3
            up = loss()
            p[at] = old - 4e-3
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 8e-3, abs=3e-3)


def test_chunks_cover_the_text():
    for n in (1, 255, 256, 257, 600, 5000):
        blocks = net.Blocks(*kernels.text_bytes(pa.array(["y" * n, "", "z" * 10], pa.string())))
        a, b, text = blocks.chunks()
        assert blocks.windows.sum() == n + 10
        assert set(a[text == 0]) | set(b[text == 0]) == set(range(-(-n // net.BLOCK))) and not (text == 1).any()
        assert all(a[text == 0][1:] == b[text == 0][:-1])  # neighbours share a block


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = label == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    out = net.op12_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out} == {True}
    score, label = np.array([r.score for r in held]), np.array([r.quality for r in held])
    assert auc(score, label) > 0.97
    assert np.mean([(r.predicted == 1) == (r.quality == 1) for r in held]) > 0.93 and all(r.predicted == (r.score >= 0.3) for r in out)
    assert spark.read.parquet(f"{folder}/documents.parquet").count() == net.op12_quality_classifier(spark, folder).count()


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, row string, l_id string, quality string")


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, ("good words here " if i % 2 else "$$$ ### %%% ") * (1 + i % 7), None, None, None) for i in range(120)]
    rows += [(None, "x", "r", "l", "q"), (5, None, None, None, None), (5, "", None, None, None), (999, "long " * 60_000, None, None, None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    schema = "doc_id long, quality int, toxic int, text string"
    labels = [(i, i % 2, 0, None) for i in range(120)] + [(None, 1, 0, None), (999, 0, 0, None), (7, None, 1, None), (9, 5, 0, None), (4000, 0, 0, None)]
    d = table(spark, rows)
    first = net.with_quality(d, spark.createDataFrame(labels, schema), SMALL).collect()
    other = [(i, 1 - q if i is not None and q in (0, 1) and held(i) else q, t, x) for i, q, t, x in labels] + [(1, 1, 0, None)] * 3
    second = net.with_quality(d, spark.createDataFrame(other, schema), SMALL).collect()
    assert sorted(map(str, first)) == sorted(map(str, second)) and len(first) == len(rows)
    assert all(0 <= r.score <= 1 for r in first) and not [r for r in first if r.doc_id is None and r.held_out]
    by = {r.doc_id: r.score for r in first}
    assert np.mean([(by[i] >= 0.5) == (i % 2 == 1) for i in range(120) if held(i)]) > 0.9


def test_quality_without_labels_of_both_kinds(spark):
    d = table(spark, [(1, "a", None, None, None), (2, None, None, None, None)])
    schema = "doc_id long, quality int, toxic int"
    score = lambda labels: {r.score for r in net.with_quality(d, spark.createDataFrame(labels, schema)).collect()}
    assert score([]) == {0.5} and score([(1, 1, 0)]) == {1.0} and score([(1, 0, 0), (2, 0, 0)]) == {0.0}
    assert net.with_quality(d.limit(0), spark.createDataFrame([], schema)).collect() == []


def test_the_sample_is_bounded(spark):
    d = table(spark, [(i, "text", None, None, None) for i in range(3000)] + [(5000, "y" * 20_000, None, None, None)])
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    texts, y, w = net.sample(d, labels, net.Fit(per_label=50))
    assert len(texts) == len(y) == 100 and y.sum() == 50
    assert (w[y == 0].sum() / w.sum()) == pytest.approx(2 / 3, abs=0.03)
