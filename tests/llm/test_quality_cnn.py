"""The network's gradient, its accuracy on held-out rows and the edges of its input."""

import zlib

import numpy as np
import pytest

from civitext.llm import quality_cnn as qc


def arrays(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (5, 300, 900, 0)]
    target = np.array([1, 0, 1, 0], np.float32)
    net = {k: v.astype(np.float64) for k, v in qc._new(rng).items()}
    net["out"] *= 5
    rows, first = qc._halves(*arrays(texts))
    slope = qc._gradient(net, rows, first, target)

    def loss():
        p = qc._sigmoid(qc._features(net, rows, first)[0].astype(np.float64) @ net["out"] + net["offset"])
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    for name, at in [("out", 3), ("offset", 0), ("bias", 2), ("filters", (5, 2)), ("filters", (40, 7)), ("embedding", (texts[1][0], 1)), ("out", 40)]:
        before = net[name][at]
        step = 1e-2
        net[name][at] = before + step
        up = loss()
        net[name][at] = before - step
        down = loss()
        net[name][at] = before
        assert slope[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3, rel=0.15), (name, at)


def test_score_does_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 255, 256, 257, 70000, 513)]
    net = qc._new(rng)
    alone = [qc.score(net, *arrays([t]))[0] for t in texts]
    assert np.allclose(qc.score(net, *arrays(texts)), alone, atol=1e-6)


def test_held_out_accuracy_and_coverage(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in qc.op5_quality_classifier(spark, sf_dir).collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    known = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    test = [(r.score, r.predicted, q) for r, q in known if r.held_out]
    assert np.mean([p == q for _, p, q in test]) >= 0.93
    good, bad = [s for s, _, q in test if q == 1], [s for s, _, q in test if q == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.9


def test_nulls_repeats_other_columns_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "long text " * 100000, 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(None, 1, 0), (7, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    net = qc.train(docs, labels)
    out = qc.score_quality(docs, net, keep_text=True)
    assert out.count() == 4 and {r.score for r in out.collect()} == {0.5}
    assert qc.score_quality(docs.limit(0), net).count() == 0
