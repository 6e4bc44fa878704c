"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Learned filters slide over the byte embeddings of the whole text. Their largest
values are taken over chunks of ``2 * HALF`` bytes that overlap by half; the
largest and the mean over all chunks feed one logistic output. The network is
fitted on a bounded sample of labelled rows and sent to the tasks (a few KB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm import text_arrays as ta

#: Labelled rows of the fit, and the longest text (bytes) that it takes.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 15
WIDTH, STRIDE, EMBEDDING, FILTERS, HALF = 8, 2, 8, 32, 256
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, SEED = 12, 16, 0.01, 7
#: Halves whose filters are computed at once.
_AT_ONCE = 128


def _halves(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows of ``HALF`` plus the overlap of the filters, zero after each text's end; each text's first row."""
    n = np.maximum((np.diff(bounds) + HALF - 1) // HALF, 1)
    first = np.concatenate(([0], np.cumsum(n)))
    flat = np.zeros(first[-1] * HALF + WIDTH, np.uint8)
    place = np.repeat(first[:-1] * HALF - bounds[:-1], np.diff(bounds))
    place += np.arange(len(data))
    flat[place] = data
    rows = np.lib.stride_tricks.as_strided(flat, (first[-1], HALF + WIDTH - STRIDE), (HALF, 1)).copy()
    rows[first[1:] - 1, HALF:] = 0  # nothing of the next text
    return rows, first


def _new(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = {"embedding": (256, EMBEDDING), "filters": (WIDTH * EMBEDDING, FILTERS), "bias": (FILTERS,), "out": (2 * FILTERS,), "offset": (1,)}
    scale = {"embedding": 1.0, "filters": (WIDTH * EMBEDDING) ** -0.5, "out": 0.1}
    return {k: (rng.normal(size=s) * scale.get(k, 0)).astype(np.float32) for k, s in size.items()}


def _patches(net: dict, rows: np.ndarray) -> np.ndarray:
    """All filter inputs of some halves: (halves, places, WIDTH * EMBEDDING)."""
    values = net["embedding"][rows].reshape(len(rows), -1)
    step = values.itemsize
    return np.lib.stride_tricks.as_strided(values, (len(rows), HALF // STRIDE, WIDTH * EMBEDDING), (values.strides[0], STRIDE * EMBEDDING * step, step))


def _features(net: dict, rows: np.ndarray, first: np.ndarray, places: bool = False):
    peak = np.empty((len(rows), FILTERS), np.float32)
    place = np.empty((len(rows), FILTERS), np.int64) if places else None
    for at in range(0, len(rows), _AT_ONCE):
        patches = _patches(net, rows[at : at + _AT_ONCE])
        values = (patches.reshape(-1, WIDTH * EMBEDDING) @ net["filters"]).reshape(len(patches), -1, FILTERS)
        if places:
            place[at : at + _AT_ONCE] = values.argmax(1)
        peak[at : at + _AT_ONCE] = values.max(1)
    peak += net["bias"]
    n = np.diff(first)
    # chunk i covers halves i and i + 1; a text of one half has one chunk
    pair = np.minimum(np.arange(len(rows)) + 1, np.repeat(first[1:] - 1, n))
    second = peak[pair] > peak
    chunk = np.where(second, peak[pair], peak)
    chunks = np.maximum(n - 1, 1)
    used = np.ones(len(rows), bool)
    used[(first[1:] - 1)[n > 1]] = False
    active = np.maximum(chunk, 0)
    top = np.maximum.reduceat(active, first[:-1], axis=0)
    mean = np.add.reduceat(active * used[:, None], first[:-1], axis=0) / chunks[:, None]
    return np.concatenate([top, mean], 1), (chunk, pair, second, used, chunks, place)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(net: dict, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text."""
    if len(bounds) < 2:
        return np.zeros(0)
    rows, first = _halves(data, bounds)
    return _sigmoid(_features(net, rows, first)[0].astype(np.float64) @ net["out"].astype(np.float64) + float(net["offset"][0]))


def _gradient(net: dict, rows: np.ndarray, first: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    features, (chunk, pair, second, used, chunks, place) = _features(net, rows, first, True)
    error = ((_sigmoid(features @ net["out"] + net["offset"]) - target) / len(target)).astype(np.float32)
    owner = np.repeat(np.arange(len(target)), np.diff(first))
    back = error[:, None] * net["out"]
    is_top = (np.maximum(chunk, 0) == features[owner, :FILTERS]) & used[:, None]
    share = np.add.reduceat(is_top.astype(np.float32), first[:-1], axis=0)
    d = is_top * (back[:, :FILTERS] / np.maximum(share, 1))[owner] + used[:, None] * (back[:, FILTERS:] / chunks[:, None])[owner]
    d *= chunk > 0
    peak = np.where(second, 0, d)
    np.add.at(peak, pair, np.where(second, d, 0))
    out = {k: np.zeros_like(v) for k, v in net.items()}
    out["out"], out["offset"], out["bias"] = error @ features, error.sum(keepdims=True), peak.sum(0)
    filt, half = np.nonzero(peak.T)
    at = place[half, filt][:, None] * STRIDE + np.arange(WIDTH)
    used_bytes, weight = rows[half[:, None], at], peak[half, filt]
    if len(half):
        inputs = net["embedding"][used_bytes].reshape(len(half), -1) * weight[:, None]
        own, start = np.unique(filt, return_index=True)
        out["filters"][:, own] = np.add.reduceat(inputs, start, axis=0).T
        back = (net["filters"].T[filt] * weight[:, None]).reshape(-1, EMBEDDING)
        out["embedding"] = np.stack([np.bincount(used_bytes.ravel(), back[:, k], 256) for k in range(EMBEDDING)], 1).astype(np.float32)
    return out


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Adam on the log loss, in seeded order; without texts a network that scores one half."""
    rng = np.random.default_rng(seed)
    net = _new(rng)
    if not texts:
        return net | {"out": np.zeros_like(net["out"])}
    share = np.clip(labels.mean(), 0.01, 0.99)
    net["offset"][:] = np.log(share / (1 - share))
    net["bias"] += 0.1
    mean, square, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            own = [texts[i] for i in part]
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in own])))
            rows, first = _halves(np.frombuffer(b"".join(own), np.uint8), bounds)
            step += 1
            rate = RATE * min(1, step / 20) * (1 - epoch / epochs) ** 0.5 / (1 - 0.9**step) * (1 - 0.999**step) ** 0.5
            for k, g in _gradient(net, rows, first, labels[part]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                net[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id=None):
    """One fifth of the documents, by the CRC of the id as text; a null id is not held out."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray]:
    """Fits on at most ``sample`` labelled documents that are not held out, picked by a hash of the id.

    Texts over ``sample_bytes`` are left out of the fit (not of the scores), so
    at most ``sample * sample_bytes`` bytes reach the driver. Rows with a null
    id, label or text teach nothing; of ids with several labels one is used.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # twice the sample, as some labels have no document or too long a text
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    fits = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).filter(F.octet_length("text") <= sample_bytes)
    rows = fits.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    return fit([bytes(r.text) for r in rows], np.array([r.quality for r in rows], np.float32))


def _scorer(net: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.slices(batches, "text"):
            yield batch.append_column("score", pa.array(score(net, *ta.utf8(batch.column("text")))))

    return run


def score_quality(docs: DataFrame, net: dict[str, np.ndarray], keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on).

    Reads nothing but ``text``; a null or empty one gets the score of a text of
    zero bytes. Rows stay as they are, repeated ones included; columns named
    ``score`` or ``predicted`` are replaced. One scan without a shuffle.
    """
    docs = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    schema = docs.withColumn("score", F.lit(0.0)).schema
    scored = docs.mapInArrow(_scorer(net), schema)
    scored = scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    return scored if keep_text else scored.drop("text")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
