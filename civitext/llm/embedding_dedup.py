"""Near-duplicate embeddings through rotated binary codes with correction factors.

A vector ``o`` of length 1 is turned by a seeded random rotation and kept as the
signs ``x`` of its coordinates and the factor ``f = <x, o> / sqrt(d)``. For
another vector ``q``, ``<x, q> / (f sqrt(d))`` estimates ``<o, q>`` without bias.
What ``q`` has across ``o`` is at most ``sqrt(1 - t^2)`` long if the pair's cosine
is at least ``t``, so for such a pair the estimate is never more than
``sqrt(1 - t^2) sqrt(1 - f^2) / f`` below ``t``: this bound drops pairs and loses
none. Pairs within it are computed again from the original vectors. Codes (one
bit for each coordinate) and factors are made once for each vector and stored; a
task turns the vectors of one of its two blocks, once each, and gets the estimates of
all pairs as one product of matrices.

Signs of further rotations make band keys: pairs at the threshold share a band
with all but ``MISS`` probability. A pair belongs to the first band that both
share, so it is counted once without gathering pairs. Large buckets are cut into
blocks, one task for each pair of blocks, that send counts and a spanning forest
of links, never the pairs. Equal vectors are one vector with a multiplicity.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm.components import components
from civitext.session import materialise

THRESHOLD = 0.98
MISS = 1e-9
#: Vectors in a block of a bucket, on average.
BLOCK = 512
SEED = 11


@cache
def rotation(dimension: int, number: int) -> np.ndarray:
    """A seeded random rotation."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dimension, number)).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def banding(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band key, growing with the logarithm of the vectors, and the bands that then miss few pairs."""
    bits = int(min(28, max(8, math.ceil(math.log2(max(vectors, 2))))))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log(1 - agree**bits))


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """``bands`` keys for each row: ``bits`` signs of coordinates under further rotations."""
    d = unit.shape[1]
    need = bits * bands
    signs = np.concatenate([unit @ rotation(d, 1 + k).T >= 0 for k in range(-(-need // d))], axis=1)[:, :need]
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs.reshape(len(unit), bands, bits) @ weights


def _keys(bits: int, bands: int):
    schema = pa.schema([("rep", pa.int64()), ("keys", pa.list_(pa.int64())), ("code", pa.binary()), ("factor", pa.float64())])

    def run(batches):
        for batch in batches:
            reps, vectors = batch.column("rep").to_numpy(), batch.column("embedding").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                for part in np.array_split(own, max(1, len(own) // 1024)):
                    x = np.array([vectors[i] for i in part], np.float64)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    keys = band_keys(unit, bits, bands)
                    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
                    packed, factor = encode(unit)
                    yield pa.RecordBatch.from_arrays([pa.array(reps[part]), lists, pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(factor)], schema=schema)

    return run


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed signs of each turned vector of length 1, and its correction factor."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def decode(packed: np.ndarray, d: int) -> np.ndarray:
    """Codes of length 1 from packed signs."""
    return (np.unpackbits(packed, axis=1, count=d) * 2.0 - 1) / math.sqrt(d)


def possible_pairs(codes: np.ndarray, factor: np.ndarray, turned: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a coded and a turned vector whose estimate does not rule out a cosine of ``threshold``."""
    slack = math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor
    return np.nonzero(codes @ turned.T >= (factor * (threshold - slack - 1e-9))[:, None])


def linked_pairs(vectors: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have a cosine of at least ``threshold``, computed from the vectors."""
    norms = np.sqrt((vectors * vectors).sum(1))
    a, b = pairs.T
    return (vectors[a] * vectors[b]).sum(1) / (norms[a] * norms[b]) >= threshold


def _compare(threshold: float):
    """Links between the two blocks of one bucket: counts for each vector, and a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        band, low, high = (key[k].as_py() for k in (0, 2, 3))
        reps, copies, block, factor = (rows.column(c).to_numpy() for c in ("rep", "copies", "block", "factor"))
        matrix = lambda c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(reps), -1)
        vectors = matrix("embedding")
        packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(reps), -1)
        d = vectors.shape[1]
        first, second = (np.flatnonzero(block == b) for b in (low, high))
        own = vectors[first]
        turned = (own / np.sqrt((own * own).sum(1))[:, None]) @ rotation(d, 0).T
        j, i = possible_pairs(decode(packed[second], d), factor[second], turned, threshold)
        pairs = np.stack([first[i], second[j]], 1)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) if low == high else slice(None)]
        if not len(pairs):  # most buckets
            return schema.empty_table()
        keys, linked = matrix("keys"), []
        for part in np.array_split(pairs, max(1, len(pairs) // 65536)):
            part = part[~(keys[part[:, 0], :band] == keys[part[:, 1], :band]).any(1)]  # not met in an earlier band
            linked.append(part[linked_pairs(vectors, part, threshold)])
        a, b = np.concatenate(linked).T
        count = np.bincount(a, copies[b], len(reps)).astype(np.int64) + np.bincount(b, copies[a], len(reps)).astype(np.int64)
        root, links = list(range(len(reps))), []

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for x, y in zip(a.tolist(), b.tolist()):
            x_top, y_top = top(x), top(y)
            if x_top != y_top:
                root[max(x_top, y_top)] = min(x_top, y_top)
                links.append((reps[x], reps[y]))
        counted = np.flatnonzero(count)
        ends = [np.concatenate([reps[counted], np.array([link[k] for link in links], np.int64)]) for k in (0, 1)]
        return pa.table([*ends, np.concatenate([count[counted], np.zeros(len(links), np.int64)])], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding, label``.

    Vectors are compared if their labels are equal and not null and they have
    as many components. Null or zero vectors, those with null or non-finite
    components and those without an id link with nothing and are kept (a null
    id stays null). Rows with equal ids count as one vertex of the components,
    but each as a link of the others. Other columns are not used; an empty
    table gives an empty result.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    rows = vectors.select("vec_id", F.col("label").alias("label"), double.alias("vector"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    valid = rows.filter(F.coalesce(usable, F.lit(False)))
    alike = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # a representative is known by its smallest id; equal ids with unequal vectors would clash
    alike = alike.withColumn("rep_key", F.xxhash64("label", "vector", "rep"))
    reps = materialise(alike.withColumnRenamed("vector", "embedding"), "vectors")
    bits, bands = banding(reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1, threshold, miss)
    keyed = reps.select(F.col("rep_key").alias("rep"), "embedding").mapInArrow(_keys(bits, bands), "rep long, keys array<long>, code binary, factor double")
    keyed = materialise(keyed, "vector-bands")
    placed = reps.select(F.col("rep_key").alias("rep"), "label", F.size("embedding").alias("d")).join(keyed.select("rep", "keys"), "rep")
    banded = placed.select("rep", F.posexplode("keys").alias("band", "code"), "label", "d")
    bucket = F.xxhash64("band", "code", "label", "d").alias("bucket")
    buckets = banded.groupBy("band", bucket).agg(F.count("*").alias("n")).filter("n > 1")
    members = banded.select("rep", "band", bucket).join(buckets, ["band", "bucket"])
    blocks = F.ceil(F.col("n") / block)
    members = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep"), blocks)})
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("rep", "band", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = members.join(reps.select(F.col("rep_key").alias("rep"), "embedding", "copies"), "rep").join(keyed, "rep")
    met = full.groupBy("band", "bucket", "low", "high").applyInArrow(_compare(threshold), "a long, b long, n long")
    met = materialise(met, "vector-links")
    counts = met.filter("a = b").groupBy(F.col("a").alias("rep_key")).agg(F.sum("n").alias("linked"))
    ids = reps.select("rep_key", "rep")
    named = met.filter("a <> b").join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same_id = valid.join(reps.select("label", F.col("embedding").alias("vector"), "rep"), ["label", "vector"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    found = components(named.union(same_id))
    linked = reps.join(counts, "rep_key", "left").select("label", F.col("embedding").alias("vector"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    with_links = valid.join(linked, ["label", "vector"]).select("vec_id", "n_links")
    rest = rows.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    result = with_links.union(rest).join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
