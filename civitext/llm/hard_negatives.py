"""Hard negatives from blocks of vectors along a Hilbert curve, chosen by interval bounds.

Vectors are rounded to whole numbers, ordered by length, label and their place
on a Hilbert curve through the ``CURVE`` components that vary most, and written
as Parquet blocks of one label. A block keeps the least and the largest value of
each component: its zone map. For an anchor ``a`` the products with a block lie
between the sums of ``min(a_j low_j, a_j high_j)`` and ``max(a_j low_j, a_j
high_j)``, so a block matters only if that interval meets one of the anchor's
score windows. The search runs twice:

1. positives: one open window above a score that the anchor's own block already
   reaches, over blocks of its label;
2. negatives: a window for each score of its positives, over blocks of other labels.

Each search first reads the zone maps alone and lists the blocks that each
anchor needs, then reads those blocks. The anchors are streamed past one group of
neighbouring blocks in each task, so a task holds one group and one batch of
anchors. While it reads a group, an anchor's windows close from below as better
candidates are found, and the bounds rule out further blocks. All bounds are
safe: results are exact. Where vectors show no structure, all blocks are needed
and the search is a product of matrices by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.session import materialise

EVERY, POSITIVES, NEGATIVES, SCALE = 50, 5, 3, 256
#: Rows of a block; rows of a group of blocks, least and most; anchors compared at once.
BLOCK, LEAST_GROUP, MOST_GROUP, AT_ONCE = 512, 4096, 1 << 17, 512
#: Components on the curve, and bits of each.
CURVE, BITS = 8, 7
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of whole numbers below ``2**bits`` on a Hilbert curve (Skilling's transposed form)."""
    x = cells.astype(np.int64).T.copy()
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for row in x:
            swap = np.where(row & q, 0, (x[0] ^ row) & (q - 1))
            x[0] ^= np.where(row & q, q - 1, swap)
            row ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(cells.shape[0], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, q - 1, 0) if len(x) else 0
    place = np.zeros(cells.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x ^ flip:
            place = place << 1 | row >> b & 1
    return place


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the lists in a column: their places, and their values as a matrix."""
    lengths = column.value_lengths().to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        own = column.take(pa.array(at))
        yield at, own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: rows that take part, with whole components of ``SCALE`` times the original."""
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double") * SCALE).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL").filter(F.coalesce(finite, F.lit(False)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            floors = pa.array(np.floor(lists.flatten().to_numpy(zero_copy_only=False)), pa.float64())
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(ends, floors)], names=batch.schema.names)

    return rows.mapInArrow(whole, "vec_id long, label long, vector array<double>")


def _spans(rows: DataFrame) -> np.ndarray:
    """Component, least and largest value of the components of largest variance, at most ``CURVE`` of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _lists(batch.column("vector")):
                figures = [np.arange(x.shape[1]), np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0), x.min(0), x.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in figures], names=["at", "n", "s", "q", "low", "high"])

    parts = rows.mapInArrow(partial, "at long, n double, s double, q double, low double, high double").groupBy("at")
    totals = parts.agg(*(F.sum(c).alias(c) for c in "nsq"), F.min("low").alias("low"), F.max("high").alias("high"))
    widest = totals.orderBy(F.desc(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2), "at").limit(CURVE)
    return np.array([[r.at, r.low, r.high] for r in widest.collect()], np.float64).reshape(-1, 3)


def _placed(spans: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.zeros(batch.num_rows, np.int64)
            for at, x in _lists(batch.column("vector")):
                own = spans[spans[:, 0] < x.shape[1]]
                low, width = own[:, 1], np.maximum(own[:, 2] - own[:, 1], 1)
                cells = (x[:, own[:, 0].astype(int)] - low) / width * ((1 << BITS) - 1)
                place[at] = hilbert(np.clip(np.nan_to_num(cells), 0, (1 << BITS) - 1).astype(np.int64), BITS)
            yield batch.append_column("place", pa.array(place))

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as 64-bit integers, exactly; beyond 64 bits the nearest such integer."""
    most = max((np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(a.shape[1], 1), 1)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in b]
    return np.array([[min(max(sum(x * y for x, y in zip([int(v) for v in row], other)), _LOW + 1), _HIGH) for other in whole] for row in a], np.int64).reshape(len(a), len(b))


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest product that each anchor can have with a vector of each block, widened by what rounding can lose."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T) + 0.5
    least, most = up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack
    # sums that overflow bound nothing
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


_BLOCK = "group int, block long, d int, label long, ids binary, vectors binary, wide boolean, low array<double>, high array<double>, asks array<struct<anchor_id: long, least: long, vector: array<double>>>"


def _blocks(every: int, positives: int, size: int):
    """Rows of one partition, in order, as blocks of one length and label."""
    ask = pa.list_(pa.struct([("anchor_id", pa.int64()), ("least", pa.int64()), ("vector", pa.list_(pa.float64()))]))
    floats = pa.list_(pa.float64())
    names = [c.split()[0] for c in _BLOCK.split(", asks")[0].split(", ")] + ["asks"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), floats, floats, ask]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, made, held, key = TaskContext.get().partitionId(), 0, [], None

        def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            asks = []
            for i in np.flatnonzero(ids % every == 0):
                scores = np.sort(products(x[i : i + 1], x[ids != ids[i]])[0])
                asks.append({"anchor_id": ids[i], "least": scores[-positives] if len(scores) >= positives else _LOW, "vector": x[i]})
            wide = bool(np.abs(x).max(initial=0) >= 1 << 24)
            row = [group, (group << 32) + made, key[0], key[1], ids.astype("<i8").tobytes(), x.astype("<f8" if wide else "<f4").tobytes(), wide, x.min(0), x.max(0), asks]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            ids, x = (np.concatenate(c) for c in zip(*held))
            while len(ids) >= least and len(ids):
                yield block(ids[:size], x[:size])
                ids, x = ids[size:], x[size:]
            held = [(ids, x)] if len(ids) else []

        for batch in batches:
            ids, labels, lengths = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("vector").value_lengths().to_numpy()
            cuts = np.flatnonzero((np.diff(labels) != 0) | (np.diff(lengths) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a == b:
                    continue
                if key != (own := (int(lengths[a]), int(labels[a]))):
                    if held:
                        yield from flush(1)
                    key = own
                x = batch.column("vector").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, own[0])
                held.append((ids[a:b], x))
                if sum(len(i) for i, _ in held) >= size:
                    yield from flush(size)
        if held:
            yield from flush(1)

    return run


class _Anchors:
    """A batch of anchors: vectors of one length, and windows as arrays padded with empty ones."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.n = batch, batch.num_rows
        self.labels, self.ids = batch.column("label").to_numpy(), batch.column("anchor_id").to_numpy()
        d = batch.column("d")[0].as_py()
        self.x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(self.n, d)
        windows = batch.column("windows").to_pylist()
        w = max((len(x) for x in windows), default=0)
        self.low, self.high = np.full((self.n, w), _HIGH), np.full((self.n, w), _LOW)
        for i, own in enumerate(windows):
            for k, window in enumerate(own):
                self.low[i, k], self.high[i, k] = window["low"], window["high"]

    def meets(self, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> np.ndarray:
        """Which blocks each anchor needs: their label is right and their interval meets an open window."""
        least, most = bounds(self.x, low, high)
        out = np.zeros(least.shape, bool)
        for k in range(self.low.shape[1]):
            out |= (most >= self.low[:, k, None]) & (least <= self.high[:, k, None]) & (self.low[:, k] <= self.high[:, k])[:, None]
        return out & ((self.labels[:, None] == label[None, :]) == same)


def _by_group(take_block, take_anchors):
    """Streams each group's blocks, which come first, and then its anchors in batches of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks = None, []
        for batch in batches:
            groups, kinds = batch.column("group").to_numpy(), batch.column("kind").to_numpy()
            lengths = batch.column("d").to_numpy()
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0) | (np.diff(lengths) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if groups[a] != group:
                    group, blocks = groups[a], []
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    blocks += take_block(part)
                    continue
                own = [x for x in blocks if x["d"] == lengths[a]]
                for at in range(0, part.num_rows if own else 0, AT_ONCE):
                    yield from take_anchors(_Anchors(part.slice(at, AT_ONCE)), own)

    return run


_ASK = ["group", "key", "anchor_id", "label", "d", "vector", "windows"]
_ASK_TYPES = "group int, key long, anchor_id long, label long, d int, vector array<double>, windows array<struct<low: long, high: long>>"


def _choose(same: bool):
    """Anchors with the numbers of the blocks that they need; without any, an anchor is left out."""

    def zones(part: pa.RecordBatch) -> list[dict]:
        return [{**r, "low": np.array(r["low"], np.float64), "high": np.array(r["high"], np.float64)} for r in part.select(["block", "d", "label", "low", "high"]).to_pylist()]

    def choose(asks: _Anchors, blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        low, high = (np.stack([b[c] for b in blocks]) for c in ("low", "high"))
        needed = asks.meets(np.array([b["label"] for b in blocks]), low, high, same)
        number = np.array([b["block"] for b in blocks])
        at = np.flatnonzero(needed.any(1))
        if len(at):
            lists = pa.array([number[needed[i]] for i in at], pa.list_(pa.int64()))
            own = asks.batch.select(_ASK).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*_ASK, "blocks"])

    return _by_group(zones, choose)


def _scan(same: bool, k: int):
    """The best ``k`` rows of a group in each window of each anchor, from the blocks that it needs."""
    schema = pa.schema([("key", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def load(part: pa.RecordBatch) -> list[dict]:
        rows = part.select(["block", "d", "label", "ids", "vectors", "wide", "low", "high"]).to_pylist()
        return [{**r, "ids": np.frombuffer(r["ids"], "<i8"), "low": np.array(r["low"], np.float64), "high": np.array(r["high"], np.float64)} for r in rows]

    def search(asks: _Anchors, blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        listed = [set(x) for x in asks.batch.column("blocks").to_pylist()]
        most = bounds(asks.x, *(np.stack([b[c] for b in blocks]) for c in ("low", "high")))[1]
        for at in np.argsort(-most.max(0), kind="stable"):  # the most promising first
            b = blocks[at]
            wanted = np.array([b["block"] in x for x in listed])
            wanted &= asks.meets(np.array([b["label"]]), b["low"][None], b["high"][None], same)[:, 0]
            rows = np.flatnonzero(wanted)
            if not len(rows):
                continue
            x = np.frombuffer(b["vectors"], "<f8" if b["wide"] else "<f4").astype(np.float64).reshape(len(b["ids"]), b["d"])
            scores = products(asks.x[rows], x)
            other = asks.ids[rows, None] != b["ids"][None, :]
            for w in range(asks.low.shape[1]):
                inside = (scores >= asks.low[rows, w, None]) & (scores <= asks.high[rows, w, None]) & other
                for i in np.flatnonzero(inside.any(1)):
                    place = np.flatnonzero(inside[i])
                    ids, own = b["ids"][place], scores[i, place]
                    row = rows[i]
                    if (row, w) in best:
                        ids, own = np.concatenate([best[row, w][0], ids]), np.concatenate([best[row, w][1], own])
                    order = np.lexsort((ids, -own))[:k]
                    best[row, w] = ids[order], own[order]
                    if len(order) == k:  # ties may still come with smaller ids
                        asks.low[row, w] = own[order[-1]]
        if best:
            key = asks.batch.column("key").to_numpy()
            n = [len(ids) for ids, _ in best.values()]
            at = np.repeat(np.array(list(best), np.int64), n, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(key[at[:, 0]]), pa.array(at[:, 1].astype(np.int32)), pa.array(np.concatenate([v[0] for v in best.values()])), pa.array(np.concatenate([v[1] for v in best.values()]))], schema=schema)

    return _by_group(load, search)


def _search(blocks: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """``key, window, id, score, rank``: the first ``k`` rows in each window of each anchor."""
    groups = [r.group for r in blocks.select("group").distinct().collect()]  # one number for each partition of blocks
    spread = asks.withColumn("group", F.explode(F.lit(groups).cast("array<int>")))

    def streamed(of_blocks: DataFrame, of_asks: DataFrame) -> DataFrame:
        both = of_blocks.withColumn("kind", F.lit(0)).unionByName(of_asks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        return both.repartition("group").sortWithinPartitions("group", "kind", "d")

    zones = blocks.select("group", "block", "d", "label", "low", "high")
    chosen = materialise(streamed(zones, spread).mapInArrow(_choose(same), f"{_ASK_TYPES}, blocks array<long>"), "anchor-blocks")
    needed = chosen.select("group", F.explode("blocks").alias("block")).distinct()
    read = blocks.drop("asks").join(needed, ["group", "block"], "left_semi")
    found = streamed(read, chosen).mapInArrow(_scan(same, k), "key long, window int, id long, score long")
    best = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    return materialise(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "windows")


def _window(positive: Column) -> Column:
    """The whole numbers from 50 to 95 percent of a score that is not negative."""
    twentieth = F.call_function("div", positive, F.lit(20)) + F.when(positive % 20 > 0, 1).otherwise(0)
    return F.struct((positive - F.shiftright(positive, 1)).alias("low"), (positive - twentieth).alias("high"))


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, least_group: int = LEAST_GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, embedding, label``.

    Anchors are the rows whose id is divisible by ``every``. Rows without an id,
    label or vector and those with null or non-finite components (after scaling)
    take no part. Vectors are compared if they have as many components; one
    without components has the score 0 with its like. Rows with the anchor's id are
    not its candidates. Equal anchor rows are one anchor, unequal ones with one id are
    anchors each; repeated candidates are candidates each. Equal scores go by
    smaller id. A positive of negative score has no negatives. Scores are exact;
    beyond 64 bits they count as the nearest such integer. An empty table gives
    an empty result. Other columns are not used.
    """
    rows = usable(vectors)
    placed = materialise(rows.mapInArrow(_placed(_spans(rows)), "vec_id long, label long, vector array<double>, place long"), "vector-places")
    total = placed.count()
    parts = max(1, min(total // least_group, max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // MOST_GROUP)))
    order = [F.size("vector"), "label", "place", "vec_id"]
    blocks = materialise(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place").mapInArrow(_blocks(every, positives, block), _BLOCK), "vector-blocks")
    asks = blocks.select("d", "label", F.explode("asks").alias("ask")).select("d", "label", "ask.*")
    asks = asks.groupBy("d", "label", "anchor_id", "vector").agg(F.max("least").alias("least"))
    asks = materialise(asks.withColumn("key", F.xxhash64("anchor_id", "label", "vector")), "anchors")
    window = F.array(F.struct(F.col("least").alias("low"), F.lit(_HIGH).alias("high")))
    near = _search(blocks, asks.withColumn("windows", window).drop("least"), True, positives)
    by_anchor = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    by_anchor = by_anchor.withColumn("scores", F.array_distinct(F.filter("positives.score", lambda s: s >= 0)))
    by_anchor = materialise(by_anchor, "positives")
    windowed = asks.drop("least").join(by_anchor.filter("size(scores) > 0").select("key", F.transform("scores", _window).alias("windows")), "key")
    far = _search(blocks, windowed, False, negatives)
    pairs = by_anchor.select("key", "scores", F.explode("positives").alias("p"))
    pairs = pairs.select("key", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), (F.array_position("scores", F.col("p.score")) - 1).cast("int").alias("window"))
    named = pairs.join(asks.select("key", "anchor_id"), "key").join(far, ["key", "window"])
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", moved.alias("label")))


#: The same by all products of anchors and rows.
OP12_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.vector, r.vector)::BIGINT AS score
  FROM whole a JOIN whole r ON a.vec_id <> r.vec_id AND len(a.vector) = len(r.vector) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
