"""Approximate nearest neighbours by inner product: inverted lists and adaptive scans.

Rows fall into lists of nearby vectors, about as many lists as the square root of
the rows. Their centroids are fitted on a bounded sample in two levels: coarse
ones, and those of each coarse cell; a row is compared with the coarse ones and
with the lists of its nearest cell. A query visits the lists whose best member promises the highest
inner product: that with the centroid, plus what the list's spread and number of
rows add. How many it visits is set on sample queries whose true nearest are found
among all rows, so that ``RECALL`` of these are met; a query whose lists
hold too few rows visits more.

Within a list, vectors are turned by a seeded rotation and compared in blocks of
columns. A threshold on the inner product is one on the distance of query and
candidate. After a random rotation the first m of D columns hold about m / D of
their squared distance, with a known variance, whatever the vectors are. After
each block a candidate is abandoned if its partial distance is too large by
``SURE`` standard deviations for a whole distance within the threshold; survivors
are computed in full from the original vectors. A query's threshold starts at its 2k-th best among the
sample rows of the lists that it visits (at nothing, if those are fewer) and rises
to the k-th best found as a task goes through its rows. Each query makes its most
promising visits first, and starts the others at the k-th best of those. A
threshold is thus never above the k-th best of the visited lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.llm.embedding_dedup import rotation
from civitext.session import materialise

K, EVERY = 20, 20
#: Rows that the lists are fitted on, least and most, and sample rows of a list.
SAMPLE, MOST_SAMPLE, OF_LIST = 1 << 14, 1 << 16, 8
#: Queries whose true nearest decide how many lists to visit; the share of its visits that a query makes first.
JUDGES, FIRST = 256, 8
RECALL, SURE = 0.98, 4.0
#: Columns compared at once; vectors and queries of a task; vectors between two rises of the threshold.
COLUMNS, BLOCK, CHUNK = 16, 4096, 512
#: Share of live pairs from which a block of columns is one product of matrices.
DENSE = 0.05
SEED = 5


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.random.default_rng(SEED).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (-2 * x @ c.T + (c * c).sum(1)).argmin(1)


class Index:
    """Two levels of centroids with the figures of each list, and the sample for first thresholds."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, rows: int, k: int = K):
        self.ids, self.sample, self.k = ids, sample, k
        lists = int(max(1, min(np.sqrt(rows), len(sample) // OF_LIST)))
        self.coarse = _centroids(sample, max(1, int(np.sqrt(lists)))) if len(sample) else sample
        cells = _nearest(sample, self.coarse) if len(sample) else np.zeros(0, int)
        fine, self.cell = [sample[:0]], []
        for cell in range(len(self.coarse)):
            own = sample[cells == cell]
            if len(own):
                fine.append(_centroids(own, max(1, round(lists * len(own) / len(sample)))))
                self.cell += [cell] * len(fine[-1])
        self.centroids, self.cell = np.concatenate(fine), np.array(self.cell, int)
        self.at = [np.flatnonzero(self.cell == c) for c in range(len(self.coarse))]
        self.of_sample = self.assign(sample) if len(sample) else cells
        self.rows, self.reach, self.visits = np.zeros(len(self.centroids), np.int64), np.zeros(len(self.centroids)), 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest of its nearest coarse cell."""
        cells = _nearest(x, self.coarse)
        out = np.zeros(len(x), np.int32)
        for cell in np.unique(cells):
            own, lists = np.flatnonzero(cells == cell), self.at[cell]
            # a cell without lists of its own uses all
            lists = lists if len(lists) else np.arange(len(self.centroids))
            out[own] = lists[_nearest(x[own], self.centroids[lists])]
        return out

    def know(self, rows: np.ndarray, squares: np.ndarray) -> None:
        """Takes the rows of each list and the sum of their squared distances from its centroid."""
        self.rows = rows
        spread = np.sqrt(squares / np.maximum(rows, 1) / max(1, self.centroids.shape[1]))
        self.reach = spread * np.sqrt(2 * np.log(np.maximum(rows, 2)))

    def order(self, queries: np.ndarray) -> np.ndarray:
        """All lists that have rows, by the best inner product that each promises a query; empty ones last."""
        promise = queries @ self.centroids.T + np.sqrt((queries * queries).sum(1))[:, None] * self.reach
        return np.argsort(-np.where(self.rows > 0, promise, -np.inf), 1, kind="stable")

    def settle(self, queries: np.ndarray, best: list[np.ndarray], recall: float) -> None:
        """Sets the number of visits from the lists that hold the true nearest of some queries."""
        place = np.argsort(self.order(queries), 1)
        depth = np.sort(np.concatenate([np.zeros(0, int), *(place[i][lists] for i, lists in enumerate(best))]))
        self.visits = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1 if len(depth) else len(self.centroids)

    def lists_of(self, queries: np.ndarray) -> list[np.ndarray]:
        """The lists that each query visits: ``visits``, and more until they hold twice ``k`` rows."""
        order = self.order(queries)
        enough = (np.cumsum(self.rows[order], 1) < 2 * self.k + 1).sum(1) + 1
        most = int((self.rows > 0).sum())
        return [o[: min(most, max(self.visits, n))].astype(np.int32) for o, n in zip(order, enough)]

    def threshold(self, ids: np.ndarray, queries: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
        """The 2k-th best inner product among sample rows of the visited lists, the query's own row left out.

        Twice ``k``, so that a test that wrongly abandons one of them leaves no query short.
        """
        out = np.full(len(queries), -np.inf)
        scores = queries @ self.sample.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        for i, own in enumerate(lists):
            visited = np.zeros(len(self.centroids), bool)
            visited[own] = True
            mine = scores[i][visited[self.of_sample]]
            if len(mine) > 2 * self.k:
                out[i] = np.partition(mine, -2 * self.k)[-2 * self.k]
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("vector"))
                lists = index.assign(x)
                away = x - index.centroids[lists]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array((away * away).sum(1))], names=[*batch.schema.names, "list", "away"])

    return run


def _true_nearest(queries: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` best rows of a partition for each of a few queries, with their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k), -np.inf)
        lists = np.full((len(queries), k), -1, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                scores = queries @ _vectors(part.column("vector")).T
                scores[ids[:, None] == part.column("vec_id").to_numpy()[None, :]] = -np.inf
                all_scores = np.concatenate([best, scores], 1)
                all_lists = np.concatenate([lists, np.broadcast_to(part.column("list").to_numpy(), scores.shape)], 1)
                top = np.argpartition(-all_scores, k - 1, 1)[:, :k]
                best, lists = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_lists, top, 1)
        found = np.isfinite(best)
        query = np.broadcast_to(np.arange(len(queries))[:, None], best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(query[found].astype(np.int32)), pa.array(lists[found]), pa.array(best[found])], names=["query", "list", "score"])

    return run


def _visit(shared):
    """Each query with its lists and first threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q = _vectors(part.column("vector"))
                lists = index.lists_of(q)
                least = index.threshold(part.column("query_id").to_numpy(), q, lists)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(least)], names=[*part.schema.names, "lists", "least"])

    return run


def prepare(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, the same turned, and the squared length of the columns up to the end of each block."""
    turned = x @ rotation(x.shape[1], 0).T
    ends = np.minimum(np.arange(COLUMNS, x.shape[1] + COLUMNS, COLUMNS), x.shape[1])
    return x, turned, np.cumsum(turned * turned, 1)[:, ends - 1]


def share_bound(seen: int, width: int, sure: float = SURE) -> float:
    """The largest share of a squared distance that its first ``seen`` of ``width`` turned columns may hold without doubt."""
    return min(1.0, seen / width + sure * np.sqrt(2 * seen * (width - seen) / (width**2 * (width + 2))))


def live_pairs(x: tuple, q: tuple, least: np.ndarray, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row and a query that no test abandons.

    While many pairs are alive a block of columns is a product of matrices,
    and then a sum over the list of pairs.
    """
    (_, turned, squares), (_, query, query_squares) = x, q
    d, rows = turned.shape[1], None
    # room for the rounding of the rotation
    low = least - 1e-9 * (squares[:, -1].max(initial=0) + query_squares[:, -1] + np.abs(np.where(np.isfinite(least), least, 0)))
    part = np.zeros((len(turned), len(query)))
    for b, at in enumerate(range(0, d, COLUMNS)):
        one, two = turned[:, at : at + COLUMNS], query[:, at : at + COLUMNS]
        most = share_bound(min(at + COLUMNS, d), d, sure)
        # |x - q|^2 over the columns seen <= most * (|x|^2 + |q|^2 - 2 low), solved for the product
        of_row, of_query = (squares[:, b] - most * squares[:, -1]) / 2, (query_squares[:, b] - most * (query_squares[:, -1] - 2 * low)) / 2
        if rows is None:
            part += one @ two.T
            alive = part >= of_row[:, None] + of_query
            if alive.sum() < DENSE * alive.size or at + COLUMNS >= d:
                rows, queries = np.nonzero(alive)
                part = part[rows, queries]
        else:
            part = part + (one[rows] * two[queries]).sum(1)
            alive = part >= of_row[rows] + of_query[queries]
            rows, queries, part = rows[alive], queries[alive], part[alive]
    return rows, queries


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first ``k`` of each query, in order, and the rank of each."""
    order = np.lexsort((ids, -score, query))
    n = np.bincount(query[order]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    return order[rank < k], rank[rank < k]


def scan(ids: np.ndarray, x: tuple, own: np.ndarray, q: tuple, least: np.ndarray, k: int = K, sure: float = SURE):
    """The best ``k`` rows of a block for each of some queries: query, id and inner product; and how many pairs were computed in full.

    ``x`` and ``q`` are made by :func:`prepare`. Rows with a query's id are its own.
    """
    least, full = least.copy(), 0
    query, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(ids), CHUNK):
        part = tuple(v[at : at + CHUNK] for v in x)
        rows, queries = live_pairs(part, q, least, sure)
        other = ids[at + rows] != own[queries]
        rows, queries = rows[other], queries[other]
        full += len(rows)
        exact = np.concatenate([np.zeros(0), *((part[0][rows[i : i + 65536]] * q[0][queries[i : i + 65536]]).sum(1) for i in range(0, len(rows), 65536))])
        query, found, score = np.concatenate([query, queries]), np.concatenate([found, ids[at + rows]]), np.concatenate([score, exact])
        kept, rank = _top(query, found, score, k)
        query, found, score = query[kept], found[kept], score[kept]
        last = rank == k - 1
        least[query[last]] = np.maximum(least[query[last]], score[last])
    return query, found, score, full


def _scan_block(k: int, sure: float):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        numbers, own = queries.column("query").to_numpy(), queries.column("query_id").to_numpy()
        x, q = (prepare(_vectors(t.column("vector"))) for t in (rows, queries))
        query, ids, score, _ = scan(rows.column("vec_id").to_numpy(), x, own, q, queries.column("least").to_numpy(), k, sure)
        return pa.table([numbers[query], own[query], ids, score], schema=schema)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of rows with an id and a vector that is not zero and has finite components only."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector")).filter("vec_id IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return rows.filter(F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))


def search(vectors: DataFrame, every: int = EVERY, k: int = K, block: int = BLOCK, recall: float = RECALL, sure: float = SURE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Rows without an id, null or zero vectors and those with null or non-finite
    components take no part, nor do those whose length is not the most common
    one. Candidates with the query's id are its own. Equal scores go by smaller
    ``vec_id``; equal rows are candidates each. Equal query rows are one query;
    unequal rows with one id are queries each. An empty table gives an empty
    result. Other columns are not used.
    """
    rows = usable(vectors)
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("vector") == (common["d"] if common else 0))
    total, width = (common["count"], common["d"]) if common else (0, 1)
    size = int(min(MOST_SAMPLE, max(SAMPLE, 2 * OF_LIST * total**0.5)))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).collect()
    index = Index(np.array([r.vec_id for r in picked], np.int64), np.array([r.vector for r in picked], np.float64).reshape(len(picked), width), total, k)
    share = vectors.sparkSession.sparkContext.broadcast  # at most MOST_SAMPLE vectors, and fewer centroids
    placed = materialise(rows.mapInArrow(_assign(share(index)), "vec_id long, vector array<double>, list int, away double"), "ann-lists")
    figures = placed.groupBy("list").agg(F.count("*").alias("rows"), F.sum("away").alias("squares")).collect()
    known = {r.list: r for r in figures}
    index.know(*(np.array([known[i][c] if i in known else 0 for i in range(len(index.centroids))], t) for c, t in (("rows", np.int64), ("squares", float))))
    judges, judge_ids = index.sample[:JUDGES], index.ids[:JUDGES]
    nearest = placed.mapInArrow(_true_nearest(judges, judge_ids, k), "query int, list int, score double")
    nearest = nearest.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "list"))).filter(F.col("rank") <= k).collect()
    index.settle(judges, [np.array([r.list for r in nearest if r.query == i], int) for i in range(len(judges))], recall)
    placed = placed.drop("away")
    asked = rows.filter(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id")
    asked = asked.withColumn("query", F.xxhash64("query_id", "vector"))
    visits = asked.mapInArrow(_visit(share(index)), "query_id long, vector array<double>, query long, lists array<int>, least double")
    visits = materialise(visits, "ann-queries").select("*", F.posexplode("lists").alias("place", "list")).drop("lists")
    early = F.col("place") * FIRST < index.visits
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = materialise(ranked(_looked(placed, visits.filter(early).drop("place"), block, k, sure)), "ann-first")
    reached = first.filter(F.col("rank") == k).select("query", F.col("score").alias("reached"))
    late = visits.filter(~early).drop("place").join(reached, "query", "left")
    late = late.withColumn("least", F.greatest("least", F.coalesce("reached", "least"))).drop("reached")
    found = first.drop("rank").unionByName(_looked(placed, late, block, k, sure))
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def _looked(placed: DataFrame, visits: DataFrame, block: int, k: int, sure: float) -> DataFrame:
    """What the queries find: one task for each block of rows of a list and block of its visitors."""
    sizes = placed.groupBy("list").agg(F.count("*").alias("rows")).join(visits.groupBy("list").agg(F.count("*").alias("queries")), "list")
    sizes = sizes.select("list", F.ceil(F.col("rows") / block).alias("row_blocks"), F.ceil(F.col("queries") / block).alias("query_blocks"))

    def blocks(of: DataFrame, number, its: str, other: str) -> DataFrame:
        out = of.join(sizes, "list").withColumn(its, F.pmod(number, F.col(f"{its}s")))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1))).drop("row_blocks", "query_blocks")

    left = blocks(placed, F.xxhash64("vec_id"), "row_block", "query_block").groupBy("list", "row_block", "query_block")
    right = blocks(visits, F.xxhash64("query"), "query_block", "row_block").groupBy("list", "row_block", "query_block")
    return left.cogroup(right).applyInArrow(_scan_block(k, sure), "query long, query_id long, vec_id long, score double")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
