"""Near-duplicate documents by HyperMinHash registers, banded and then verified.

The shingles of a document fall into ``REGISTERS`` buckets. A register keeps the
smallest hash of its bucket as its count of leading zeros and the ``MANTISSA``
bits after them. Band keys are made of as many registers as the threshold allows
(:func:`band_rows`), ``ROWS`` each at ``PERCENT``. A register that is
empty takes the smallest of all the set's shingles by a hash of its own, so that
registers of small sets agree one by one as those of large ones do, and a pair of
any size at the threshold shares a band with all but about
``(1 - t^ROWS)^BANDS`` = 2e-7 probability (4e-9 at 80%, with 64 bands of 6).

1. Equal sets are one class, known by a 128-bit fingerprint. One pass over the texts makes
   fingerprints and band keys; only classes that share a bucket get registers, and only their texts move.
2. In each bucket of a band the classes meet its pivot, the one that shares the
   most bands with others; each class keeps the ``PIVOTS`` met most often. Pairs whose estimate,
   corrected for registers that agree by chance, lies ``SURE`` standard
   deviations under the threshold are dropped; the rest is verified on full sets.
3. Within buckets that still hold several components, classes of different
   components are compared in blocks, by the same estimate and then on full
   sets; a task sends links only. Pairs inside one component cannot change it,
   so no link between components is lost and no rows are made for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.llm import text_arrays as ta
from civitext.llm.components import components
from civitext.session import materialise

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, MANTISSA = 48, 8, 8
REGISTERS = BANDS * ROWS
PIVOTS, SURE = 3, 4.5
#: The share of pairs at the threshold that may have no common band.
MISSED = 3e-7
#: Classes in a block of a bucket, and copies that one task verifies with a pivot.
BLOCK, CHUNK = 256, 256
#: Bytes of text whose shingles are made at once; a byte takes about 30 meanwhile.
SLICE = 1 << 18
_EMPTY = np.uint16(0xFFFF)
_U = np.uint64
#: Products that are made at once for empty registers; bounds memory and fits a cache.
_PRODUCTS = 1 << 17


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and where each text starts (with the end)."""
    data, bounds = ta.utf8(texts)
    data = ta.LOWER[data]
    starts, ends, first = ta.words(data, bounds)
    hashes = ta.hash_words(data, starts, ends)
    runs, at = ta.hash_runs(hashes, first, SHINGLE)
    owner = ta.owners(first)[at]
    n = np.diff(first)
    # a text of fewer words is one shingle: all its words
    for length in range(1, SHINGLE):
        few = n == length
        if few.any():
            own, place = ta.hash_runs(hashes, first, length)
            whole = few[ta.owners(first)[place]]
            runs = np.concatenate([runs, ta.mix(own[whole], 100 + length)])
            owner = np.concatenate([owner, ta.owners(first)[place[whole]]])
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    head = np.ones(len(runs), bool)
    head[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[head], np.searchsorted(owner[head], np.arange(len(n) + 1))


def registers(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the smallest hash in each bucket; one row for each text."""
    out = np.full((len(first) - 1, REGISTERS), _EMPTY, np.uint16)
    if len(runs):
        bucket = ((runs >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64) + ta.owners(first) * REGISTERS
        value = ta.mix(runs, 77)
        order = np.lexsort((value, bucket))
        bucket, value = bucket[order], value[order]
        head = np.ones(len(bucket), bool)
        head[1:] = bucket[1:] != bucket[:-1]
        # the position of the leading one, of values cut to 53 bits so that floats hold them
        short = np.maximum(value[head] >> _U(11), _U(1))
        exponent = np.frexp(short.astype(np.float64))[1]
        mantissa = ((short << (53 - exponent).astype(_U)) >> _U(52 - MANTISSA)) & _U((1 << MANTISSA) - 1)
        out.ravel()[bucket[head]] = ((53 - exponent).astype(_U) << _U(MANTISSA) | mantissa).astype(np.uint16)
    return out


#: Each register's own hash of shingles, for sets that leave it empty: a flip of bits and an odd factor.
_FLIPS, _FACTORS = ta.mix(np.arange(REGISTERS, dtype=_U), 51), ta.mix(np.arange(REGISTERS, dtype=_U), 52) | _U(1)


def filled(table: np.ndarray, runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The registers with every empty one filled from all shingles of its text; one row for each text.

    Two texts agree in a register with the probability of their similarity,
    whether it is filled by its bucket or by its own hash, and one shingle more
    spoils no run of registers.
    """
    out, n = table.astype(_U), np.diff(first)
    empty = table == _EMPTY
    for i in np.flatnonzero(empty.any(1) & (n > 0)):
        which = np.flatnonzero(empty[i])
        x = runs[first[i] : first[i + 1], None]
        step = max(1, _PRODUCTS // len(x))
        for at in range(0, len(which), step):
            part = which[at : at + step]
            # above all values of buckets
            out[i, part] = ((x ^ _FLIPS[part]) * _FACTORS[part]).min(0) | _U(1 << 16)
    return out


def band_rows(percent: int) -> int:
    """The most registers for each band with which no more than ``MISSED`` of pairs at the threshold share none."""
    for rows in (12, 8, 6, 4, 3, 2, 1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISSED and percent <= 100:
            return rows
    raise ValueError(f"no bands for {percent}%")


def band_keys(dense: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each ``rows`` of a row of filled registers; a band takes registers far apart."""
    key = np.zeros((len(dense), REGISTERS // rows), _U)
    for row in dense.reshape(len(dense), rows, REGISTERS // rows).transpose(1, 0, 2):
        key = ta.mix(key ^ row, 31)
    return key


def _chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of buckets in which smallest hashes of unrelated sets of these sizes agree.

    Within one count of leading zeros the mantissas are about uniform.
    """
    low = 0.5 ** np.arange(1, 41)
    share = [np.exp(-n[:, None] / REGISTERS * low) - np.exp(-n[:, None] / REGISTERS * 2 * low) for n in (a, b)]
    return (share[0] * share[1]).sum(1) / (1 << MANTISSA)


def passes(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of register rows of sets of sizes ``a`` and ``b`` may reach the threshold."""
    threshold = percent / 100
    used = ((x != _EMPTY) | (y != _EMPTY)).sum(1)
    agree = ((x == y) & (x != _EMPTY)).sum(1)
    chance = np.minimum(0.5, _chance(a.astype(float), b.astype(float)) * REGISTERS / np.maximum(used, 1))
    estimate = (agree / np.maximum(used, 1) - chance) / (1 - chance)
    slack = SURE * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
    return (np.minimum(a, b) * 100 >= percent * np.maximum(a, b)) & (estimate + slack >= threshold)


def _fingerprint(runs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (41, 42):
        sums = np.concatenate(([_U(0)], np.cumsum(ta.mix(runs, salt))))
        out.append(ta.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(_U), salt).view(np.int64))
    return out[0], out[1]


def _sets(percent: int):
    """Size, fingerprint and band keys of each text; no keys where a link would need an equal set, or without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.slices(batches, "text", SLICE):
            runs, first = shingles(batch.column("text"))
            n, (one, two) = np.diff(first), _fingerprint(runs, first)
            wide = (n * (100 - percent) >= percent) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            runs, first = runs[np.repeat(wide, n)], np.concatenate(([0], np.cumsum(n[wide])))
            keys = band_keys(filled(registers(runs, first), runs, first), band_rows(percent)).view(np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(wide * keys.shape[1]))).astype(np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(one), pa.array(two), lists], names=["doc_id", "n", "one", "two", "keys"])

    return run


def _candidates(percent: int):
    """All that comparing a text with others takes: band keys, registers and the text itself, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ta.slices(batches, "text", SLICE):
            runs, first = shingles(batch.column("text"))
            table = registers(runs, first)
            keys = band_keys(filled(table, runs, first), band_rows(percent)).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_fingerprint(runs, first)[0]), pa.array(np.diff(first)), lists, pa.array([r.tobytes() for r in table], pa.binary()), *ta.pack(batch.column("text"))],
                names=["doc_id", "id", "n", "keys", "registers", "packed", "size"],
            )

    return run


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimate(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ok = passes(_table(part.column("x")), _table(part.column("y")), part.column("m").to_numpy(), part.column("n").to_numpy(), percent)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return run


def _links(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(own, other, assume_unique=True))
    return 100 * both >= percent * (len(own) + len(other) - both)


def _across(percent: int):
    """Links between the two blocks of a bucket, on full sets, that join two components.

    A pair belongs to the first band that both share. Pairs that links found
    here have already joined are not looked at again.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = (k.as_py() for k in key[2:])
        runs, first = shingles(ta.unpack(rows.column("packed").combine_chunks(), rows.column("size")))
        ids = rows.column("id").to_numpy()
        block, n = rows.column("block").to_numpy(), rows.column("n").to_numpy()
        table, keys = _table(rows.column("registers")), np.array(rows.column("earlier").to_pylist(), np.int64)
        group = np.unique(rows.column("label").to_numpy(), return_inverse=True)[1]
        out = []
        side = [np.flatnonzero(block == b) for b in (low, high)]
        for i in side[0]:
            others = side[1][(group[side[1]] != group[i]) & ((side[1] > i) if low == high else True)]
            others = others[~(keys[others] == keys[i]).any(1)]
            if not len(others):
                continue
            near = others[passes(np.broadcast_to(table[i], (len(others), REGISTERS)), table[others], np.full(len(others), n[i]), n[others], percent)]
            for j in near:
                if group[i] != group[j] and _links(runs[first[i] : first[i + 1]], runs[first[j] : first[j + 1]], percent):
                    out.append((int(ids[i]), int(ids[j])))
                    group[group == group[j]] = group[i]
        return pa.table({"a": [x for x, _ in out], "b": [y for _, y in out]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _confirm(percent: int):
    """Links on full sets. A pivot's text comes before those that are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in ta.slices(batches, "size", SLICE):
            runs, first = shingles(ta.unpack(batch.column("packed"), batch.column("size")))
            keys = [batch.column(c).to_numpy() for c in ("pivot", "chunk", "id")]
            links = []
            for i, (p, c, x) in enumerate(zip(*keys)):
                mine = runs[first[i] : first[i + 1]]
                if x == p:
                    pivot, own = (p, c), mine.copy()
                elif pivot == (p, c) and _links(own, mine, percent):
                    links.append((p, x))
            if links:
                yield pa.RecordBatch.from_pydict({"a": [int(a) for a, _ in links], "b": [int(b) for _, b in links]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _verified(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links; many partners of one class are dealt to several tasks."""
    chunks = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(chunks, "a").select(F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("chunk"), F.col("b").alias("id"))
    dealt = materialise(dealt, "pairs")
    all_rows = dealt.union(dealt.select("pivot", "chunk", F.col("pivot").alias("id")).distinct())
    together = all_rows.join(table.select("id", "packed", "size"), "id").withColumn("later", F.col("id") != F.col("pivot"))
    return together.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "later").mapInArrow(_confirm(percent), "a long, b long")


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return classes.select("id").join(found, "id", "left").select("id", F.coalesce("component_id", "id").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``doc_id, text``.

    Texts link if their sets of shingles share at least ``percent`` of their union.
    A null or empty text has no shingles and links with nothing. Rows with equal
    ids are one vertex; a null id links with nothing, keeps a null component and
    is kept. Other columns are not used. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # keys are written with the sets, so that no text moves for them
    sets = materialise(docs.mapInArrow(_sets(percent), "doc_id long, n long, one long, two long, keys array<long>"), "sets")
    linked = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("one", "two").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    # a class is known by half of its fingerprint, and read from its smallest document
    classes = classes.select(F.col("one").alias("id"), "doc_id", "n", "one", "two")
    # a set too small for one shingle more to stay within the threshold links with equal sets only
    wide = classes.filter(F.col("n") * (100 - percent) >= percent).select("id", "doc_id").dropDuplicates(["id"])
    # documents with one id may hold several texts, and rows may repeat; each class keeps one that it is read from
    of_class = sets.select(F.col("one").alias("id"), "doc_id", "keys").join(wide, ["id", "doc_id"], "left_semi").dropDuplicates(["id", "doc_id"])
    banded = of_class.select("id", F.posexplode("keys").alias("band", "code")).select("band", F.xxhash64("band", "code").alias("bucket"), "id")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = materialise(banded.join(buckets, "bucket"), "buckets")
    # most classes share no bucket; from here on only the others and their texts are read
    needed = materialise(wide.join(members.select("id").distinct(), "id", "left_semi"), "needed")
    made = docs.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")
    made = made.mapInArrow(_candidates(percent), "doc_id long, id long, n long, keys array<long>, registers binary, packed binary, size long")
    table = materialise(made.join(needed, ["id", "doc_id"], "left_semi").dropDuplicates(["id", "doc_id"]).drop("doc_id"), "candidates")
    # the text that copies were made from shares bands with more of them than they do with one another
    degree = members.groupBy("id").agg(F.sum("members").alias("degree"))
    pivots = members.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", "id"))["id"].alias("pivot"))
    met = members.join(pivots, "bucket").filter("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("times"))
    best = Window.partitionBy("id").orderBy(F.desc("times"), "pivot")
    star = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= PIVOTS).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    one = table.select(F.col("id").alias("a"), F.col("registers").alias("x"), F.col("n").alias("m"))
    two = table.select(F.col("id").alias("b"), F.col("registers").alias("y"), "n")
    tried = materialise(star.join(one, "a").join(two, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(_estimate(percent), "a long, b long"), "tried")
    links = materialise(_verified(tried, table, percent), "verified")
    label = materialise(_labels(table, links), "labels")
    labelled = members.select("band", "bucket", "id", "members").join(label, "id")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low_label"), F.max("label").alias("high_label")).filter("low_label <> high_label").select("bucket")
    blocks = F.ceil(F.col("members") / block)
    rows = labelled.join(mixed, "bucket").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks)})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", "bucket", "id", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = materialise(rows, "mixed-buckets")
    full = rows.join(table, "id").withColumn("earlier", F.slice("keys", F.lit(1), F.col("band"))).drop("keys")
    more = materialise(full.groupBy("band", "bucket", "low", "high").applyInArrow(_across(percent), "a long, b long"), "verified")
    # classes by their smallest document, and all documents of a class by that one
    ids = classes.select("id", "doc_id")
    named = links.union(more).join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = linked.join(classes.select("one", "two", F.col("doc_id").alias("b")), ["one", "two"]).select(F.col("doc_id").alias("a"), "b")
    found = components(named.union(same).filter("a <> b"))
    result = sets.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
