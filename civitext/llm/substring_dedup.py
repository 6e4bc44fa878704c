"""Removal of word sequences that occur earlier in the corpus, behind a count-min prefilter.

Texts are dealt once into blocks of about ``BLOCK_BYTES`` by a hash of their id.

1. Each block counts its windows in a partition sketch: two hash rows of cells.
   Their number grows with the text, so a sketch is sent as the ascending cells
   that the block touched, two bytes for each gap, in slices. Each slice of the
   cells is merged over all blocks, and each block is told which of its cells
   count more than its own one window. A cell never counts less than its
   windows, so a window whose two cells are not both repeated occurs once.
2. Blocks send only windows estimated as repeated, one row for each window and
   block, and those are grouped exactly (on a 96-bit fingerprint of the words):
   the smallest document of each window. Windows that the sketch overestimated
   meet nobody there, so nothing is lost or added.
3. Each block gets the windows that its documents are the first to hold, and
   drops the words of all its other repeated windows.

Nothing is broadcast or collected; a block, a slice and its cells have a fixed
expected size, so their number, not their size, grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm import text_arrays as ta

WINDOW = 20
#: Bytes of text in a block, on average.
BLOCK_BYTES = 2 << 20
#: Cells of a sketch row for each byte of text; about 4 for each word.
CELLS_PER_BYTE = 0.6
#: Slices of a sketch row that are merged apart, and the most cells of one.
SLICES, MOST_CELLS = 64, 1 << 24
LAST = (1 << 63) - 1

_U = np.uint64


def _gaps(cells: np.ndarray) -> bytes:
    """Ascending cells as two bytes for each gap, 65535 meaning 'go on'."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    more = gaps // 65535
    out = np.full(len(gaps) + int(more.sum()), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = gaps % 65535
    return out.tobytes()


def _cells(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def _windows(texts: pa.Table, window: int) -> Iterator[tuple]:
    """Words and window hashes of a block's texts, a slice at a time."""
    for batch in ta.slices(iter(texts.combine_chunks().to_batches()), "size"):
        data, bounds = ta.utf8(ta.unpack(batch.column("packed"), batch.column("size")))
        starts, ends, first = ta.words(data, bounds)
        hashes = ta.hash_words(data, starts, ends)
        yield batch, data, starts, ends, first, hashes, *ta.hash_runs(hashes, first, window)


class _Sketch:
    """How windows fall into cells, and cells into slices."""

    def __init__(self, bits: int):
        self.bits = bits
        self.width = min(MOST_CELLS, max(256, (1 << bits) // SLICES))

    def count(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each row: the distinct cells, their place for each window, and which hold several windows."""
        for salt in (5, 6):
            cells, place, n = np.unique(ta.mix(hashes, salt) >> _U(64 - self.bits), return_inverse=True, return_counts=True)
            yield cells.astype(np.int64), place, n > 1

    def cut(self, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Ascending cells by slice."""
        slices, at = np.unique(cells // self.width, return_index=True)
        for k, own in zip(slices.tolist(), np.split(cells, at[1:])):
            yield k, own - k * self.width


def _hashes(texts: pa.Table, window: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, _U), *(x[-2] for x in _windows(texts, window))])


def _partition_sketch(sketch: _Sketch, window: int):
    """Rows ``block, row, slice``: cells with one window of the block, and with more."""
    schema = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("slice", pa.int64()), ("ones", pa.binary()), ("more", pa.binary())])

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        out = []
        for row, (cells, _, several) in enumerate(sketch.count(_hashes(texts, window))):
            more = dict(sketch.cut(cells[several]))
            ones = dict(sketch.cut(cells[~several]))
            none = np.zeros(0, np.int64)
            out += [{"block": key[0].as_py(), "row": row, "slice": k, "ones": _gaps(ones.get(k, none)), "more": _gaps(more.get(k, none))} for k in ones | more]
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _merge(sketch: _Sketch):
    """For each block, which of its once counted cells others have counted too."""

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        once, twice = np.zeros(sketch.width, bool), np.zeros(sketch.width, bool)
        ones = [_cells(x) for x in parts.column("ones").to_pylist()]
        for own, more in zip(ones, parts.column("more").to_pylist()):
            several = _cells(more)
            twice[own[once[own]]] = True
            once[own] = True
            once[several] = twice[several] = True
        reply = [np.packbits(twice[own]).tobytes() for own in ones]
        at = [parts.column(c) for c in ("block", "row", "slice")]
        return pa.table([*at, pa.array([len(x) for x in ones], pa.int32()), pa.array(reply, pa.binary())], names=["block", "row", "slice", "n", "bits"])

    return run


def _estimated_repeated(sketch: _Sketch, hashes: np.ndarray, replies: pa.Table) -> np.ndarray:
    """Whether the merged sketch counts a window at least twice."""
    out = np.ones(len(hashes), bool)
    rows = replies.filter(pc.is_valid(replies.column("bits"))).select(["row", "slice", "n", "bits"]).sort_by([("row", "ascending"), ("slice", "ascending")]).to_pylist()
    for row, (_, place, several) in enumerate(sketch.count(hashes)):
        told = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in rows if r["row"] == row]
        several[~several] = np.concatenate([np.zeros(0, np.uint8), *told]).astype(bool)
        out &= several[place]
    return out


def _candidates(sketch: _Sketch, window: int):
    """One row for each window estimated as repeated: its smallest id in the block."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        runs, second, ids = [np.zeros(0, _U)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for batch, _, _, _, first, hashes, own, at in _windows(texts, window):
            runs.append(own)
            second.append(ta.hash_runs(hashes, first, window, 1)[0])
            ids.append(batch.column("id").to_numpy()[ta.owners(first)[at]])
        runs = np.concatenate(runs)
        want = _estimated_repeated(sketch, runs, replies)
        high, low, ids = runs[want], np.concatenate(second)[want] >> _U(32), np.concatenate(ids)[want]
        order = np.lexsort((ids, low, high))
        high, low, ids = high[order], low[order], ids[order]
        head = np.ones(len(high), bool)
        head[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        low = low.astype(np.uint32).view(np.int32)
        return pa.table([pa.array(high[head].view(np.int64)), pa.array(low[head]), pa.array(ids[head])], names=["high", "low", "id"])

    return run


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    owner = ta.owners(first)[keep]
    a, size = starts[keep], (ends - starts)[keep] + 1
    ends_text = np.ones(len(owner), bool)
    ends_text[:-1] = owner[1:] != owner[:-1]
    size[ends_text] -= 1
    stops = np.cumsum(size)
    source = np.repeat(a - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)
    out = np.append(data, np.uint8(32))[source]
    out[stops[~ends_text] - 1] = 32
    length = np.bincount(owner, size, len(first) - 1).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(out))


def _keyed(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return ta.mix(hashes ^ ta.mix(ids.view(_U), 3), 4)


def _removal(sketch: _Sketch, window: int):
    """The block's texts without words of repeated windows that it is not the first to hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        repeated = _estimated_repeated(sketch, _hashes(texts, window), told)
        keys = told.filter(pc.is_valid(told.column("high")))
        opened = np.sort(_keyed(keys.column("high").to_numpy().view(_U), keys.column("id").to_numpy()))
        out, done = [], 0
        for batch, data, starts, ends, first, _, runs, at in _windows(texts, window):
            want = np.flatnonzero(repeated[done : done + len(runs)])
            done += len(runs)
            doc = ta.owners(first)[at[want]]
            here = _keyed(runs[want], batch.column("id").to_numpy()[doc])
            known = np.zeros(len(want), bool)
            if len(opened):
                known = opened[np.minimum(np.searchsorted(opened, here), len(opened) - 1)] == here
            # a document's own first start of a window that no smaller document holds stays;
            # rows that share an id do not cover each other
            head = np.zeros(len(want), bool)
            head[np.unique(ta.mix(here ^ ta.mix(doc.astype(_U), 9), 10), return_index=True)[1]] = True
            covered = at[want[~(known & head)]]
            edge = np.bincount(covered, minlength=len(starts) + 1) - np.bincount(covered + window, minlength=len(starts) + 1)
            keep = np.cumsum(edge)[:-1] == 0
            n = np.diff(first)
            left = np.bincount(ta.owners(first)[keep], minlength=len(n))
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - left), _kept(data, starts, ends, first, keep)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ta.slices(batches, "text"):
        packed, sizes = ta.pack(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "id", "doc_id")), packed, sizes], names=["block", "id", "doc_id", "packed", "size"])


def remove_repeated(
    docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cells_per_byte: float = CELLS_PER_BYTE
) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the texts without words of windows that also start earlier.

    Earlier means in a smaller ``doc_id``, or in the same row at an earlier
    word. A null text has no words. A null ``doc_id`` counts as the largest;
    rows with equal ids (or with null) all stay and do not cover one another.
    Texts of fewer than ``window`` words lose nothing. Other columns are not
    used. An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = size // block_bytes + 1
    sketch = _Sketch(max(8, int(size * cells_per_byte).bit_length()))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text"))

    def block(x):
        return F.pmod(F.xxhash64(x), F.lit(blocks))

    packed = docs.withColumn("block", block("id")).mapInArrow(_pack, "block long, id long, doc_id long, packed binary, size long")
    texts = packed.groupBy("block")
    parts = texts.applyInArrow(_partition_sketch(sketch, window), "block long, row int, slice long, ones binary, more binary")
    replies = parts.groupBy("row", "slice").applyInArrow(_merge(sketch), "block long, row int, slice long, n int, bits binary")
    found = texts.cogroup(replies.groupBy("block")).applyInArrow(_candidates(sketch, window), "high long, low int, id long")
    first = found.groupBy("high", "low").agg(F.min("id").alias("id")).select(block("id").alias("block"), "high", "id")
    told = replies.unionByName(first, allowMissingColumns=True)
    return texts.cogroup(told.groupBy("block")).applyInArrow(_removal(sketch, window), "doc_id long, n_words long, n_removed long, text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = remove_repeated(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
