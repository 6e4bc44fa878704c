"""Words of many texts at once: numpy over the UTF-8 bytes of Arrow columns.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashing works on prefix sums modulo 2**64, so
its cost is a few passes over the bytes, whatever the number of words, and no
Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice of a batch; bounds the memory of a task.
BLOCK = 1 << 20
#: Bytes that are hashed at once, or one word: a byte takes about 50 meanwhile, and 16 for its powers until the end of the task.
HASHED = 1 << 17

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 2**64), _U)
    up[:1] = down[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Powers:
    """Powers of a base, kept up to the longest block asked for until :func:`release`."""

    def __init__(self, base: int):
        self.base = base
        self.clear()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n)
        return self.up[:n], self.down[:n]

    def clear(self) -> None:
        self.up, self.down = np.zeros(0, _U), np.zeros(0, _U)


_BYTE_POWERS = _Powers(0xD1342543DE82EF95)
_WORD_POWERS = (_Powers(0x2545F4914F6CDD1D), _Powers(0x9FB21C651E98DF25))
_BYTE_VALUE = mix(np.arange(256, dtype=_U), 7)


def release() -> None:
    """Gives freed memory and the powers back to the system: an idle Python worker otherwise keeps what its largest slice took."""
    for powers in (_BYTE_POWERS, *_WORD_POWERS):
        powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices with at most ``limit`` bytes of text, or one row.

    ``column`` holds the texts, or their sizes. A slice is a copy: one that is still
    in use when the task ends would keep its whole batch in an idle worker.
    """
    for batch in batches:
        sizes = batch.column(column)
        sizes = sizes if pa.types.is_integer(sizes.type) else pc.binary_length(sizes)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(at, upto - at)
            yield part if part.num_rows == batch.num_rows else pa.ipc.read_record_batch(part.serialize(), part.schema)
            at = upto
    batch = sizes = part = None
    release()


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each text compressed by itself, for a shuffle, and its size in bytes; null counts as empty."""
    raw = [t.as_buffer() for t in pc.fill_null(texts, "").cast(pa.binary())]
    return pa.array([_ZSTD.compress(t, asbytes=True) for t in raw], pa.binary()), pa.array([t.size for t in raw], pa.int64())


def unpack(packed: pa.Array, sizes: pa.Array) -> pa.Array:
    raw = [_ZSTD.decompress(p.as_buffer(), n, asbytes=True) for p, n in zip(packed, sizes.to_pylist())]
    return pa.array(raw, pa.binary()).cast(pa.string())


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and where each text starts, plus the end; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each text's first word (with the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    first[heads] = inside[heads]
    tails = bounds[1:][bounds[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(starts), _U)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            upto = max(at + 1, int(np.searchsorted(ends, low + HASHED, "right")))
            high = ends[upto - 1]
            up, down = _BYTE_POWERS.upto(int(high - low))
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(_BYTE_VALUE[data[low:high]] * up, out=sums[1:])
            a, b = starts[at:upto] - low, ends[at:upto] - low
            # the length keeps words apart that differ by bytes of value 0 only
            out[at:upto] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U) * _U(0xA0761D6478BD642F))
            at = upto
    return out


def hash_runs(hashes: np.ndarray, first: np.ndarray, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words that lie in one text, and each run's first word.

    ``which`` (0 or 1) picks one of two unrelated hash functions.
    """
    sizes = np.maximum(np.diff(first) - length + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    if not len(at):
        return np.zeros(0, _U), at
    with np.errstate(over="ignore"):
        up, down = _WORD_POWERS[which].upto(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, _U)
        np.cumsum(mix(hashes, 11 + which) * up[:-1], out=sums[1:])
        return mix((sums[at + length] - sums[at]) * down[at], 23 + which), at


def owners(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
