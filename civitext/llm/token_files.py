"""Token ids in files: fixed-width bit packing with block offsets.

A file is ``MAGIC``, the packed blocks, a footer and a trailer. Every id takes
the fewest bits that hold the vocabulary. The footer has the documents' ids, the
number of token ids up to the end of each document, and the byte offset of each
block, so any range of ids is read from its blocks alone and unpacked by numpy.

Files are written to the shared folder under a name of their attempt; the table
of files that finished tasks return says which of them count, so a lost or
repeated task leaves no trace in the result.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.llm import text_arrays as ta
from civitext.session import materialise, scratch_path

MAGIC = b"PACKIDS1"
VOCABULARY, END = "word_bpe_49k.json", 2
#: Token ids in a block.
BLOCK = 1 << 16
LAST = (1 << 63) - 1
#: Bytes of text whose distinct words are encoded at once.
SLICE = 8 << 20
#: Bytes of words' ids that a worker keeps, and characters of a text that part rows of one id.
KNOWN_BYTES, PREFIX = 48 << 20, 32
#: Widths for which packing is a plain little-endian array.
_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}
_TRAILER = struct.Struct("<QQQQII8s")  # footer at, documents, ids, blocks, bits, ids in a block


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below ``2**bits``, least significant bit first, without gaps."""
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in _WHOLE:
        return np.frombuffer(data, _WHOLE[bits], n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file as a stream; holds one block and the footer."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.held, self.size, self.ids, self.at = [], 0, 0, len(MAGIC)
        self.docs, self.ends, self.offsets = [], [], [self.at]
        out.write(MAGIC)

    def add(self, docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.ends.append(self.ids + np.cumsum(lengths))
        self.ids += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._put(ids[at : at + self.block])
            self.held, self.size = [ids[whole:]], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.size:
            self._put(np.concatenate(self.held))
        docs, ends = (np.concatenate([np.zeros(0, np.int64), *x]).astype("<i8") for x in (self.docs, self.ends))
        self.out.write(docs.tobytes() + ends.tobytes() + np.array(self.offsets, "<i8").tobytes())
        self.out.write(_TRAILER.pack(self.at, len(docs), self.ids, len(self.offsets) - 1, self.bits, self.block, MAGIC))


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - _TRAILER.size)
        at, docs, self.ids, blocks, self.bits, self.block, magic = _TRAILER.unpack(source.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        source.seek(at)
        self.docs = np.frombuffer(source.read(8 * docs), "<i8")
        self.ends = np.frombuffer(source.read(8 * docs), "<i8")
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<i8")

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, from their blocks alone."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        out = []
        for b in range(first, last + 1):
            self.source.seek(int(self.offsets[b]))
            data = self.source.read(int(self.offsets[b + 1] - self.offsets[b]))
            out.append(unpack_bits(data, min(self.block, self.ids - b * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Known:
    """Ids of words that a worker has met, by a hash of their bytes; the first ``most`` bytes of them.

    It lives as long as the worker's process, across slices and tasks. What it
    holds decides nothing: any other word is encoded when it comes.
    """

    def __init__(self, most: int = KNOWN_BYTES):
        self.most = most
        self.hashes, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is known, and its place."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[place] == hashes, place

    def add(self, hashes: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        if self.hashes.nbytes + self.at.nbytes + self.n.nbytes + self.ids.nbytes + 16 * len(hashes) + ids.nbytes > self.most:
            return
        at = (len(self.ids) + np.cumsum(n) - n).astype(np.uint32)
        hashes, at, n = np.concatenate([self.hashes, hashes]), np.concatenate([self.at, at]), np.concatenate([self.n, n.astype(np.uint32)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.n, self.ids = hashes[order], at[order], n[order], np.concatenate([self.ids, ids])


@cache
def _known(path: str) -> _Known:
    return _Known()


def encode(texts: pa.Array, path: str, end: int | None, known: _Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end and each text's number of ids, with ``end`` after each text.

    This vocabulary drops white space and nothing joins across it, so the ids of
    a text are those of its words; each distinct word is encoded once in a
    slice, and not at all if the worker knows it.
    """
    known = _known(path) if known is None else known
    data, bounds = ta.utf8(texts)
    starts, ends, first = ta.words(data, bounds)
    hashes, place, own = np.unique(ta.hash_words(data, starts, ends), return_index=True, return_inverse=True)
    hit, where = known.find(hashes)
    new = np.flatnonzero(~hit)
    raw = data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(starts[place[new]].tolist(), ends[place[new]].tolist())]
    coded = [e.ids for e in _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]
    new_n = np.array([len(c) for c in coded], np.int64)
    new_ids = np.array([i for c in coded for i in c], np.uint32)
    size, at = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    size[hit], at[hit] = known.n[where[hit]], known.at[where[hit]]
    size[new], at[new] = new_n, len(known.ids) + np.cumsum(new_n) - new_n
    flat = np.concatenate([known.ids, new_ids])
    known.add(hashes[new], new_n, new_ids)
    n = size[own] if len(own) else np.zeros(0, np.int64)
    stops = np.cumsum(n)
    ids = flat[np.repeat(at[own] - (stops - n), n) + np.arange(n.sum())] if len(own) else new_ids
    cuts = np.concatenate(([0], stops))[first]
    lengths = np.diff(cuts)
    if end is not None:
        ids = np.insert(ids, cuts[1:], end)
        lengths = lengths + 1
    return ids, lengths


def _open(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


def _write(folder: str, vocabulary: str, end: int | None, bits: int):
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in ta.slices(batches, "text", SLICE):
            if writer is None:
                fs, path = _open(folder)
                fs.create_dir(path, recursive=True)
                name = f"ids-{uuid.uuid4().hex}.bin"
                out = fs.open_output_stream(f"{path}/{name}")
                writer = Writer(out, bits)
            ids, lengths = encode(batch.column("text"), vocabulary, end)
            writer.add(batch.column("id").to_numpy(), lengths, ids)
        if writer is not None:
            writer.close()
            out.close()
            docs = sum(map(len, writer.docs))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([docs]), pa.array([writer.ids])], schema=schema)

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int | None = END) -> DataFrame:
    """Writes the token ids of all texts to ``folder`` and returns the table of files.

    Files follow one another in ascending ``doc_id`` (null last, written as
    2**63 - 1; rows with equal ids by text). The table has ``shard``, ``file``, ``n_docs``,
    ``n_ids`` and ``start``, the ids of all files before it. A null text is
    empty; with ``end`` None, empty texts take no ids. An empty table gives no
    file. ``folder`` is one that every executor can reach.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    bits = max(1, (max(_tokenizer(path).get_vocab_size(), (end or 0) + 1) - 1).bit_length())
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text"))
    # the beginning of the text parts rows without an id, or of one id, into several files
    ordered = rows.repartitionByRange("id", F.substring("text", 1, PREFIX)).sortWithinPartitions("id", "text")
    files = ordered.mapInArrow(_write(folder, path, end, bits), "shard int, file string, n_docs long, n_ids long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return materialise(files, "token-files").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(folder: str, at_once: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{path}/{name}") as source:
                    reader = Reader(source)
                    starts, at = np.concatenate(([0], reader.ends[:-1])), 0
                    while at < len(reader.docs):
                        upto = max(at + 1, int(np.searchsorted(reader.ends, starts[at] + at_once, "right")))
                        ids = reader.read(int(starts[at]), int(reader.ends[upto - 1]))
                        cuts = np.append(starts[at:upto], reader.ends[upto - 1]) - starts[at]
                        docs = pa.array(reader.docs[at:upto], pa.int64(), mask=reader.docs[at:upto] == LAST)
                        lists = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(ids.astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([docs, pa.array(base + starts[at:upto]), pa.array(np.diff(cuts)), lists], schema=schema)
                        at = upto

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ids, cuts = lists.flatten().to_numpy().astype("<u4"), np.concatenate(([0], np.cumsum(batch.column("n_tokens").to_numpy())))
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame, folder: str, at_once: int = 1 << 19) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document, one task for each file."""
    n = max(1, files.count())
    return files.select("file", "start").repartition(n).mapInArrow(_read(folder, at_once), "doc_id long, start long, n_tokens long, ids array<long>")


def _read_digests(folder: str):
    read = _read(folder, 1 << 19)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digest(read(batches))

    return run


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ids")
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    n = max(1, files.count())
    return files.select("file", "start").repartition(n).mapInArrow(_read_digests(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
