"""Byte-level BPE with Spark's higher-order functions, without a tokenizer library.

The merges of a word are a fold: ``aggregate`` starts from the word's bytes, carries
its ids and the ranks of its neighbouring pairs, joins the leftmost pair of lowest rank, and
looks up the two pairs that this makes. Ids and ranks are held as strings of one
character each, in which Spark replaces a place at a third of the cost of arrays. The ranks are a table of one row that
is broadcast: every pair of tokens whose bytes join to a token, in buckets by a hash of the pair. (A literal of them would
be part of each description of a plan that the driver makes: seven megabytes at every stage.)

Words repeat, so they are folded once where that pays:

1. The words of all texts are counted, and those counted most (at most
   ``DICTIONARY`` words of at most ``WORD_BYTES`` bytes) are folded once. Their
   ids are broadcast: the bound is about 30 bytes for each word.
2. A scan cuts each text into words, and writes the ids of known ones from this
   dictionary. The distinct other words of a slice of texts are folded in place.
3. The ids of each text are put together, and decoded by joining the bytes of
   their tokens.

The pattern cuts where the class of characters changes, with rules for white space
and contractions; :func:`cut_words` applies it to all characters of a slice at once.

The dictionary saves work and decides nothing: any word gets the same ids on
either way. Words of over ``LONG`` bytes would make the fold quadratic; they
are merged with a heap in the scan, by the same rule.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm import text_arrays as ta
from civitext.session import materialise

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
DICTIONARY, WORD_BYTES = 1 << 21, 64
LONG = 256
SLICE = 1 << 18
_BUCKETS, _FACTOR = 1 << 16, 40503
#: An id or rank as a character is its number after ``_BASE``, three bytes in UTF-8; beyond all of them are an edge, no rank and a mark.
_BASE, _LIMIT = 0x800, 0xD000
_EDGE, _NONE, _MARK = (chr(_LIMIT + i) for i in range(3))
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    if max(known.values()) + _BASE >= _LIMIT:
        raise ValueError(f"{path} has ids from {_LIMIT - _BASE} on")
    return known


@cache
def pairs(path: str) -> dict[tuple[int, int], int]:
    """The token that each pair of neighbouring tokens joins to; its id is its rank."""
    known = ranks(path)
    out = {}
    for token, rank in known.items():
        for cut in range(1, len(token)):
            a, b = known.get(token[:cut]), known.get(token[cut:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def _rank_buckets(path: str) -> list[str]:
    """Buckets of the pairs' ranks.

    A bucket is ``left right mark rank mark`` for each pair, after three marks with
    no rank in third place: where a pair is absent, its place 0 leads there.
    """
    buckets = [_MARK + _MARK + _NONE + _MARK] * _BUCKETS
    for (a, b), rank in pairs.__wrapped__(path).items():  # one task needs the pairs once
        buckets[(a * _FACTOR + b) % _BUCKETS] += chr(_BASE + a) + chr(_BASE + b) + _MARK + chr(_BASE + rank) + _MARK
    return buckets


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """One row with the ranks, ``ranks array<string>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([_rank_buckets(path)], pa.list_(pa.string()))], names=["ranks"])
        ta.release()

    return materialise(spark.range(0, 1, 1, 1).mapInArrow(run, "ranks array<string>"), "bpe-ranks")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_words(rows: DataFrame, ranks: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``coded``: the ids of each word of the array ``fold`` as a string of one character each.

    Each row meets the ranks once, so it should hold many words.
    """
    each = _let(F.col("ranks"), lambda table: F.transform("fold", lambda word: _fold(word, table, path)))
    return rows.crossJoin(F.broadcast(ranks)).withColumn("coded", each).drop("ranks")


def _fold(word: Column, table: Column, path: str) -> Column:
    one, factor = F.lit(1), F.lit(_FACTOR).cast("bigint")
    octets = "".join(map(chr, range(256)))
    single = "".join(chr(_BASE + ranks(path)[bytes([b])]) for b in range(256))
    # one character for each byte, and its id
    ids = F.concat(F.lit(_EDGE), F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), octets, single), F.lit(_EDGE))

    def rank(a: Column, b: Column) -> Column:
        number = (F.ascii(a) - _BASE) * factor + (F.ascii(b) - _BASE)
        return _let(F.element_at(table, (number % _BUCKETS + 1).cast("int")), lambda x: F.substring(x, F.instr(x, F.concat(a, b)) + 3, one))

    def start(p: Column) -> Column:
        each = F.transform(F.sequence(one, F.char_length(p) - 1), lambda i: rank(F.substring(p, i, one), F.substring(p, i + 1, one)))
        return F.struct(p.alias("ids"), F.array_join(each, "").alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        p, r = state["ids"], state["ranks"]

        def join(low: Column) -> Column:
            def at(k: Column) -> Column:
                around = F.concat(rank(F.substring(p, k - 1, one), low), rank(low, F.substring(p, k + 2, one)))
                return F.struct(F.overlay(p, low, k, F.lit(2)).alias("ids"), F.overlay(r, around, k - 1, F.lit(3)).alias("ranks"))

            return F.when(low < _NONE, _let(F.instr(r, low), at)).otherwise(state)

        return _let(F.array_min(F.split(r, "")), join)

    end = F.aggregate(F.sequence(one, F.greatest(one, F.octet_length(word) - 1)), _let(ids, start), step)
    return _let(end["ids"], lambda p: F.substring(p, F.lit(2), F.char_length(p) - 2))


def _numbers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of strings of ids end to end, and how many each has."""
    if not len(strings):  # may have no buffers at all
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    data, bounds = ta.utf8(strings)
    one, two, three = (data[k::3].astype(np.int32) for k in range(3))
    return (((one & 15) << 12 | (two & 63) << 6 | three & 63) - _BASE).astype(np.uint16), np.diff(bounds) // 3


def merge_long(word: bytes, path: str) -> list[int]:
    """The same merges over a linked list with a heap."""
    known, table = ranks(path), pairs(path)
    ids = [known[bytes([b])] for b in word]
    n = len(ids)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(table[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in table]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i] if ids[i] == a else -1
        if j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = rank, -1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x in (left[i], i):
            if x >= 0 and right[x] >= 0 and (p := (ids[x], ids[right[x]])) in table:
                heapq.heappush(heap, (table[p], x, *p))
    return [i for i in ids if i >= 0]


def _gather(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs ``values[starts : starts + n]`` end to end."""
    stops = np.cumsum(n)
    return values[np.repeat(starts - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)]


class _Dictionary:
    """Ids of words by a hash of their bytes; flat arrays."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes)
        starts = (np.cumsum(n, dtype=np.int64) - n).astype(np.uint32)
        self.hashes, self.n, self.at, self.ids = hashes[order], n[order], starts[order], ids

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is known, and its place."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[place] == hashes, place


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.array([i for x in lists for i in x], np.uint16), n


@cache
def _classes() -> np.ndarray:
    """White space, letter, number or other for each code point, as the pattern's own classes say; the last entry ends a text."""
    out = np.full(0x110001, _OTHER, np.uint8)
    out[-1] = _END
    for block in range(0, 0x110000, 1 << 12):  # few characters at a time: what a worker once took stays with it
        points = "".join(chr(c) for c in range(block, block + (1 << 12)) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            out[[ord(c) for c in regex.findall(pattern, points)]] = kind
    return out


def cut_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts end to end, start and end byte of each word, and the words of each text.

    The words are those of ``public_tokenizers.PATTERN``: runs of letters, of numbers
    and of other characters, each with one space before it; contractions; runs
    of white space, of which the last character stays apart if a word follows.
    """
    raw = "".join(texts).encode()
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    points = np.full(int(ends[-1]) if len(ends) else 0, 0x110000, np.uint32)
    inside = np.ones(len(points), bool)
    inside[ends - 1] = False
    points[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    kind = _classes()[points]
    before = np.concatenate(([_END], kind[:-1])).astype(np.uint8)
    after = np.concatenate((kind[1:], [_END])).astype(np.uint8)
    space = kind == _SPACE
    blank = points == 32
    joined = np.concatenate(([False], blank[:-1]))  # the space before belongs to the word
    head = (kind != before) & (kind != _END)
    head &= space | ~joined
    # the last white space before a word starts anew
    head |= space & (after != _SPACE) & (after != _END)
    # contractions: an apostrophe by itself, not after a space, and its letters
    quote = np.flatnonzero((points == 39) & (before != _OTHER) & (after == _LETTER) & ~joined)
    if len(quote):
        padded = np.concatenate((points, np.full(2, 0x110000, np.uint32)))
        one, two = padded[quote + 1], padded[quote + 2]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        quote, size = quote[size > 0], size[size > 0]
        head[quote + 1] = False
        rest = quote + 1 + size
        head[rest[kind[rest] == _LETTER]] = True
    width = (points < 0x110000).astype(np.uint8)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        width += (points > limit) & inside
    at = np.flatnonzero(head)
    starts = (np.cumsum(width, dtype=np.int64) - width)[at]
    stops = np.append(starts[1:], len(raw))[: len(starts)]
    counts = np.bincount(np.searchsorted(ends, at, "right"), minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    return np.frombuffer(raw, np.uint8), starts, stops, counts


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, hash, start and stop of each distinct word of a slice; the distinct word of each word; the words of each text."""
    data, starts, stops, counts = cut_words(pc.fill_null(texts, "").to_pylist())
    hashes, place, word = np.unique(ta.hash_words(data, starts, stops), return_index=True, return_inverse=True)
    return data, hashes, starts[place], stops[place], word, counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each slice that the dictionary may take, with their counts."""
    for batch in ta.slices(batches, "text", SLICE):
        data, _, starts, stops, word, _ = _distinct(batch.column("text"))
        short = np.flatnonzero(stops - starts <= WORD_BYTES)
        n = np.bincount(word, minlength=len(starts))[short]
        size = (stops - starts)[short]
        words = _binary(_gather(data, starts[short], size), size).cast(pa.string())
        yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])


def _cut(path: str, dictionary, columns: list[str]):
    """A slice of texts as word numbers, the ids of its known and long words, and its words still to fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        for batch in ta.slices(batches, "text", SLICE):
            data, hashes, starts, stops, word, counts = _distinct(batch.column("text"))
            hit, place = known.find(hashes)
            n = np.where(hit, known.n[place] if len(known.n) else 0, 0).astype(np.int64)
            ids = _gather(known.ids, known.at[place[hit]].astype(np.int64), n[hit]) if hit.any() else np.zeros(0, np.uint16)
            left, large = ~hit, stops - starts > LONG
            of = lambda i: data[starts[i] : stops[i]].tobytes()  # noqa: B023, E731
            long_ids, long_n = _flat([merge_long(of(i), path) for i in np.flatnonzero(left & large)])
            folded = np.flatnonzero(left & ~large)
            # distinct words in the order of their ids: known, long, folded
            order = np.concatenate([np.flatnonzero(hit), np.flatnonzero(left & large), folded])
            number = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.int32)
            number[order] = np.arange(len(order), dtype=number.dtype)
            kept = pa.table({c: batch.column(c) for c in columns})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as out:
                out.write_table(kept)
            row = {
                "words": number[word].tobytes(), "n": counts.astype(np.int64).tobytes(), "sizes": np.concatenate([n[hit], long_n]).tobytes(),
                "known": np.concatenate([ids, long_ids]).tobytes(), "kept": sink.getvalue().to_pybytes(), "fold": [of(i).decode() for i in folded],
            }
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([*((k, pa.binary()) for k in list(row)[:-1]), ("fold", pa.list_(pa.string()))]))

    return run


_CUT = "words binary, n binary, sizes binary, known binary, kept binary, fold array<string>"


def _binary(values: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _assemble(path: str):
    """The ids of each text as little-endian 32-bit integers, and the bytes that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sorted(ranks(path), key=ranks(path).get)
        piece_n = np.array([len(p) for p in pieces], np.int64)
        piece_at, piece_bytes = np.cumsum(piece_n) - piece_n, np.frombuffer(b"".join(pieces), np.uint8)
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[k].as_buffer(), t)  # noqa: B023, E731
                n = get("n", np.int64)
                words = get("words", np.uint16 if len(batch.column("words")[k].as_buffer()) == 2 * n.sum() else np.int32)
                with pa.ipc.open_stream(batch.column("kept")[k].as_py()) as stream:  # a copy: rows that are still in use keep no batch
                    kept = stream.read_all().combine_chunks()
                folded = batch.column("coded")[k].values
                fold_ids, fold_n = _numbers(folded if folded is not None else pa.array([], pa.string()))
                size = np.concatenate([get("sizes", np.int64), fold_n])
                # ids of the slice's distinct words first, then of the words in order
                ids = _gather(np.concatenate([get("known", np.uint16), fold_ids]), (np.cumsum(size) - size)[words], size[words])
                cuts = np.concatenate(([0], np.cumsum(size[words])))[np.concatenate(([0], np.cumsum(n)))]
                decoded = _gather(piece_bytes, piece_at[ids], piece_n[ids])
                ends = np.concatenate(([0], np.cumsum(piece_n[ids])))[cuts]
                arrays = [kept.column(c).combine_chunks() if kept.column(c).num_chunks != 1 else kept.column(c).chunk(0) for c in kept.column_names]
                wide = ids.astype("<u4").view(np.uint8)
                yield pa.RecordBatch.from_arrays([*arrays, _binary(wide, 4 * np.diff(cuts)), _binary(decoded, np.diff(ends))], names=[*kept.column_names, "ids", "decoded"])
        batch = get = words = n = folded = None
        ta.release()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a batch as one row."""
    for batch in batches:
        if batch.num_rows:
            words = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("word"))
            yield pa.RecordBatch.from_arrays([words], names=["fold"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as hashes, and their ids, in flat arrays: one row for each batch."""
    for batch in batches:
        data, bounds = ta.utf8(batch.column("fold").flatten())
        ids, n = _numbers(batch.column("coded").flatten())
        row = ta.hash_words(data, bounds[:-1], bounds[1:]), n.astype(np.uint8), ids
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["hashes", "n", "ids"])


def _frequent(docs: DataFrame, ranks: DataFrame, path: str, most: int) -> _Dictionary:
    """The ids of the words counted most, folded once each."""
    words = docs.mapInArrow(_count, "word string, n long")
    counted = materialise(words.groupBy("word").agg(F.sum("n").alias("count")), "bpe-words")
    # the smallest count that keeps the dictionary within its bound
    counts = counted.groupBy("count").agg(F.count("*").alias("words")).orderBy(F.desc("count"))
    total, least = 0, None
    for row in counts.toLocalIterator():
        total += row.words
        if total > most:
            break
        least = row["count"]
    picked = counted.filter(F.col("count") >= (least if least is not None else 1 << 62)).select("word")
    # a word is about a hundred microseconds of work: many small tasks
    tasks = max(1, min(4096, total // 20000 + 1))
    coded = materialise(fold_words(picked.repartition(tasks).mapInArrow(_lists, "fold array<string>"), ranks, path), "bpe-folded")
    rows = materialise(coded.mapInArrow(_hashed, "hashes binary, n binary, ids binary"), "bpe-dictionary").collect()
    arrays = [np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate((np.uint64, np.uint8, np.uint16))]
    return _Dictionary(*arrays)


def encode(docs: DataFrame, vocabulary: str | None = None, dictionary: int = DICTIONARY) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (little-endian 32-bit integers) and ``decoded`` (their bytes), both binary.

    A null or empty text has no ids. All rows and other columns stay, repeated
    rows included; columns named ``ids`` or ``decoded`` are replaced. An empty
    table gives an empty result. No shuffle moves texts; word numbers and ids are
    written to the scratch folder once.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = docs.drop("ids", "decoded").withColumn("text", F.col("text").cast("string"))
    ranks = rank_table(docs.sparkSession, path)
    known = docs.sparkSession.sparkContext.broadcast(_frequent(docs.select("text"), ranks, path, dictionary))
    ta.release()
    columns = [c for c in docs.columns if c != "text"]
    cut = docs.mapInArrow(_cut(path, known, columns), _CUT)
    # written, as cutting and assembling in one stage would take two Python workers for each core
    coded = materialise(fold_words(cut, ranks, path).drop("fold"), "bpe-cut", "zstd")
    schema = docs.drop("text").withColumns({"ids": F.lit(b""), "decoded": F.lit(b"")}).schema
    return coded.mapInArrow(_assemble(path), schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = (F.octet_length("ids") / 4).cast("long")
    return encode(docs).select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
