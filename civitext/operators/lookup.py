"""Joining token rows with a per-token table that may or may not fit in memory.

Token frequencies are heavily skewed: one word can hold a large part of all
rows. A table of checked size is broadcast. A larger one is cut in two. Its
head, the tokens seen most, as many as may be broadcast, is broadcast; the tokens that
each hold at least 1/M of all counted occurrences are in it, and these are at
most M whatever the data looks like. A bitmap of hashes of
the other tokens, of bounded size, is broadcast too: a row whose bit is not set
is of no token in the table and is settled where it stands, however common the
token is. Only rows that may be in the tail are shuffled, and those are salted, so
that a token that is rare in the table but common in the rows is still spread over
many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 * 1024 * 1024
SALTS = 16
# Bits of the bitmap for each token of the tail, and its largest size. A smaller
# share of bits lets more unknown tokens through to the join and changes no result.
BITS_PER_TOKEN, BITMAP_BYTES = 16, 64 * 1024 * 1024


@dataclass(frozen=True)
class TokenTable:
    """A table keyed by ``token`` with its measured size.

    ``total`` is the occurrence count of each row; ``rows``, ``bytes`` and
    ``occurrences`` describe the whole table.
    """

    table: DataFrame
    rows: int
    bytes: int
    occurrences: int
    total: str = "total"

    def fits(self, max_rows: int, max_bytes: int) -> bool:
        return self.rows <= max_rows and self.bytes <= max_bytes


def join_tokens(
    rows: DataFrame,
    tokens: TokenTable,
    key: str = "doc_id",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    parts: int | None = None,
) -> DataFrame:
    """Left join ``rows`` with the token table on ``token``; keeps every row.

    The table's columns are NULL for a token that is not in it. ``parts`` says that
    ``rows`` lie in so many parts by ``key``; the rows that were shuffled to the tail
    go back there, and the result lies in them too.
    """
    if tokens.fits(max_rows, max_bytes):
        return rows.join(F.broadcast(tokens.table), "token", "left")

    head, tail = _parts(tokens, max_rows, _least_total(tokens, max_rows, max_bytes))
    probed = _in_tail(rows.join(F.broadcast(head), "token", "left"), tail, tokens)
    settled = F.col("token").isNull() | F.col(tokens.total).isNotNull() | ~F.col("_in_tail")
    open_rows = probed.filter(~settled).select(*rows.columns, _salt(key, salts).alias("salt"))
    resolved = open_rows.join(_salted(tail, salts), ["token", "salt"], "left").drop("salt")
    if parts:
        resolved = resolved.repartition(parts, key)
    return probed.filter(settled).drop("_in_tail").unionByName(resolved)


def sum_by_key(
    rows: DataFrame,
    tokens: TokenTable,
    sums: Mapping[str, str],
    key: str = "doc_id",
    carry: Sequence[str] = (),
    own: Mapping[str, str] | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Sums, per key, of whole-number SQL expressions over the joined rows.

    The same as ``join_tokens`` and a ``groupBy``, but a large table does not
    make it read the rows twice: the first grouping adds up what the head
    settles, and counts each of the few other tokens of a key for the join with the
    tail. It holds whole numbers only, so it is done in memory by key and token and
    sorts no token rows, as lists of tokens would. An expression is one of the table's
    columns and must be 0 where they are NULL. ``own`` names further sums, of
    expressions over the columns of ``rows`` alone.
    """
    keys, own = [key, *carry], own or {}
    totals = [F.expr(f"sum({e})").alias(name) for name, e in {**sums, **own}.items()]
    if tokens.fits(max_rows, max_bytes):
        return rows.join(F.broadcast(tokens.table), "token", "left").groupBy(*keys).agg(*totals)

    head, tail = _parts(tokens, max_rows, _least_total(tokens, max_rows, max_bytes))
    probed = _in_tail(rows.join(F.broadcast(head), "token", "left"), tail, tokens)
    unsettled = F.when(F.col(tokens.total).isNull() & F.col("_in_tail"), F.col("token"))
    first = probed.withColumn("token", unsettled).groupBy(*keys, "token").agg(*totals, F.count("*").alias("_n"))

    # What is settled carries the sums so far. Its token is NULL and joins nothing; its
    # salt is the whole hash, so these rows spread over all tasks.
    salt = F.when(F.col("token").isNull(), F.xxhash64(key)).otherwise(_salt(key, salts))
    kept = [F.col(name).alias(f"kept_{name}") for name in [*sums, *own]]
    resolved = first.select(*keys, "token", "_n", salt.alias("salt"), *kept).join(
        _salted(tail, salts), ["token", "salt"], "left"
    )
    both = [F.expr(f"sum(kept_{name} + _n * ({e}))").alias(name) for name, e in sums.items()]
    both += [F.sum(f"kept_{name}").alias(name) for name in own]
    return resolved.groupBy(*keys).agg(*both)


def _least_total(tokens: TokenTable, max_rows: int, max_bytes: int) -> int | None:
    """The smallest total whose tokens, with all of larger totals, may be broadcast."""
    room = min(max_rows, max_bytes * tokens.rows // max(tokens.bytes, 1))
    sizes = tokens.table.groupBy(F.col(tokens.total).alias("total")).agg(F.count("*").alias("n"))
    # One row for each different total enters this window.
    upto = F.sum("n").over(Window.orderBy(F.desc("total")))
    return sizes.withColumn("upto", upto).filter(F.col("upto") <= room).agg(F.min("total")).first()[0]


def _parts(tokens: TokenTable, max_rows: int, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Head and tail of a table; the head has at most ``max_rows`` rows.

    In the head are the tokens of at least 1/``max_rows`` of all occurrences, or those
    seen at least ``least`` times if that is less.
    """
    is_head = F.col(tokens.total).cast("decimal(38,0)") * max_rows >= tokens.occurrences
    if least is not None:
        is_head = is_head | (F.col(tokens.total) >= least)
    return tokens.table.filter(is_head), tokens.table.filter(~is_head)


def _in_tail(rows: DataFrame, tail: DataFrame, tokens: TokenTable) -> DataFrame:
    """Add ``_in_tail``: false if the row's token is certainly not in the tail.

    The bitmap has at most ``BITMAP_BYTES`` in pieces of 32,768 bits; a row looks
    up the piece of its token's hash.
    """
    bits = min(1 << max(15, (tokens.rows * BITS_PER_TOKEN - 1).bit_length()), 8 * BITMAP_BYTES)
    place = F.pmod(F.xxhash64("token"), F.lit(bits)) + 1
    piece, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    marks = tail.select(piece.alias("_piece"), bit.alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    # what the head has settled is looked up no more
    wanted = F.when(F.col(tokens.total).isNull(), piece) if tokens.total in rows.columns else piece
    probed = rows.withColumns({"_piece": wanted, "_bit": bit}).join(F.broadcast(marks), "_piece", "left")
    octet = "ascii(decode(substring(_bits, CAST(_bit div 8 AS INT) + 1, 1), 'ISO-8859-1'))"
    marked = F.expr(f"coalesce((shiftright({octet}, CAST(_bit % 8 AS INT)) & 1) = 1, false)")
    return probed.withColumn("_in_tail", marked).drop("_piece", "_bit", "_bits")


def _salt(key: str, salts: int) -> Column:
    # Declared never NULL, or a NULL test would be pushed into one of the two
    # branches of a plan and keep them from sharing a shuffle of the texts.
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(salts)), F.lit(0).cast("bigint"))


def _salted(tail: DataFrame, salts: int) -> DataFrame:
    """Each row once per salt."""
    return tail.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1))))
