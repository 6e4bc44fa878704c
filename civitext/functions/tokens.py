"""Word tokens and fixed-length token arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civitext.functions.text import WORD

# The special tokens.
PAD = "[PAD]"
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))


def pad(tokens: Column, length: int, filler: Column | None = None) -> Column:
    """Cut or right-fill an array to exactly ``length`` entries."""
    filler = F.lit(PAD) if filler is None else filler
    return F.slice(F.concat(tokens, F.array_repeat(filler, length)), 1, length)


def attention_mask(tokens: Column, length: int) -> Column:
    """1 for a position that holds a token, 0 for a filled one."""
    used = F.least(F.size(tokens), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))
