"""Text normalisation as Column expressions.

Every step but NFC is a built-in that stays in the JVM. The steps run one after
the other because a later rule may act on what an earlier one left behind.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes, written so that Java and RE2 read them alike.
# All Unicode white space, and the characters of a word.
_LATIN_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}"
_OTHER_SPACE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITESPACE = _LATIN_SPACE + _OTHER_SPACE
WORD = r"\p{L}\p{N}_"
# The code point ranges removed as emoji. The last range is wide:
# it also holds CJK, kana, Hangul and the extended Ethiopic blocks.
EMOJI_RANGES = (
    ("1F600", "1F64F"),
    ("1F300", "1F5FF"),
    ("1F680", "1F6FF"),
    ("1F1E0", "1F1FF"),
    ("2702", "27B0"),
    ("24C2", "1F251"),
)
# The blocks that hold nothing but pictographs, for the strict
# variant: no letter of any script is in them, and newer emoji are.
STRICT_EMOJI_RANGES = (
    ("1F1E6", "1F1FF"),
    ("1F300", "1F64F"),
    ("1F680", "1F6FF"),
    ("1F7E0", "1F7EB"),
    ("1F900", "1F9FF"),
    ("1FA70", "1FAFF"),
    ("2600", "27BF"),
)
# Characters mapped onto an equivalent one.
EQUIVALENTS = {"\u1215": "\u1200", "\u1206": "\u1200", "\u1a00": "\u12a0"}
# The core Ethiopic block.
ETHIOPIC = r"\x{1200}-\x{137F}"

URL_PATTERN = rf"https?://[^{WHITESPACE}]+|www\.[^{WHITESPACE}]+"
MENTION_PATTERN = rf"@[{WORD}]+"
HASHTAG_PATTERN = rf"#([{WORD}]+)"
EMOJI = "".join(rf"\x{{{lo}}}-\x{{{hi}}}" for lo, hi in EMOJI_RANGES)
EMOJI_PATTERN = f"[{EMOJI}]+"
PUNCTUATION_PATTERN = r"[\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}]{2,}"
WHITESPACE_PATTERN = f"[{WHITESPACE}]+"

# Text made of these characters only is already in NFC: each is a starter that
# no composition rule touches (Latin, Cyrillic, Ethiopic, kana, CJK, Hangul
# syllables, punctuation, pictographs).
NFC_STABLE = (
    r"\x{0}-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{5D0}-\x{5EA}\x{621}-\x{64A}"
    r"\x{1200}-\x{135C}\x{1360}-\x{137F}\x{2002}-\x{20CF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}"
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{1F300}-\x{1FAFF}"
)


# The same classes as Java runs them fastest: it tries the parts of a class one
# after the other, so an outer range that rules out plain letters at the first
# comparison halves the time of a pass.
_FAST_EMOJI = rf"[\x{{24C2}}-\x{{1F6FF}}&&[{EMOJI}]]+"
_STRICT = "".join(rf"\x{{{lo}}}-\x{{{hi}}}" for lo, hi in STRICT_EMOJI_RANGES)
_STRICT_EMOJI = rf"[{_STRICT}][{_STRICT}\x{{200D}}\x{{FE0F}}]*"
_FAST_PUNCTUATION = r"\p{Punct}{2,}"
_FAST_WHITESPACE = rf"[{_LATIN_SPACE}[\x{{1680}}-\x{{3000}}&&[{_OTHER_SPACE}]]]+"
_NOT_STABLE = rf"[\x{{300}}-\x{{10FFFF}}&&[^{NFC_STABLE}]]"


@F.arrow_udf(StringType())
def _compose(values: pa.Array) -> pa.Array:
    return pa.array(
        [None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string()
    )


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no built-in, so an Arrow UDF does it.

    ``when`` does not keep a Python UDF from being called, so the test sits in
    the argument: stable rows reach Python as NULL and are taken from the JVM.
    """
    return F.coalesce(_compose(F.when(text.rlike(_NOT_STABLE), text)), text)


def null_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_PATTERN, " ")


def strip_mentions(text: Column) -> Column:
    """Remove ``@name``; this also cuts the domain of an e-mail address."""
    return F.regexp_replace(text, MENTION_PATTERN, " ")


def unwrap_hashtags(text: Column) -> Column:
    """Drop the ``#`` and keep the word."""
    return F.regexp_replace(text, HASHTAG_PATTERN, " $1 ")


def strip_emoji(text: Column, strict: bool = False) -> Column:
    """Remove emoji; ``strict`` keeps the scripts that the wide ranges hold, and takes newer emoji.

    Skin tones lie inside the strict ranges; joiners and variation selectors go with
    the emoji that they belong to.
    """
    return F.regexp_replace(text, _STRICT_EMOJI if strict else _FAST_EMOJI, " ")


def collapse_punctuation(text: Column) -> Column:
    """Replace a run of two or more ASCII punctuation marks by one space."""
    return F.regexp_replace(text, _FAST_PUNCTUATION, " ")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _FAST_WHITESPACE, " "))


def normalise(text: Column, strict_emoji: bool = False) -> Column:
    """The whole chain; a NULL input becomes the empty string."""
    composed = nfc(null_to_empty(text))
    bare = unwrap_hashtags(strip_mentions(strip_urls(composed)))
    return collapse_whitespace(collapse_punctuation(strip_emoji(bare, strict_emoji)))


def unify_equivalents(text: Column) -> Column:
    """Optional unification of equivalent characters; not part of ``normalise``."""
    return F.translate(text, "".join(EQUIVALENTS), "".join(EQUIVALENTS.values()))


def is_near_empty(text: Column) -> Column:
    return F.length(text) <= 2


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(f"[^{WHITESPACE}]"), F.lit(True))


def ethiopic_only(text: Column) -> Column:
    """The Ethiopic characters of ``text``, in order."""
    return F.regexp_replace(text, f"[^{ETHIOPIC}]", "")
