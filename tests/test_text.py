import random
import re
import unicodedata

from pyspark.sql import functions as F

from civitext.functions import text as tx

GOLDEN = [
    ("ሰላም https://example.com ዓለም", "ሰላም ዓለም"),
    ("@user ጥሩ ጽሑፍ", "ጥሩ ጽሑፍ"),
    ("#ኢትዮጵያ ጥሩ ሀገር", "ኢትዮጵያ ጥሩ ሀገር"),
    ("ሰላም 😊 ዓለም", "ሰላም ዓለም"),
    ("ሰላም    ዓለም", "ሰላም ዓለም"),
    ("", ""),
    ("ኢትዮጵያ ሀገራችን ናት", "ኢትዮጵያ ሀገራችን ናት"),
    ("ሰላም @user ይህ ጥሩ ነው! 😊 https://t.co/abc123", "ሰላም ይህ ጥሩ ነው!"),
    ("#ኢትዮጵያ ሀገራችን ናት!!!", "ኢትዮጵያ ሀገራችን ናት"),
    ("ጥሩ   ጽሑፍ    ነው", "ጥሩ ጽሑፍ ነው"),
    ("mail a.b@example.com now", "mail a.b .com now"),
    ("HTTP://UPPER.com x", "HTTP UPPER.com x"),
    ("(https://a.b/c), next", "( next"),
    ("wow!? ok... end.", "wow ok end."),
    ("漢字 kana かな 한글 ok", "kana ok"),
    ("\u2d80 extended", "extended"),
    ("🤣 laugh 🤣", "🤣 laugh 🤣"),
    ("☀ sun ✂ cut", "☀ sun ✂ cut".replace("☀ ", "").replace("✂ ", "")),
    ("cafe\u0301 x", "caf\u00e9 x"),
    ("a\u00a0b\u3000c\u001cd", "a b c d"),
    ("#tag#two", "tag two"),
    ("##x", "# x"),
    ("@@x", "@"),
    ("፡፡ a።። b", "፡፡ a።። b"),
    ("#", "#"),
    ("@ሰላም hi", "hi"),
    ("-- a -- b", "a b"),
    ("x\ty\nz", "x y z"),
    ("www.x.com/a?b=c#d tail", "tail"),
    ("ok 👍🏽 done", "ok done"),
    (None, ""),
]


def run(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("text"))).collect()]


def test_golden_rows(spark):
    assert run(spark, tx.normalise, [given for given, _ in GOLDEN]) == [wanted for _, wanted in GOLDEN]


def test_normalising_twice_changes_nothing(spark):
    rng = random.Random(1)
    alphabet = "ab1 .!?#@_\t\u00a0\u3000e\u0301ሰላ😊漢:/-w" + "🤣"
    pieces = [*alphabet, "https://", "www.", "@u", "#t"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(5000)]
    once = run(spark, tx.normalise, texts)
    assert run(spark, tx.normalise, once) == once


def test_fast_classes_equal_the_portable_ones(spark):
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for fast, portable in [
        (tx._FAST_EMOJI, tx.EMOJI_PATTERN),
        (tx._FAST_WHITESPACE, tx.WHITESPACE_PATTERN),
        (tx._NOT_STABLE, f"[^{tx.NFC_STABLE}]"),
    ]:
        same = lambda c: c.rlike(fast) == c.rlike(portable)
        assert all(run(spark, same, chars))
    pairs = [chr(c) * 2 for c in range(0x300)]
    assert all(run(spark, lambda c: c.rlike(tx._FAST_PUNCTUATION) == c.rlike(tx.PUNCTUATION_PATTERN), pairs))


def test_whitespace_class_is_pythons(spark):
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    found = run(spark, lambda c: c.rlike(tx.WHITESPACE_PATTERN), chars)
    assert found == [bool(re.match(r"\s", c)) for c in chars]


def test_stable_characters_never_change(spark):
    inside = re.compile("[" + re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", tx.NFC_STABLE) + "]")
    stable = [c for c in map(chr, range(0x110000)) if inside.match(c)]
    assert len(stable) > 40_000
    # A character that is its own composed form, is no combining mark and is no
    # second half of a composition cannot change in any text of such characters.
    seconds = set()
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    jamo = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in stable:
        assert unicodedata.normalize("NFC", c) == c
        assert unicodedata.combining(c) == 0
        assert c not in seconds and c not in jamo


def test_nfc_matches_python(spark):
    rng = random.Random(2)
    alphabet = "aeocn\u0301\u0308\u0327\u1100\u1161\u11a8\u212b\u0915\u093cሀ\u135f é"
    texts = ["".join(rng.choices(alphabet, k=12)) for _ in range(2000)]
    assert run(spark, tx.nfc, texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_equivalents(spark):
    assert run(spark, tx.unify_equivalents, ["ሕሆᨀ abc ሐሀአ"]) == ["ሀሀአ abc ሐሀአ"]


def test_blank_and_near_empty(spark):
    assert run(spark, tx.is_blank, [None, "", " \t\u00a0\u3000", "x", " ."]) == [True, True, True, False, False]
    assert run(spark, tx.is_near_empty, ["", "ab", "abc", "ሰላም"]) == [True, True, False, False]


def test_strict_emoji_keeps_scripts_and_takes_new_emoji(spark):
    kept = ["漢字 かな 한글 ⶀ ꬁ Ⓜ", "ሰላም ዓለም!", "→ ① ™ ©"]
    assert run(spark, lambda c: tx.strip_emoji(c, strict=True), kept) == kept
    gone = ["a🤣b", "a👍🏽b", "a👩\u200d🚀b", "a❤\ufe0fb", "a🇪🇹b", "a☀✂b", "a🟠b"]
    assert run(spark, lambda c: tx.strip_emoji(c, strict=True), gone) == ["a b"] * len(gone)
    assert run(spark, lambda c: tx.normalise(c, strict_emoji=True), ["漢字 😊🤣 ok"]) == ["漢字 ok"]
