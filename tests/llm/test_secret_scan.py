"""Spans of secrets against a plain reading of the patterns, and planted random strings."""

import base64
import hashlib
import re

import public_tokenizers

from civitext.llm import secret_scan as ss

ENCODING = ss._encoding(public_tokenizers.path(ss.VOCABULARY))
RANDOM = base64.b64encode(hashlib.sha256(b"x").digest()).decode()


def kinds(text):
    return [(ss.KINDS[k], text[a:b]) for a, b, k in ss.spans(text, ENCODING)]


def brute(text):
    found = []
    for k, pattern, ok in [
        (0, r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        (1, "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (2, "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]:
        at = 0
        while m := re.compile(pattern, re.A).search(text, at):
            at = m.end()
            if ok(m):
                found.append((m.start(), k, m.end()))
    return [(a, b, k) for a, k, b in sorted(found)]


def test_base_patterns():
    assert kinds("PassWord: hunter22") == [("assign", "PassWord: hunter22")]
    assert kinds('"api_key" = "abc-def_1"') == [("assign", 'api_key" = "abc-def_1')]
    assert kinds("secret=token:abcdef1") == []  # the short match uses the text up
    assert kinds("token=12345") == [] and kinds("toKen=1K23456") == []
    assert kinds("AKIA" + "B" * 16) == [("access", "AKIA" + "B" * 16)] and kinds("AKIA" + "B" * 15) == []
    assert kinds("x" + "0a" * 12 + "G") == [("hex", "0a" * 12)] and kinds("0a" * 9) == []


def test_random_strings_and_what_is_known():
    assert kinds(f"see {RANDOM} there") == [("random", RANDOM)]
    for clean in [
        hashlib.md5(b"x").hexdigest().upper(), "123E4567-E89B-12D3-A456-426614174000", "my_long_variable_name_2_for_testing",
        "Donaudampfschifffahrtsgesellschaft", "2024-01-01-2025-01-01", "=" * 40, "thththththanontionerthanon",
    ]:
        assert kinds(clean) == [], clean


def test_query_base_equals_brute_force_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = ss.op6_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        base = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, _, k in base) for n in range(3))
        said = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert said == ",".join(x for x in r.spans.split(",") if not x.startswith("random"))


def test_nulls_long_texts_repeats_and_other_columns(spark):
    long = "word 漢字 " * 200000 + "password=abcdef1"
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = ss.find_secrets(docs).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 1)]
    (span,) = [r.spans[0] for r in out if r.doc_id == 2]
    assert (span.start, span.end) == (len(long) - 16, len(long))
    assert ss.find_secrets(docs.limit(0)).count() == 0


def test_masking(spark):
    text = f"é token=abcdef {RANDOM} secret: {'0a' * 16} end 漢"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in ss.mask_secrets(docs).collect()}
    assert got == {1: "é [SECRET] [SECRET] [SECRET] end 漢", 2: "clean", 3: None}
