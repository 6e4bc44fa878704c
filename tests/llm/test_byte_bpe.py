"""Ids against the tokenizer library on whole texts, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from civitext.llm import byte_bpe as bb

PATH = public_tokenizers.path(bb.VOCABULARY)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bb.ranks(PATH), special_tokens={})


def ids_of(text):
    return np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()


def texts():
    pick = random.Random(5)
    pool = ["a", "the", " ", "  ", "\n", "\t", "é", "漢字", "😀", "don't", "12345", "§$%", "ñ", "Ünïcode", "x" * 40, "\x00", " ", "́", "ъ", "the x"]
    return ["".join(pick.choice(pool) for _ in range(pick.randrange(60))) for _ in range(150)] + ["z" * 1000 + "ab" * 300, "<|endoftext|>", "   ", "aaaaaaaa" * 8]


@pytest.mark.parametrize("dictionary", [0, 40, 1 << 21])
def test_equals_the_library_and_round_trips(spark, dictionary):
    rows = [(i, t, "x", b"y") for i, t in enumerate(texts())] + [(900, None, "x", None), (None, "", None, None), (0, "again", "x", None), (0, "again", "x", None)]
    out = bb.encode(spark.createDataFrame(rows, "doc_id long, text string, fold string, ids binary"), dictionary=dictionary)
    assert out.columns == ["doc_id", "fold", "ids", "decoded"]
    got = sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in out.collect())
    assert got == sorted((str(i), ids_of(t), (t or "").encode()) for i, t, *_ in rows)


def test_words_are_those_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    pick = random.Random(8)
    pool = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "'", "'s", "'re", "'ll", "'d", "'S", "s", "re", "l", "é", "漢", "7", "٣", "½", "!", "...", "😀", "\u0301", "\x00", "a", "\r\n", "\x85", "\x1f"]
    texts = ["".join(pick.choice(pool) for _ in range(pick.randrange(14))) for _ in range(6000)] + ["", "'s", " 's", "x's y'all ''t 'sad 're", "a  b", "a \n b", "  ", "\n'm"]
    data, starts, stops, counts = bb.cut_words(texts)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, stops)]
    cuts = np.concatenate(([0], np.cumsum(counts)))
    for text, a, b in zip(texts, cuts[:-1], cuts[1:]):
        assert got[a:b] == pattern.findall(text), text
    assert [len(x) for x in bb.cut_words([])] == [0, 0, 0, 0]


def test_plans_do_not_spell_out_the_ranks(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    assert len(bb.encode(docs, dictionary=40)._jdf.queryExecution().toString()) < 100_000


def test_a_stage_has_one_python_worker_for_each_task(spark):
    plan = bb.encode(spark.createDataFrame([(1, "some words")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_many_distinct_words_in_one_text(spark):
    text = " ".join(f"{a}{b}{c}{d}" for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopq" for c in "rstuvwxyzrstuvwx" for d in "abcdefghijklmno"[: 8 + (c > "t")])
    text += "".join(chr(0x4E00 + k) + " " for k in range(20000)) + " ".join(f"{chr(0x4E00 + k)}{chr(0x5E00 + j)}" for k in range(250) for j in range(250))
    assert len(set(text.split())) > 1 << 16
    [row] = bb.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), dictionary=1 << 21).collect()
    assert bytes(row.ids) == ids_of(text) and bytes(row.decoded) == text.encode()


def test_empty_table(spark):
    assert bb.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_merge_as_the_library_does():
    pick = random.Random(6)
    for n in (1, 2, 300, 5000):
        word = "".join(pick.choice("abcdeäñ漢") for _ in range(n))
        assert bb.merge_long(word.encode(), PATH) == LIBRARY.encode_ordinary(word)


def test_query_equals_the_library_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bb.op9_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
