"""Exact round trips of packed ids, against the tokenizer on whole texts."""

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from civitext.llm import token_files as tf
from civitext.session import scratch_path

PATH = public_tokenizers.path(tf.VOCABULARY)
TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, tf.END]


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bits_come_back(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = tf.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (tf.unpack_bits(data, 1001, bits) == ids).all()


def test_random_access_reads_few_blocks():
    ids = np.random.default_rng(1).integers(0, 49408, 1000, dtype=np.uint32)
    out = io.BytesIO()
    writer = tf.Writer(out, 17, block=64)
    for a in range(0, 1000, 130):
        writer.add(np.array([a]), np.array([len(ids[a : a + 130])]), ids[a : a + 130])
    writer.close()

    reader = tf.Reader(pa.BufferReader(out.getvalue()))
    for a, b in [(0, 0), (0, 1), (63, 65), (64, 128), (500, 1000), (999, 1000), (0, 1000)]:
        assert (reader.read(a, b) == ids[a:b]).all()
    assert reader.ids == 1000 and reader.bits == 17 and len(reader.offsets) == 17


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(["<|endoftext|> x", "ΑΣ ΣΑ Σ", "é ́x", "a b c", "'S don't 12 3", "\x00\x1c\x85"]), max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    ids, lengths = tf.encode(pa.array(texts, pa.string()), PATH, tf.END)
    expected = [whole(t) for t in texts]
    assert lengths.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def rows_of(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    folder = scratch_path(spark, "test-ids")
    files = tf.write_token_files(docs, folder, **options)
    return sorted(tf.read_token_files(files, folder).collect(), key=lambda r: r.start), files


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(7, "b"), (3, None), (None, "last"), (5, ""), (7, "a"), (7, "a"), (-2, "first words here"), (6, "long text " * 100000)]
    got, files = rows_of(spark, [(*r, "x") for r in rows])
    expected = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc, text) in zip(got, expected, strict=True):
        assert (r.doc_id, r.start, r.ids) == (doc, start, whole(text))
        start += len(r.ids)
    assert files.agg({"n_ids": "sum"}).first()[0] == start


def test_empty_table(spark):
    assert rows_of(spark, [])[0] == []


def test_query_equals_tokenizer_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(tf.op3_token_files(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(texts)
    start = 0
    for r in rows:
        ids = whole(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("most", [0, 200, 1 << 20])
def test_known_words_change_no_ids(most):
    known = tf._Known(most)
    for k in range(6):
        texts = [" ".join(f"word{i} Ünï{i * k} the" for i in range(k, k + 30)), None, "the the"]
        ids, lengths = tf.encode(pa.array(texts, pa.string()), PATH, tf.END, known)
        expected = [whole(t) for t in texts]
        assert lengths.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
        assert known.hashes.nbytes + known.at.nbytes + known.n.nbytes + known.ids.nbytes <= most
    assert (len(known.hashes) > 0) == (most > 0) or most == 200


def test_rows_without_ids_go_to_several_files(spark):
    rows = [(None, f"{i:04d} text", "x") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or these few bytes are one part
    try:
        got, files = rows_of(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 2 and len(got) == 3000 and all(r.doc_id is None for r in got)
    ids = [i for r in got for i in r.ids]
    assert ids == [i for _, t, _ in rows for i in whole(t)]
