"""The sketch-filtered removal against a plain dictionary of windows."""

import hashlib
import random
import re

import pytest

from civitext.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    first = {}
    split = [(i, d, WORD.findall(t or "")) for i, (d, t) in enumerate(rows)]
    for i, d, w in sorted(split, key=lambda r: (r[1] is None, r[1] or 0)):
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at : at + window]), sd.LAST if d is None else d)
    out = []
    for i, d, w in split:
        own, gone = set(), set()
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if first[key] < (sd.LAST if d is None else d) or key in own:
                gone.update(range(at, at + window))
            own.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), kept))
    return sorted(out, key=str)


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in sd.remove_repeated(docs, **options).collect()), key=str)


def corpus(seed):
    pick = random.Random(seed)
    vocabulary = ["a", "b", "ä", "漢字", "x y", "Zed", "-", "long" * 9]
    passage = [pick.choice(vocabulary) for _ in range(60)]
    rows = []
    for d in range(60):
        w = [pick.choice(vocabulary) for _ in range(pick.choice([0, 3, 19, 20, 21, 50, 300]))]
        if d % 3 == 0:
            at = pick.randrange(len(w) + 1)
            w[at:at] = passage[pick.randrange(20) :]
        rows.append((pick.choice([d, d * 7, -d]), pick.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_a_full_sketch_and_many_blocks_change_nothing(spark):
    rows = corpus(3)
    assert got(spark, rows, cells_per_byte=0.001) == brute(rows)
    assert got(spark, rows, block_bytes=500) == brute(rows)


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string")
    result = sd.remove_repeated(docs)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 2 and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_nulls_ties_repeats_and_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(5, text), (5, text), (None, text), (None, text), (1, None), (2, ""), (3, "  \n"), (4, "w1"), (9, "again " * 50000), (7, text + " " + text)]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, id string, kind int")
    assert [tuple(r) for r in sd.remove_repeated(docs).collect()] == [(1, 2, 0, "a b")]


def test_gaps_come_back():
    import numpy as np

    cells = np.array([0, 1, 65534, 65535, 65536, 131071, 262140, 500000])
    assert (sd._cells(sd._gaps(cells)) == cells).all()
    assert sd._cells(sd._gaps(np.zeros(0, np.int64))).size == 0


def test_query_equals_brute_force_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute(rows)]
    assert sorted((tuple(r) for r in sd.op1_substring_dedup(spark, sf_dir).collect()), key=str) == sorted(expected, key=str)
    assert sum(e[2] for e in expected) > 0
