import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest

from civitext import HARM
from civitext.operators import prepare
from civitext.operators import split as sp


def frame(spark, labels):
    return spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "doc_id long, label_id int")


def brute(labels, test=Fraction(15, 100), val=Fraction(15, 100), seed=42):
    """Rank every class by hash and cut it by hand."""
    counts = Counter(labels)
    seats_test = sp.quotas(counts, sp.share(len(labels), test))
    rest = {c: counts[c] - seats_test[c] for c in counts}
    seats_val = sp.quotas(rest, sp.share(sum(rest.values()), val / (1 - test)))
    result = {}
    for c in counts:
        keys = sorted((i for i, x in enumerate(labels) if x == c), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
        for place, i in enumerate(keys):
            t, v = seats_test[c], seats_val[c]
            result[i] = "test" if place < t else "val" if place < t + v else "train"
    return result


@pytest.mark.parametrize("n, test, val", [(60, 9, 9), (87, 14, 13), (399, 60, 60), (3000, 450, 450)])
def test_golden_sizes(n, test, val):
    assert sp.share(n, Fraction(15, 100)) == test
    assert sp.share(n - test, Fraction(3, 17)) == val


def test_quotas_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        counts = {c: rng.randint(0, 50) for c in range(rng.randint(1, 6))}
        total = rng.randint(0, sum(counts.values()))
        seats = sp.quotas(counts, total)
        assert sum(seats.values()) == total
        assert all(0 <= seats[c] <= counts[c] for c in counts)


def test_balanced_classes(spark):
    texts, labels = ["ሰላም ሰው", "ጥሩ ጽሑፍ", "ሌላ ጽሑፍ"] * 20, ["normal", "hate", "abusive"] * 20
    rows = [(i, t, label) for i, (t, label) in enumerate(zip(texts, labels))]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    out = prepare.preprocess(df, HARM).collect()
    assert Counter((r.split, r.label_id) for r in out) == {
        (s, c): n for s, n in (("test", 3), ("val", 3), ("train", 14)) for c in range(3)
    }
    assert len({r.doc_id for r in out}) == 60


@pytest.mark.parametrize("limit", [1_000_000, 40, 3, 0])
def test_narrowing_finds_the_same_cuts(spark, monkeypatch, limit):
    """Any rank limit, down to one that reads whole hashes, gives the same split."""
    monkeypatch.setattr(sp, "RANK_LIMIT", limit)
    rng = random.Random(4)
    labels = rng.choices([0, 1, 2], [1, 6, 13], k=500)
    out = sp.stratified_split(frame(spark, labels)).collect()
    assert {r.doc_id: r.split for r in out} == brute(labels)


def test_same_split_under_any_partitioning(spark):
    labels = random.Random(5).choices([0, 1], [1, 9], k=400)
    df = frame(spark, labels)
    wanted = brute(labels)
    for n in (1, 4, 200):
        assert {r.doc_id: r.split for r in sp.stratified_split(df.repartition(n)).collect()} == wanted


def test_seed_changes_the_split(spark):
    df = frame(spark, [0] * 100)
    first, second = (sp.stratified_split(df, seed=s).filter("split = 'test'").collect() for s in (42, 7))
    assert len(first) == len(second) == 15
    assert {r.doc_id for r in first} != {r.doc_id for r in second}


def test_tiny_classes_and_empty_input(spark):
    out = sp.stratified_split(frame(spark, [0] * 20 + [1])).collect()
    assert sum(r.split == "test" for r in out) == 4 and len(out) == 21
    assert sp.stratified_split(frame(spark, [0, 1]).filter("doc_id < 0")).collect() == []


def test_predefined_and_carved(spark):
    rows = [(i, i % 2, "test" if i < 20 else "train") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, label_id int, split string")
    carved = sp.carve_validation(sp.predefined_split(df)).collect()
    assert Counter(r.split for r in carved) == {"train": 68, "val": 12, "test": 20}
    assert all(r.split == "test" for r in carved if r.doc_id < 20)
    given = df.replace({"test": "validation"}, subset="split")
    kept = sp.carve_validation(sp.predefined_split(given)).collect()
    assert Counter(r.split for r in kept) == {"train": 80, "val": 20}


def test_overlap_is_found(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val")], "doc_id long, split string")
    assert tuple(sp.overlapping_keys(rows).first()) == (2, 1)


def test_unknown_mode(spark):
    df = spark.createDataFrame([(1, "abcd", "hate")], "doc_id long, text string, label string")
    with pytest.raises(ValueError):
        prepare.preprocess(df, HARM, mode="random")


def test_shared_texts(spark):
    rows = [(1, "a", "train"), (2, "a", "test"), (3, "b", "train"), (4, "b", "train"), (5, "c", "val"), (6, "a", "train")]
    df = spark.createDataFrame(rows, "doc_id long, text string, split string")
    assert tuple(sp.shared_texts(df).first()) == (3, 1, 3)
    assert tuple(sp.shared_texts(df.limit(0)).first()) == (0, 0, 0)
