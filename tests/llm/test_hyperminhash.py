"""Components of near duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from civitext.llm import hyperminhash as hm
from tests.llm.test_vectors import union

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def set_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [set_of(t) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((rows[i][0], rows[j][0]))
    roots = union({r[0] for r in rows}, links)
    return sorted(((d, len(s), roots[d], roots[d] == d or d is None) for (d, _), s in zip(rows, sets)), key=str)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n int")
    return sorted((tuple(r) for r in hm.near_duplicates(docs, **options).collect()), key=str)


def corpus(seed, n=160):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[pick.choice(words) for _ in range(pick.choice([6, 12, 40, 200, 800]))] for _ in range(12)]
    rows = []
    for d in range(n):
        w = list(pick.choice(bases))
        for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 4, len(w) // 40])):
            w[pick.randrange(len(w))] = pick.choice(words)
        text = " ".join(w)
        rows.append((d * 3 % n, pick.choice([text, text.upper(), text.replace(" ", "\n")])))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 4)])
def test_equals_brute_force(spark, seed, block):
    rows = corpus(seed)
    assert got(spark, rows, block=block) == brute(rows)


def test_linked_pairs_of_short_texts_are_found(spark):
    rows = []
    for seed in range(60):
        # 6 of 7, 12 of 14, 17 of 20 and 34 of 40 shingles, by words at the end; 23 shared and 2 on each side, by a word at both ends
        for n, more in [(10, 1), (16, 2), (21, 3), (38, 6)]:
            w = [f"s{seed}n{n}w{i}" for i in range(n + more)]
            rows += [(len(rows), " ".join(w[:n])), (len(rows) + 1, " ".join(w))]
        w = [f"s{seed}w{i}" for i in range(31)]
        rows += [(len(rows), " ".join(w[:29])), (len(rows) + 1, " ".join(w[2:]))]
    result = got(spark, rows)
    assert result == brute(rows)
    assert sum(not r[3] for r in result) == len(rows) // 2


def test_registers_of_any_size_agree_like_large_sets():
    rng = np.random.default_rng(7)
    for common, own, other in [(6, 0, 1), (12, 0, 2), (34, 0, 6), (57, 5, 5), (340, 30, 30)]:
        drawn = [rng.integers(0, 2**64, common + own + other, dtype=np.uint64) for _ in range(200)]
        sets = [np.sort(s) for x in drawn for s in (x[: common + own], np.concatenate([x[:common], x[common + own :]]))]
        runs, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        keys = hm.band_keys(hm.filled(hm.registers(runs, first), runs, first))
        shared = (keys[::2] == keys[1::2]).sum(1)
        likely = (common / (common + own + other)) ** hm.ROWS
        assert shared.min() > 0 and abs(shared.mean() / hm.BANDS - likely) < 0.03
        assert shared.std() < 1.3 * np.sqrt(hm.BANDS * likely * (1 - likely))


def test_nulls_ties_repeats_and_short_texts(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "b a"), (7, "É é É é É é"), (8, "é é é é é é"), (9, "a b c d e"), (10, "a b c d e")]
    rows += [(None, "a b"), (None, "a b"), (11, long), (12, long + " y"), (13, "q r s t u v w x y z"), (13, "a b"), (4, "a b")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    for n in (50, 400, 20000):
        sets = [np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(40)]
        table = hm.registers(np.concatenate(sets), np.arange(0, 40 * n + 1, n))
        agree = np.mean([((table[i] == table[i + 1]) & (table[i] != 0xFFFF)).mean() for i in range(39)])
        expected = hm._chance(np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(agree - expected) < 0.003
    size = 3000
    for share in (0.7, 0.85, 0.95):
        common = rng.integers(0, 2**63, int(2 * size * share / (1 + share))).astype(np.uint64)
        pair = [np.sort(np.concatenate([common, rng.integers(0, 2**63, size - len(common)).astype(np.uint64)])) for _ in range(2)]
        x, y = hm.registers(np.concatenate(pair), np.array([0, size, 2 * size]))
        assert abs(((x == y) & (x != 0xFFFF)).sum() / (x != 0xFFFF).sum() - share) < 0.09


def test_sizes_of_sets():
    texts = ["", "a", "a b c d", "A B c d e", "a b c d e f", "a a a a a a a a"]
    _, first = hm.shingles(pa.array(texts))
    assert np.diff(first).tolist() == [len(set_of(t)) for t in texts]


def test_query_equals_brute_force_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    result = sorted((tuple(r) for r in hm.op10_minhash_near_dedup(spark, sf_dir).collect()), key=str)
    assert result == brute(rows) and any(not r[3] for r in result)


def test_threshold_of_four_fifths(spark):
    rows, linked = [], set()
    # 4 of 5, 33 of 40, 84 of 100 and 820 of 1,000 shingles link at 80%; 3 of 4, 79 of 100 and 790 of 1,000 do not
    for seed in range(20):
        for n, more, near in [(8, 1, True), (37, 7, True), (88, 16, True), (824, 180, True), (7, 1, False), (83, 21, False), (794, 210, False)]:
            w = [f"s{seed}n{n}w{i}" for i in range(n + more)]
            d = len(rows)
            rows += [(d, " ".join(w)), (d + 1, " ".join(w[:n]))]
            linked |= {d + 1} if near else set()
    assert {r[0] for r in got(spark, rows, percent=80) if not r[3]} == linked
    assert [hm.band_rows(p) for p in (80, 85)] == [6, 8]


def test_only_classes_that_share_a_bucket_get_registers_and_move(spark, monkeypatch):
    written, write = {}, hm.materialise

    def kept(df, name):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(hm, "materialise", kept)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(40))) for i in range(100)]
    # a near copy, and an exact copy under another id and under the same one
    rows += [(200, rows[7][1] + " more"), (201, rows[8][1]), (9, rows[9][1])]
    assert got(spark, rows) == brute(rows)
    assert [t.count() for t in written.values() if "registers" in t.columns] == [2]
