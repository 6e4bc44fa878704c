"""Near duplicates and nearest neighbours of vectors against brute force."""

import numpy as np
import pytest

from civitext.llm import ann_search as ann
from civitext.llm import embedding_dedup as ed
from civitext.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def union(n_ids, links):
    root = {i: i for i in n_ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in n_ids}


def brute(rows, threshold=0.98):
    ok = [r for r in rows if r[2] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    x = [np.array(np.float32(r[1]), np.float64) for r in ok]
    links, n = [], {id(r): 0 for r in ok}
    for i in range(len(ok)):
        for j in range(i):
            if ok[i][2] == ok[j][2] and len(x[i]) == len(x[j]) and (x[i] * x[j]).sum() / (np.sqrt((x[i] * x[i]).sum()) * np.sqrt((x[j] * x[j]).sum())) >= threshold:
                links.append((ok[i][0], ok[j][0]))
                n[id(ok[i])] += 1
                n[id(ok[j])] += 1
    roots = union({r[0] for r in rows}, links)
    return sorted((r[0], n.get(id(r), 0), roots[r[0]], roots[r[0]] == r[0]) for r in rows)


def clusters(seed, n=120, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.12, 0.15])
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 8)])
def test_near_duplicates_equal_brute_force(spark, seed, block):
    rows = clusters(seed)
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [nan] + [1.0] * 23, 1), (503, [inf] * 24, 1), (504, [None] + [1.0] * 23, 1)]
    rows += [(505, rows[0][1], None), (506, rows[0][1][:5], rows[0][2]), (507, [2 * c for c in rows[0][1]], rows[0][2]), (508, rows[0][1], rows[0][2])]
    rows += [(700 + i, rows[3][1], rows[3][2]) for i in range(30)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", rep string")
    got = sorted(tuple(r) for r in ed.near_duplicates(docs, block=block).collect())
    assert got == brute(rows)


def test_near_duplicates_without_rows_or_ids(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)]
    got = sorted((tuple(r) for r in ed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(4, 1, 4, True), (4, 1, 4, True), (None, 0, None, True), (None, 0, None, True)]


def test_codes_lose_no_pair_and_estimate_without_bias():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64))
    x[1::2] = x[::2] + rng.normal(size=(200, 64)) * 0.2
    pairs = np.array([(i, j) for i in range(400) for j in range(i)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = (u[pairs[:, 0]] * u[pairs[:, 1]]).sum(1)
    assert (ed.linked_pairs(x, pairs, 0.98) == (exact >= 0.98)).all() and (exact >= 0.98).sum() > 20
    packed, factor = ed.encode(u)
    assert packed.shape == (400, 8) and packed.dtype == np.uint8
    codes, turned = ed.decode(packed, 64), u @ ed.rotation(64, 0).T
    assert np.allclose((codes * turned).sum(1), factor)
    possible = set(zip(*map(np.ndarray.tolist, ed.possible_pairs(codes, factor, turned, 0.98))))
    assert {tuple(p) for p in pairs[exact >= 0.98].tolist()} <= possible and len(possible) < 0.5 * 400 * 400
    errors = []
    for k in range(300):
        p = ed.rotation(64, 1000 + k)
        o, q = p @ u[0], p @ u[2]
        errors.append((np.sign(o) @ q) / (np.sign(o) @ o) - u[0] @ u[2])
    assert abs(np.mean(errors)) < 3 * np.std(errors) / np.sqrt(len(errors))


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 60), (60, 80), (80, 100), (200, 200), (5, 1)] + [(300, 301 + i) for i in range(40)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [p for p in links if p[0] != p[1]]
    expected = union({i for p in links for i in p}, links)
    assert got == expected


def nearest(rows, every=20, k=20):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    out = {}
    for r in ok:
        if r[0] % every == 0:
            q = np.array(np.float32(r[1]), np.float64)
            scored = sorted((-(np.array(np.float32(o[1]), np.float64) * q).sum(), o[0]) for o in ok if o[0] != r[0])
            out[r[0]] = [(v, -s) for s, v in scored[:k]]
    return out


def test_search_on_whole_table_has_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    got = {}
    for r in ann.op4_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == sorted(queries)
    met = 0
    for i in queries:
        scores = x @ x[ids == i][0]
        scores[ids == i] = -np.inf
        best = set(ids[np.argsort(-scores)[:20]].tolist())
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - scores[ids == m[1]][0]) < 1e-9 for m in mine) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        met += len(best & {m[1] for m in mine})
    assert met >= 0.95 * 20 * len(queries)


def test_search_ties_nulls_repeats_and_few_rows(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0], 0) for i in range(30, 0, -1)] + [(40, [3.0, 1.0], 0), (41, None, 0), (42, [nan, 1.0], 0), (60, [0.0, 0.0], 0), (None, [9.0, 9.0], 0), (43, [1.0], 0), (40, [3.0, 1.0], 0)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wide = [r for r in rows if r[1] is None or len(r[1]) == 2]
    assert {q: [v[1:] for v in sorted(vs)] for q, vs in got.items()} == nearest(wide)
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in ann.search(spark.createDataFrame([(20, [1.0], 0), (3, [2.0], 0)], SCHEMA)).collect()] == [(20, 1, 3, 2.0)]


def test_scan_abandons_most_candidates_early():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    exact = np.sort(x[1:] @ x[0])[::-1]
    for least in (exact[40], -np.inf):
        query, ids, score, full = ann.scan(np.arange(2000), ann.prepare(x), np.array([0]), ann.prepare(x[:1]), np.array([least]))
        assert np.allclose(score, exact[:20]) and (query == 0).all() and np.allclose(x[ids] @ x[0], score)
        assert full < (100 if np.isfinite(least) else ann.CHUNK + 200)  # without a start, all of the first chunk


def test_tests_keep_near_candidates():
    """Vectors that agree in direction, for which the rest of a product is far from that of random directions."""
    rng = np.random.default_rng(14)
    centre = rng.normal(size=64)
    x = centre * rng.uniform(0.5, 2, size=(4000, 1)) + rng.normal(size=(4000, 64)) * 0.2
    exact = np.sort(x[1:] @ x[0])[::-1]
    query, ids, score, full = ann.scan(np.arange(4000), ann.prepare(x), np.array([0]), ann.prepare(x[:1]), np.array([exact[25]]))
    assert np.allclose(score, exact[:20]) and full < 400
    gone = 0
    for _ in range(200):
        turned = ann.rotation(64, int(rng.integers(1 << 30))) @ (x[1] - x[2])
        squares = np.cumsum(turned * turned)
        gone += any(squares[m - 1] > ann.share_bound(m, 64) * squares[-1] * (1 + 1e-9) for m in (16, 32, 48, 64))
    assert gone == 0


def test_equal_scores_across_chunks_go_by_id():
    x = np.tile([[1.0, 2.0]], (3000, 1))
    ids = np.random.default_rng(5).permutation(3000)
    query, found, _, _ = ann.scan(ids, ann.prepare(x), np.array([7, -1]), ann.prepare(x[:2]), np.full(2, -np.inf))
    assert found[query == 0].tolist() == [i for i in range(21) if i != 7] and found[query == 1].tolist() == list(range(20))


def spread_out(seed, norms):
    """20,000 rows in 300 clusters, more than the sample of the index."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(300, 64))
    if norms:
        centres *= rng.lognormal(0, 0.7, size=(300, 1))
    return centres[rng.integers(300, size=20_000)] + rng.normal(size=(20_000, 64)) * 0.3


@pytest.mark.parametrize("norms", [False, True])
def test_recall_beyond_the_sample(spark, norms):
    x = np.float32(spread_out(6, norms))
    rows = [(i, v, 0, -1, "x") for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, SCHEMA + ", list int, query string").repartition(8)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float64)
    queries = np.arange(0, 20_000, 20)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-scores, 1)[:, :20]
    assert sorted(got) == queries.tolist() and all([m[0] for m in sorted(g)] == list(range(1, 21)) for g in got.values())
    met = [len(set(best[i]) & {m[1] for m in got[q]}) for i, q in enumerate(queries.tolist())]
    assert sum(met) >= 0.95 * 20 * len(queries)
    assert all(abs(m[2] - x[q] @ x[m[1]]) < 1e-9 for q in (0, 20, 400) for m in got[q])
