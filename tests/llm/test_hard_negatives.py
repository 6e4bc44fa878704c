"""Hard negatives against all products."""

import numpy as np
import pytest

from civitext.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50):
    ok = [(i, [int(np.floor(256 * c)) for c in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and None not in v and np.isfinite(np.array(v, float) * 256).all()]
    out = []
    for anchor in {(i, tuple(v), label) for i, v, label in ok if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, anchor[1])), i, label) for i, v, label in ok if i != anchor[0] and len(v) == len(anchor[1]))
        for p, positive, _ in [s for s in scored if s[2] == anchor[2]][:5]:
            inside = [s for s in scored if s[2] != anchor[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(anchor[0], positive, rank, i, -p, -n) for rank, (n, i, _) in enumerate(inside, 1)]
    return sorted(out)


def clusters(seed, n, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, d))
    return [(i, (centres[rng.integers(25)] * 0.3 + rng.normal(size=d) * rng.choice([0.0, 0.02, 0.2])).tolist(), int(rng.integers(4))) for i in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "block", "group"), [(1, 512, 4096), (2, 8, 32)])
def test_mine_equals_all_products(spark, seed, block, group):
    nan, inf = float("nan"), float("inf")
    rows = clusters(seed, 600)
    d = len(rows[0][1])
    rows += [(1000, None, 1), (1050, [nan] * d, 1), (1100, [inf] * d, 1), (1150, [None] + [1.0] * (d - 1), 1), (1200, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2000 + i, rows[50][1], i % 3) for i in range(120)]  # copies, of which some are anchors
    rows += [(3000, [1.0], 0), (3001, [1.0], 0), (3002, [0.6], 1), (3050, [], 0), (3051, [], 0), (3052, [], 2), (-50, rows[3][1], 2), (50, rows[50][1], rows[50][2]), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", place string, block int")
    got = rows_of(hn.mine(df, block=block, least_group=group))
    assert got == brute(rows) and len(got) > 200 and any(r[0] == 3050 for r in got) and any(r[0] == -50 for r in got)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(25 * i, (rng.integers(-(2**28), 2**28, size=6) / 256).tolist(), i % 2) for i in range(60)]
    assert rows_of(hn.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_query_and_sql_on_a_table(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    relation = con.sql(hn.OP12_SQL)
    df = hn.op12_hard_negatives(spark, sf_dir)
    assert df.columns == relation.columns and rows_of(df) == sorted(relation.fetchall())


def test_no_rows_or_no_positives(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], SCHEMA)).count() == 0
    assert hn.mine(spark.createDataFrame([(50, [1.0], 1), (52, [-1.0], 1), (51, [-0.7], 2)], SCHEMA)).count() == 0


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (1, 4)])
def test_hilbert_places_are_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    place = hn.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_are_safe_and_rule_blocks_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, size=(30, 12))
    blocks = [c + rng.integers(-20, 20, size=(40, 12)) for c in centres]
    anchors = np.concatenate([b[:2] for b in blocks]).astype(float)
    low, high = np.array([b.min(0) for b in blocks], float), np.array([b.max(0) for b in blocks], float)
    least, most = hn.bounds(anchors, low, high)
    scores = [anchors @ b.T for b in blocks]
    assert all((s.min(1) >= least[:, i]).all() and (s.max(1) <= most[:, i]).all() for i, s in enumerate(scores))
    fifth = np.sort(np.concatenate(scores, axis=1), 1)[:, -5]
    assert (most >= fifth[:, None]).mean() < 0.2
