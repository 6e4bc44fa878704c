import random
import statistics

import numpy as np

from civitext.operators import profile


def texts(spark, values):
    rows = [("d", i, v, "ab"[i % 2]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, doc_id long, text string, label string")


def test_histogram_and_median_equal_numpy(spark):
    rng = random.Random(11)
    for lengths in ([rng.randint(1, 300) for _ in range(500)], [7] * 9, [0, 40, 80, 41, 42], [3, 4]):
        values = ["x" * n for n in lengths] + [None]
        frequencies = profile.length_frequencies(texts(spark, values))
        bins = sorted(profile.length_histogram(frequencies).collect(), key=lambda r: r.bin)
        counts, edges = np.histogram(lengths, bins=40)
        assert [r.n for r in bins] == counts.tolist()
        assert np.allclose([r.lower for r in bins] + [bins[-1].upper], edges, atol=1e-4)
        row = profile.length_median(frequencies).first()
        assert (row.n, row.median_length) == (len(lengths), statistics.median(lengths))


def test_samples_are_reproducible_and_cut(spark):
    df = texts(spark, ["y" * 200 for _ in range(60)] + [None] * 4)
    first = sorted(map(tuple, profile.sample_per_class(df, 3).collect()))
    again = sorted(map(tuple, profile.sample_per_class(df.repartition(7), 3).collect()))
    assert first == again
    assert [(x[0], x[1]) for x in first] == [(c, k) for c in "ab" for k in (1, 2, 3)]
    assert all(x[3] == "y" * 120 for x in first)
    assert sorted(map(tuple, profile.sample_per_class(df, 3, seed=1).collect())) != first


def test_distribution_sums_to_all_rows(spark):
    df = texts(spark, ["a"] * 7)
    out = {r.label: (r.n, r.pct) for r in profile.label_distribution(df).collect()}
    assert out == {"a": (4, 57.1), "b": (3, 42.9)}


def test_summary_reports_empty_sets(spark):
    df = texts(spark, ["a"])
    out = {r.dataset: (r.status, r.rows) for r in profile.dataset_summary({"x": df, "y": df.filter("false")}).collect()}
    assert out == {"x": ("LOADED", 1), "y": ("NOT LOADED", 0)}


def test_coverage(spark):
    df = texts(spark, ["ሰላም ab", "xyz", "", None, "ሰሰ"])
    out = {r.label: tuple(r)[1:] for r in profile.script_coverage(df, "label").collect()}
    # rows 0, 2, 4 are "a"; row 1 is "b"; row 3 has no text
    assert out == {"a": (3, 8, 5, 0.625, 3), "b": (1, 3, 0, 0.0, 0)}


def test_sketches_of_parts_merge_to_the_whole(spark):
    rng = random.Random(21)
    rows = [("d", rng.choice("ab"), rng.choice(["x", "y", "z"]), "w" * int(rng.paretovariate(1.1) * 20 % 5000)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "dataset string, split string, label string, text string")
    parts = profile.length_sketches(df, ["dataset", "split", "label"])
    assert parts.count() == 6 and sum(r.n for r in parts.collect()) == 6000
    for share in (0.1, 0.5, 0.9):
        for by in (["dataset"], ["dataset", "split"]):
            estimated = profile.sketch_quantile(profile.merge_sketches(parts, by), share)
            for r in estimated.collect():
                own = sorted(len(t) for d, s, _, t in rows if "split" not in by or s == r.split)
                low, high = (sum(test(n) for n in own) / len(own) for test in (lambda n: n < r.length, lambda n: n <= r.length))  # noqa: B023
                assert low - profile.RANK_ERROR <= share <= high + profile.RANK_ERROR and r.n == len(own)
    estimated = profile.sketch_quantile(profile.merge_sketches(parts, ["dataset"]), 0.5)
    assert profile.rank_error(estimated, profile.length_frequencies(df)).first().rank_error <= profile.RANK_ERROR
    assert profile.merge_sketches(profile.length_sketches(df.limit(0), ["dataset"]), ["dataset"]).count() == 0
