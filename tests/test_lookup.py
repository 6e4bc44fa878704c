"""Token tables that are too large to broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from civitext.operators import lookup

TIGHT = {"max_rows": 5, "max_bytes": 100, "salts": 3}


def case(spark, seed=2, n=4000):
    """Half of all tokens are one word that is not in the table."""
    rng = random.Random(seed)
    table = [(f"w{i}", [i, -i], 1 + 1000 // (i + 1)) for i in range(600)]
    rows = [(rng.randrange(200), "unheard of" if rng.random() < 0.5 else rng.choice([f"w{int(rng.paretovariate(0.5)) % 700}", f"x{rng.randrange(300)}", None])) for _ in range(n)]
    counts = spark.createDataFrame(table, "token string, w array<long>, total long")
    tokens = lookup.TokenTable(counts, len(table), 10_000, sum(t for *_, t in table))
    return rows, {t: (w, n) for t, w, n in table}, spark.createDataFrame(rows, "doc_id long, token string"), tokens


def test_join_equals_the_small_path(spark):
    rows, table, df, tokens = case(spark)
    wanted = sorted(((k, t, *table.get(t, (None, None))) for k, t in rows), key=str)
    for limits in ({}, TIGHT):
        got = [(r.doc_id, r.token, r.w, r.total) for r in lookup.join_tokens(df, tokens, **limits).collect()]
        assert sorted(got, key=str) == wanted


@pytest.mark.parametrize("bits, size", [(16, 64 << 20), (16, 4096), (1, 4096)])
def test_sums_equal_the_small_path_for_any_bitmap(spark, monkeypatch, bits, size):
    monkeypatch.setattr(lookup, "BITS_PER_TOKEN", bits)
    monkeypatch.setattr(lookup, "BITMAP_BYTES", size)
    _, _, df, tokens = case(spark)
    sums = {"a": "coalesce(w[0], 0L)", "b": "coalesce(w[1], 0L)"}
    own = {"tokens": "CAST(1 AS BIGINT)"}
    got = [sorted(map(tuple, lookup.sum_by_key(df, tokens, sums, own=own, **limits).collect())) for limits in ({}, TIGHT)]
    assert got[0] == got[1] and len(got[0]) == 200


def test_unknown_tokens_are_settled_before_the_shuffle(spark):
    """However common an unknown token is, nearly none of its rows is shuffled to the tail."""
    rows, table, df, tokens = case(spark)
    head, tail = lookup._parts(tokens, 5)
    probed = lookup._in_tail(df.join(F.broadcast(head), "token", "left"), tail, tokens)
    by_token = {r.token: r._in_tail for r in probed.select("token", "_in_tail").distinct().collect()}
    in_tail = {t for t, (_, n) in table.items() if n * 5 < tokens.occurrences}
    assert all(by_token[t] for t in by_token if t in in_tail)
    unknown = [t for t in by_token if t is not None and t not in table]
    assert not by_token["unheard of"] and sum(by_token[t] for t in unknown) <= 0.15 * len(unknown)


def test_the_bitmap_is_broadcast_and_bounded(spark):
    _, _, df, tokens = case(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lookup.join_tokens(df, tokens, **TIGHT)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "bitmap_construct_agg" in plan and plan.count("SortMergeJoin") == 1
    huge = lookup.TokenTable(tokens.table, 10**10, 10**12, tokens.occurrences)
    pieces = lookup._in_tail(df, tokens.table, huge)
    assert pieces.count() == df.count()


def test_sums_of_a_large_table_keep_no_lists_and_sort_no_token_rows(spark):
    _, _, df, tokens = case(spark)
    sums, own = {"a": "coalesce(w[0], 0L)"}, {"tokens": "CAST(1 AS BIGINT)"}
    plan = lookup.sum_by_key(df, tokens, sums, own=own, **TIGHT)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_a_token_in_the_tail_counts_as_often_as_it_occurs(spark):
    table = [(f"w{i}", [i, -i], 9 - i) for i in range(8)]
    tokens = lookup.TokenTable(spark.createDataFrame(table, "token string, w array<long>, total long"), 8, 80, 44)
    rows = [(1, "w7")] * 3 + [(1, "w0"), (1, "x"), (1, None), (2, "w6"), (2, "w6"), (3, None), (None, "w7"), (None, "w7")]
    df = spark.createDataFrame(rows, "doc_id long, token string")
    limits = {"max_rows": 2, "max_bytes": 1000, "salts": 2}
    out = lookup.sum_by_key(df, tokens, {"a": "coalesce(w[0], 0L)"}, own={"n": "CAST(1 AS BIGINT)"}, **limits)
    assert {r.doc_id: (r.a, r.n) for r in out.collect()} == {1: (21, 6), 2: (12, 2), 3: (0, 1), None: (14, 2)}


def test_the_head_takes_as_many_tokens_as_may_be_broadcast(spark):
    _, table, df, tokens = case(spark)
    head, tail = lookup._parts(tokens, 50, lookup._least_total(tokens, 50, 1 << 20))
    totals = sorted((n for _, n in table.values()), reverse=True)
    assert sorted((r.total for r in head.collect()), reverse=True) == totals[:50]
    assert tail.count() == len(totals) - 50
    assert lookup._least_total(tokens, 50, 10) is None
    flat = lookup.TokenTable(tokens.table.withColumn("total", F.lit(3).cast("long")), 600, 10_000, 1800)
    assert lookup._least_total(flat, 50, 1 << 20) is None  # equal totals stay together
