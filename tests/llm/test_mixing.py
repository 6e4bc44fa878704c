"""Mixing against its SQL (which ranks every quotient) and against its contract."""

import duckdb
import pytest

from civitext.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def run(spark, rows, **options):
    sizes = mixing.sizes_of(spark.createDataFrame(rows, SCHEMA)).cache()
    return [r.asDict() for r in mixing.mix(sizes, **options).collect()]


def sql(rows):
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    return sorted(duckdb.sql(mixing.OP8_SQL).fetchall(), key=str)


def corpus(n=200):
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", "w " * (i * 37 % 400)) for i in range(n)]
    return rows + [(None, None, "a b c"), (3, "s1", None), (4, "s1", ""), (9, None, "x " * 5000), (5, "only empty", " \n"), (7, "s0", "w w"), (7, "s0", "w w")]


def test_equals_sql(spark):
    rows = corpus()
    got = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in run(spark, rows)), key=str)
    assert got == sql(rows)


@pytest.mark.parametrize("shard_words", [1 << 22, 6000])
def test_contract(spark, shard_words):
    rows = corpus()
    got = run(spark, rows, shard_words=shard_words)
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    sources = {r["source"]: r for r in got}
    assert sum(r["target"] for r in sources.values()) == pytest.approx(1.5 * total)
    assert all(r["target"] <= 2 * r["source_size"] and r["taken"] <= 2 * r["size"] for r in got)
    shards = total // shard_words + 1
    for name, s in sources.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == name) - s["target"]) <= 3 * mixing.BLOCK * shards
    for r in got:
        assert r["taken"] == sum((x["stop"] - x["start"]) * x["times"] for x in r["ranges"] or [])


def test_weights_go_by_name_and_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 100), (3, "c", 1000), (4, None, 1000)], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # 3165 words; a (weight 3) stops at 20, b (1) and c (2) and null (3) share the rest: b 524 stops at 200
    assert got["a"] == 20 and got["b"] == 200
    assert got["c"] == pytest.approx((3165 - 220) * 2 / 5) and got[None] == pytest.approx((3165 - 220) * 3 / 5)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_mixed_texts_hold_the_words_taken(spark):
    rows = corpus(40)[:40]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", words int")
    sizes = mixing.sizes_of(docs).cache()
    taken = {r.doc_id: r.taken for r in mixing.mix(sizes).collect() if r.taken}
    out = mixing.mixed_texts(docs, sizes)
    assert out.columns == docs.columns
    assert {r.doc_id: len(r.text.split()) for r in out.collect()} == taken


def test_no_python_in_the_plan(spark):
    plan = mixing.op8_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_query_equals_sql_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted((tuple(r) for r in mixing.op8_mixing(spark, sf_dir).collect()), key=str)
    assert got == sorted(con.execute(mixing.OP8_SQL).fetchall(), key=str)
