"""Repair of conversations against trying every edit."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from civitext.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
_NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired turns) of the best edits; ``rows`` are (role, text, fault)."""

    def follows(out, letter):
        return (out, letter) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @cache
    def best(at, out, inserts):
        """From a row and the last letter, with so many inserts before the next row: three never pay."""
        found = [(0, "", ())] if at == len(rows) and out in ("", "a") else []

        def edit(letter, price, then, turn):
            cost, audit, turns = then
            found.append((cost + price, letter + audit, (*turn, *turns)))

        for role in "ua":
            if inserts and follows(out, role):
                edit("I", 3, best(at, role, inserts - 1), [f"{_NAMES[role]}:"])
        if at < len(rows):
            role, text, fault = rows[at]
            late = 3 * (fault == "truncated")
            edit("D", 4, best(at + 1, out, 2), [])
            if fault not in ("blank", "duplicate"):
                if follows(out, role[:1]):
                    edit("K", late, best(at + 1, role[:1], 2), [f"{role}:{text}"])
                for new in "ua":
                    if follows(out, new):
                        edit("R", 3 + late, best(at + 1, new, 2), [f"{_NAMES[new]}:{text}"])
        return min(found, default=(10**9, "", ()))

    return best(0, "", 2)


def longhand(rows):
    """The same without memory, for short conversations: every list of edits up to a number of inserts."""
    found = []

    def walk(at, out, cost, audit, turns, inserts):
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit, tuple(turns)))
        if inserts:
            for letter in "ua":
                walk(at, out + letter, cost + 3, audit + "I", [*turns, f"{_NAMES[letter]}:"], inserts - 1)
        if at == len(rows):
            return
        role, text, fault = rows[at]
        late = 3 * (fault == "truncated")
        walk(at + 1, out, cost + 4, audit + "D", turns, inserts)
        if fault not in ("blank", "duplicate"):
            walk(at + 1, out + role[:1] if role else out + "?", cost + late, audit + "K", [*turns, f"{role}:{text}"], inserts)
            for letter in "ua":
                walk(at + 1, out + letter, cost + 3 + late, audit + "R", [*turns, f"{_NAMES[letter]}:{text}"], inserts)

    walk(0, "", 0, "", [], 3)
    return min(found)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows, solve=cheapest, ids=None):
    out = {}
    for conv in {r[0] for r in rows} if ids is None else ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in own:
            stripped = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[0][:1] for r in faulty]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = solve(faulty)
        counts = [sum(f == k for *_, f in faulty) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def some(seed, conversations, longest, roles=("user", "assistant", "system", "tool", "User", "", None)):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why ", "what?\n", "cut off", "", " \t", "Añadir más…", None, "So it is. "]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, -turn]), role, f"{rng.choice(texts[:4])}" if rng.random() < 0.3 else f"{conv} {turn}{rng.choice(['.', '?', ' ', ', and'])}" if rng.random() < 0.7 else rng.choice(texts)))
    return rows


def collected(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("batch", [10000, 7])
def test_report_equals_every_edit(spark, batch):
    rows = some(1, 150, 9) + [(None, None, None, None), (None, 4, "user", "Hi."), (900, 1, "user", "x" * 100000), (901, -(2**63), "user", "a."), (901, 2**63 - 1, "assistant", "b.")]
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = collected(cr.report(spark.createDataFrame([(*r, 0, "z") for r in rows], SCHEMA + ", place int, fault string")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = expected(plain)
    wanted[901] = (2**63 - 1, *wanted[901][1:])
    assert got == wanted


def test_cheapest_equals_longhand():
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in some(5, 60, 4)]
    assert expected(rows) == expected(rows, longhand)


def test_query_on_damaged_rows(spark, tmp_path):
    rows = some(2, 300, 8, ("system", "user")) + [(5000 + i, 0, "user", "One.") for i in range(60)]
    rows += [(None, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = collected(cr.op11_conversation_repair(spark, str(tmp_path)))
    wanted = expected(damaged(rows), ids={r[0] for r in rows})
    assert got == wanted
    gone = [v for c, v in got.items() if c and c >= 5000 and v[-2] == ""]
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in gone


def test_sql_gives_the_same(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    relation = con.sql(cr.OP11_SQL)
    wanted = {r[0]: r[1:] for r in relation.fetchall()}
    df = cr.op11_conversation_repair(spark, sf_dir)
    assert df.columns == relation.columns
    assert collected(df) == wanted


def test_repair_returns_the_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Hello."), (1, 3, "user", "Still there?"), (2, 0, "tool", "x.")]
    got = sorted(tuple(r) for r in cr.repair(spark.createDataFrame(rows, SCHEMA)).collect() if r.conv_id == 1)
    assert [r[2] for r in got] == list("KKDR") and [r[4] for r in got if r[2] != "D"] == ["system", "user", "assistant"]
    assert got[3] == (1, 3, "R", 3, "assistant", "Still there?", "user", None) and got[2][7] == "duplicate"


def test_one_long_conversation_in_small_batches(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["tool", "user", "assistant"]), f"{t}{rng.choice(['.', ''])}") for t in range(4000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = collected(cr.report(spark.createDataFrame(rows, SCHEMA)))[7]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == 0 and len(got[6]) >= 4000 and got[5] == sum({"D": 4, "I": 3, "R": 3, "K": 0}[x] for x in got[6]) + 3 * sum(x in "KR" and not rows[i][3].endswith(".") for i, x in enumerate(got[6].replace("I", "")))


def test_no_rows_and_one_shuffle_of_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.report(empty).count() == 0 and cr.repair(empty).count() == 0 and cr.report(cr.damage(empty)).count() == 0
    plan = cr.report(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
