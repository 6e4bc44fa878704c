"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows.

``python -m tests.oracle [sf_dir] [query ...]`` checks from the command line.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from civitext import plans

SF_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir: str, name: str) -> list[str]:
    """Differences between the two sides; empty when they agree."""
    df = plans.queries()[name](spark, sf_dir)
    expected = con.execute(plans.oracle_sql()[name])
    wanted_types = {d[0]: str(d[1]) for d in expected.description}
    got_types = {n: _KINDS[t] for n, t in df.dtypes}
    problems = []
    if got_types != wanted_types:
        problems.append(f"types: {got_types} != {wanted_types}")
    got = _rows(df.columns, df.collect())
    wanted = _rows(list(wanted_types), expected.fetchall())
    if len(got) != len(wanted):
        problems.append(f"rows: {len(got)} != {len(wanted)}")
    different = [(a, b) for a, b in zip(got, wanted) if a != b]
    if different:
        a, b = different[0]
        problems.append(f"{len(different)} rows differ, first: {str(a)[:300]} != {str(b)[:300]}")
    return problems


def main(argv: list[str]) -> int:
    from civitext.session import local_session

    sf_dir = argv[0] if argv else SF_DIR
    spark, con = local_session(8), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    names = argv[1:] or [n for n in plans.queries() if n in plans.oracle_sql()]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n     " if problems else "", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
