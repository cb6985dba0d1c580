"""Runs the registered queries next to their SQL and compares the results.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def spark_rows(df):
    names = sorted(df.columns)
    table = df.select(*names).toArrow()
    return [(name, str(table.schema.field(name).type)) for name in names], _rows(table, names)


def sql_rows(db, sql):
    table = db.sql(sql).to_arrow_table()
    names = sorted(table.column_names)
    return [(name, str(table.schema.field(name).type)) for name in names], _rows(table, names)


def _rows(table, names):
    rows = zip(*(table.column(name).to_pylist() for name in names), strict=True)
    return sorted(rows, key=lambda row: [(value is not None, value) for value in row])


def main(sf_dir="/root/testdata/sf0.01", *only):
    import __spark_entry__ as contract
    from conftest import make_session

    spark, db = make_session(), connect(sf_dir)
    oracle, bad = contract.oracle_sql(), []
    for name, query in contract.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        schema, rows = spark_rows(query(spark, sf_dir))
        took = time.time() - start
        verdict = "no SQL"
        if name in oracle:
            expected_schema, expected = sql_rows(db, oracle[name])
            same_types = schema == expected_schema
            verdict = "ok" if rows == expected and same_types else "DIFFERENT"
            if verdict != "ok":
                bad.append(name)
                print(schema, expected_schema, rows[:2], expected[:2], len(expected), sep="\n  ")
        print(f"{name:32} {len(rows):8} rows {took:6.2f} s  {verdict}", flush=True)
    print("all equal" if not bad else f"different: {bad}")


if __name__ == "__main__":
    main(*sys.argv[1:])
