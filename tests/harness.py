"""Run a named query in Spark and its SQL in DuckDB and compare the two tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{round(v, 6) + 0.0:.6f}"
    return str(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(_cell(row[i]) for i in order) for row in rows])


_SAME = {
    "HUGEINT": "bigint", "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "FLOAT": "float",
}


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else what differs first."""
    df = query(spark, sf_dir)
    got_names, got = table_of(df.columns, [tuple(x) for x in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want_names, want = table_of(names, res.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    for name, kind in df.dtypes:
        if _SAME.get(kinds[name], kinds[name]) != kind or kinds[name] == "HUGEINT":
            return f"type of {name}: spark {kind}, sql {kinds[name]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference (of columns {got_names}):\n  spark {a}\n  sql   {b}"
    return None if got else "both empty"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from conftest import make_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = 0
    for name in wanted:
        t = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, queries[name], sqls[name], sf)
            else:
                problem = None if queries[name](spark, sf).collect() else "empty"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - t:6.2f}s {name}{'' if name in sqls else ' (rows only)'}")
        if problem:
            print("   ", problem[:1500])
    print("bad:", bad, "of", len(wanted))
