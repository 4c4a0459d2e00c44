"""Runs registered queries beside their SQL. `python tests/oracle.py [sf] [name...]`."""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _kind(t: str) -> str:
    t = str(t).lower()
    for names, kind in ((("bigint", "long", "int64"), "long"), (("integer", "int"), "int"),
                        (("double",), "double"), (("float",), "float"), (("varchar", "string"), "string"),
                        (("bool",), "boolean"), (("timestamp",), "timestamp")):
        if any(t.startswith(n) for n in names):
            return kind
    return t


def compare(spark, con, name, fn, sql, sf):
    """None when both sides agree, else what differs."""
    df = fn(spark, sf)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    types = {c: _kind(t) for c, t in df.dtypes}
    if sql is None:
        return None if len(got) > 0 else "no rows"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want_types = {d[0]: _kind(d[1]) for d in res.description}
    want_columns, want = _rows(names, res.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} vs {want_columns}"
    if types != want_types:
        return "types " + str({c: (types[c], want_types[c]) for c in types if types[c] != want_types[c]})
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} differ in {got_columns}: {bad[0][0]} vs {bad[0][1]}"[:900]
    if not got:
        return "no rows on either side"
    return None


def main():
    from proofmill.session import local_session
    import __spark_entry__ as E
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in args if not a.startswith("/")]
    spark = local_session(8, "oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = E.queries(), E.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {'sql ' if name in oracles else 'rows'} "
              f"{time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
