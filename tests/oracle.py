"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

``python tests/oracle.py [sf] [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _canonical(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return ("num", repr(value if value != int(value) else float(int(value)))) if math.isfinite(value) else (
            "num", repr(value))
    if isinstance(value, int):
        return ("num", repr(float(value)))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(_canonical(v) for v in value))
    return (type(value).__name__, str(value))


def compare(df, con, sql) -> str:
    """'' if equal, else what differs."""
    names = sorted(df.columns)
    left = sorted((tuple(_canonical(row[n]) for n in names) for row in df.collect()), key=repr)
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    if sorted(theirs) != names:
        return f"columns {names} / {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    right = sorted((tuple(_canonical(row[i]) for i in order) for row in cursor.fetchall()), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {a} / {b}"
    types = {d[0]: str(d[1]) for d in con.execute(f"describe {sql}").fetchall()}
    expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if kind in expected and types[name] != expected[kind]:
            return f"type of {name}: {kind} / {types[name]}"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from flowlens.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            if name in oracles:
                outcome = compare(df, con, oracles[name]) or "equal"
            else:
                outcome = f"rows {len(df.collect())} (no sql)"
        except Exception as error:  # noqa: BLE001
            outcome = f"FAILED {type(error).__name__}: {str(error)[:400]}"
        bad += outcome != "equal" and "no sql" not in outcome
        print(f"{time.time() - start:6.1f}s {name}: {outcome}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
