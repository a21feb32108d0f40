"""Run registered queries next to their SQL twins: ``python tests/compare.py [sf] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def kind(type_name: str) -> str:
    name = type_name.upper()
    for key, group in (("INT", "int"), ("LONG", "int"), ("DOUBLE", "float"), ("FLOAT", "float"), ("DECIMAL", "decimal"),
                       ("STRING", "text"), ("VARCHAR", "text"), ("DATE", "date"), ("BOOL", "bool"), ("TIMESTAMP", "timestamp")):
        if key in name:
            return group
    return name


def width(type_name: str) -> str:
    return {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string"}.get(type_name.upper(), type_name.lower())


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def sorted_rows(rows, order):
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def differences(spark, con, name, fn, sql, sf):
    """An empty text if the two sides agree, else what differs."""
    df = fn(spark, sf)
    mine = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    types = [(c, t, kinds[c]) for c, t in df.dtypes if width(kinds[c]) != t]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    cols = sorted(names)
    a = sorted_rows(mine, [df.columns.index(c) for c in cols])
    b = sorted_rows(theirs, [names.index(c) for c in cols])
    if a != b:
        off = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(off)} values differ in {cols}: {off[:2]}"
    return f"types {types}" if types else ""


def main() -> int:
    from pyspark.sql import SparkSession

    from fairtender.checks import ORACLES, QUERIES

    args = sys.argv[1:]
    sf = f"/root/testdata/sf{args[0] if args else '0.01'}"
    picked = args[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in picked:
        start = time.time()
        try:
            if name in ORACLES:
                found = differences(spark, con, name, QUERIES[name], ORACLES[name], sf)
            else:
                found = "" if QUERIES[name](spark, sf).collect() is not None else "none"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {'' if name in ORACLES else '(rows)'} {time.time() - start:.2f}s {found}", flush=True)
    print(f"{len(picked) - bad} of {len(picked)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
