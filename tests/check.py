"""Run registered queries against their reference SQL in DuckDB."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (2, "nan" if math.isnan(f) else f"{f + 0.0:.6g}" if abs(f) < 1e9 else repr(f))
    if isinstance(v, (list, tuple)):
        return (3, str([_norm(x) for x in v]))
    if isinstance(v, dict):
        return (3, str([(k, _norm(x)) for k, x in sorted(v.items())]))
    return (4, str(v))


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    """``None`` when both sides agree, else what differs."""
    df = fn(spark, sf)
    got = [r.asDict(recursive=True) for r in df.collect()]
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = [dict(zip(cols, r)) for r in rel.fetchall()]
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    names = sorted(cols)
    a = sorted(tuple(_norm(r[c]) for c in names) for r in got)
    b = sorted(tuple(_norm(r[c]) for c in names) for r in want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck = {d[0]: str(d[1]).lower() for d in rel.description}
    same = {"int": "integer", "bigint": "bigint", "double": "double", "string": "varchar", "timestamp_ntz": "timestamp", "boolean": "boolean"}
    odd = {c: (types[c], duck[c]) for c in names if same.get(types[c], types[c]) != duck[c]}
    return f"(types) {odd}" if odd else None


def main(argv):
    import sys

    from pyspark.sql import SparkSession

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = oracle(sf), e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, fn, sqls[name], sf)
                kind = "ok" if msg is None else msg
            else:
                kind = f"rows={len(fn(spark, sf).collect())}"
        except Exception as ex:  # report and go on
            kind = f"ERROR {type(ex).__name__}: {str(ex)[:1500]}"
        bad += kind != "ok" and not kind.startswith("rows")
        print(f"{name:40s} {time.time() - t:6.2f}s {kind}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
