"""Run queries in Spark and their SQL in DuckDB and compare: ``python tests/oracle.py [sf] [names..]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oracle-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v, digits: int | None):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.{digits}g}") if digits else v
    if isinstance(v, int):
        return float(v) if digits else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x, digits) for x in v)
    return v


def rows_of(columns, rows, digits):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def type_notes(df, rel) -> str:
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    off = [f"{c}:{t}/{duck_types[c]}" for c, t in df.dtypes if SAME_TYPE.get(t, t) != duck_types.get(c)]
    return "types " + " ".join(off) if off else ""


def compare(spark, con, fn, sql, sf_dir):
    """(status, number of rows, note); 'exact' also means equal doubles and integer types."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return ("rows", len(got), "")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return ("schema", len(got), f"{sorted(df.columns)} != {sorted(names)}")
    for digits, status in ((None, "exact"), (9, "close")):
        a, b = rows_of(df.columns, got, digits), rows_of(names, want, digits)
        if a == b:
            return (status, len(got), type_notes(df, rel))
    bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return ("DIFFER", len(got), f"{len(a)} vs {len(b)} rows; {sorted(names)} {bad}")


def main() -> None:
    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:] or list(e.queries())
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in wanted:
        t = time.time()
        try:
            status, n, note = compare(spark, con, e.queries()[name], e.oracle_sql().get(name), sf_dir)
        except Exception as ex:  # noqa: BLE001
            status, n, note = "ERROR", 0, str(ex)[:1500]
        bad += status in ("ERROR", "DIFFER", "schema")
        print(f"{name:24s} {status:7s} {n:8d} rows {time.time() - t:6.2f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
