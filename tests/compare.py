"""Run queries against their SQL in DuckDB: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def kind(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.date().isoformat() if value == value.normalize() else value.isoformat()
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return str(value) if isinstance(value, (list, dict)) else value


def rows(frame):
    cols = sorted(frame.columns)
    data = [tuple(kind(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(data, key=lambda r: tuple((x is None, str(type(x).__name__ not in ("int", "float")), x if isinstance(x, (int, float)) else 0, str(x)) for x in r))


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set threads=8")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    t0 = time.time()
    got_df = query(spark, sf_dir)
    got = pd.DataFrame([r.asDict() for r in got_df.collect()], columns=got_df.columns)
    t1 = time.time()
    if sql is None:
        return f"ROWS {name}: {len(got)} rows {t1 - t0:.1f}s {list(got.columns)}"
    rel = con.sql(sql)
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns)
    gc, gr = rows(got)
    wc, wr = rows(want)
    types = dict(zip(rel.columns, map(str, rel.types)))
    if gc != wc:
        return f"FAIL {name}: columns {set(gc) ^ set(wc)}"
    head = f"{len(gr)} rows {t1 - t0:.1f}s duck {time.time() - t1:.1f}s"
    odd = [f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in got_df.schema.fields if not same_type(f.dataType.simpleString(), types[f.name])]
    note = f" TYPES {odd}" if odd else ""
    if gr == wr:
        nulls = [c for c in gc if got[c].isna().all()] if len(got) else ["EMPTY"]
        return f"ok   {name}: {head}{note}" + (f" ALLNULL {nulls}" if nulls else "")
    diff = [(a, b) for a, b in zip(gr, wr) if a != b][:3]
    return f"FAIL {name}: {head} vs {len(wr)} rows; cols {gc}\n   " + "\n   ".join(f"{a}\n   {b}\n" for a, b in diff)


def same_type(s, d):
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    return pairs.get(s, s) == d


def session():
    import tempfile

    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("crosswise")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="crosswise-compare-")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name, q in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            print(compare(spark, con, sf_dir, name, q, sqls.get(name)), flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"ERR  {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
