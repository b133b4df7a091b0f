"""Run queries and oracles side by side: ``python -m checks.compare 0.01 [names]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normalised(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None when query and oracle agree, else the first thing that differs."""
    df = QUERIES[name](spark, sf_dir)
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    theirs = rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    ours = df.collect()
    a, b = normalised(df.columns, ours), normalised(columns, theirs)
    if a == b:
        return None
    only_a, only_b = [r for r in a if r not in b][:2], [r for r in b if r not in a][:2]
    return f"rows {len(a)} / {len(b)}; only Spark {only_a}; only SQL {only_b}"


def main() -> None:
    from filewright.session import build_session

    spark = build_session(master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    con = connect(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem = difference(spark, con, name, sf_dir) if name in ORACLES else "no oracle"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {exc}"
        print(f"{name:30s} {time.time() - start:6.1f}s {(problem or 'ok')[:1200]}", flush=True)


if __name__ == "__main__":
    main()
