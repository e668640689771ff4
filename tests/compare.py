"""Runs queries and their SQL twins on the same Parquet tables and compares rows as multisets."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def cell(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(cell(y) for y in x.asDict().values())
    return x


def duck(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def compare(spark, c, name, f, sql, d) -> str | None:
    """None if equal, else what differs."""
    df = f(spark, d)
    cols = sorted(df.columns)
    mine = Counter(tuple(cell(x) for x in r) for r in df.select(*cols).collect())
    cur = c.execute(f"SELECT * FROM ({sql})")
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(k) for k in cols]
    kinds = {k: t for k, t in df.dtypes}
    dk = {x[0]: str(x[1]) for x in cur.description}
    theirs = Counter(tuple(cell(r[i]) for i in order) for r in cur.fetchall())
    if mine != theirs:
        return f"{sum(mine.values())} rows against {sum(theirs.values())}; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
    want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    odd = [(k, kinds[k], dk[k]) for k in cols if kinds[k] in want and want[kinds[k]] != dk[k]]
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e
    from tessera.session import build_session

    d = sys.argv[1]
    spark = build_session(master=os.environ.get("COMPARE_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    c, q, o = duck(d), e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or q:
        t = time.time()
        try:
            why = compare(spark, c, n, q[n], o[n], d) if n in o else f"(no SQL) {q[n](spark, d).count()} rows"
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:700]}"
        print(f"{n}: {why or 'ok'} {time.time() - t:.1f}s", flush=True)
