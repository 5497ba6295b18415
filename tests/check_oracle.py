"""Run named queries against their DuckDB SQL: ``python tests/check_oracle.py [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), "" if v is None else repr(v)) for v in row)


def _norm(v):
    # A negative zero prints and hashes differently, so it counts as different here too.
    return "-0.0" if isinstance(v, float) and v == 0 and math.copysign(1, v) < 0 else v


def compare(spark_rows, spark_cols, sql_rows, sql_cols):
    """Empty string when equal, else the first difference."""
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(sql_cols)}"
    cols = sorted(spark_cols)
    pick = lambda rows, names: sorted(
        (tuple(_norm(row[names.index(c)]) for c in cols) for row in rows), key=_key
    )
    a, b = pick(spark_rows, spark_cols), pick(sql_rows, sql_cols)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; spark-only {list(set(a) - set(b))[:2]} sql-only {list(set(b) - set(a))[:2]}"
    for x, y in zip(a, b):
        if x != y and not all(
            p == q or (isinstance(p, float) and isinstance(q, float) and math.isnan(p) and math.isnan(q))
            for p, q in zip(x, y)
        ):
            only_a, only_b = list(set(a) - set(b)), list(set(b) - set(a))
            return f"{cols}: {len(only_a)} rows differ; e.g. {sorted(only_a, key=_key)[:2]} vs {sorted(only_b, key=_key)[:2]}"
        for p, q in zip(x, y):
            if type(p) is not type(q):
                return f"types {cols}: {x} vs {y}"
    return ""


def main(names):
    import __spark_entry__ as catalog
    from wattledger.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = connect(sf_dir)
    queries, sql = catalog.queries(), catalog.oracle_sql()
    failed = []
    chosen = [q for q in queries if not names or any(q == n or q.startswith(n) for n in names)]
    for name in chosen:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            rows = [tuple(row) for row in df.collect()]
            took = time.time() - t
            if name not in sql:
                print(f"ROWS {name}: {len(rows)} rows {took:.1f}s", flush=True)
                continue
            cur = con.execute(sql[name])
            cols = [d[0] for d in cur.description]
            diff = compare(rows, df.columns, cur.fetchall(), cols)
            print(f"{'OK  ' if not diff else 'DIFF'} {name}: {len(rows)} rows {took:.1f}s {diff[:900]}", flush=True)
            if diff:
                failed.append(name)
        except Exception as e:
            failed.append(name)
            text = str(e)
            print(f"FAIL {name}: {type(e).__name__} {text[:1200]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(chosen) - len(failed)}/{len(chosen)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
