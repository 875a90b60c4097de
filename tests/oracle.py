"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_plain(x)}" for k, x in sorted(v.items())) + "}"
    return "null" if v is None else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(_plain(r[i]) for i in order) for r in rows)


def _asdict(v):
    if hasattr(v, "asDict"):
        return {k: _asdict(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [_asdict(x) for x in v]
    return v


def compare(spark, con, name: str, sf_dir: str, query, sql: str | None) -> str:
    t = time.time()
    df = query(spark, sf_dir)
    got = [tuple(_asdict(v) for v in r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"ROWS {name}: {len(got)} rows, {took:.1f}s"
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t
    if sorted(names) != sorted(df.columns):
        return f"FAIL {name}: columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"FAIL {name}: {len(a)} vs {len(b)} rows\n   spark {str(only_a)[:600]}\n   sql   {str(only_b)[:600]}"
    return f"ok   {name}: {len(a)} rows, {took:.1f}s (sql {sql_took:.1f}s)"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from retrievo import plans
    from retrievo.plans import registry
    from retrievo.session import build_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    if wanted and wanted[0].startswith("@"):
        import importlib
        for m in wanted.pop(0)[1:].split(","):
            importlib.import_module(f"retrievo.plans.{m}")
    else:
        plans.load()
    session = build_session(cores=8)
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    for n, fn in registry.QUERIES.items():
        if not wanted or n in wanted:
            try:
                print(compare(session, con, n, sf_dir, fn, registry.SQL.get(n)), flush=True)
            except Exception as e:
                print(f"ERR  {n}: {type(e).__name__} {str(e)[:1500]}", flush=True)
