"""Run registered queries against their SQL twins and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(list(v.asDict().values()))
    if isinstance(v, dict):
        return _norm(sorted(v.items()))
    return str(v)


def _kind(v):
    return type(v).__name__


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    raw = cur.fetchall()
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}", len(got)
    idx = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in raw]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    for c in range(len(cols)):
        a = {_kind(r[c]) for r in got if r[c] is not None}
        b = {_kind(r[c]) for r in want if r[c] is not None}
        if a != b and a and b and not ({"Row", "dict"} & (a | b)):
            return f"types of {cols[c]}: {a} vs {b}", len(got)
    g = sorted("|".join(_norm(v) for v in r) for r in got)
    w = sorted("|".join(_norm(v) for v in r) for r in want)
    bad = [(x, y) for x, y in zip(g, w) if x != y]
    if bad:
        return f"{len(bad)} rows differ; first {cols}:\n   {bad[0][0]}\n   {bad[0][1]}", len(got)
    return None, len(got)


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from levelloom.session import get_spark

    sf = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("sf"):
        sf = f"/root/testdata/{argv.pop(0)}"
    spark = get_spark(cores=8)
    con = connect(sf)
    qs, os_ = E.queries(), E.oracle_sql()
    names = [n for n in qs if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    fails = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            if n in os_:
                msg, rows = compare(df, con, os_[n])
                state = "ok" if msg is None else "FAIL " + msg
            else:
                rows = df.count()
                state = "rows-only"
        except Exception as e:  # noqa: BLE001
            state, rows = "ERROR " + str(e)[:1500], -1
        fails += state.startswith(("FAIL", "ERROR"))
        print(f"{n:34s} {rows:8d} {time.time() - t:6.2f}s {state}", flush=True)
    print("failures:", fails, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
