"""Compare registered queries with their SQL: python tests/run_check.py [sf_dir] [name ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as entry_module
from quire.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP", "date": "DATE"}


def connect(root):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return repr(v) if v is not None else "\x00"


def compare(spark, con, root, name, fn, sql):
    t0 = time.time()
    df = fn(spark, root)
    rows = df.collect()
    t1 = time.time()
    cols = df.columns
    got = dict(df.dtypes)
    if sql is None:
        return f"rows-only rows={len(rows)} {t1 - t0:.1f}s {got}", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(cols):
        return f"COLUMNS {sorted(cols)} != {sorted(names)}", False
    off = {c: (got[c], types[c]) for c in cols if TYPES.get(got[c]) != types[c]}
    order = sorted(cols)
    a = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    ix = [names.index(c) for c in order]
    b = sorted(tuple(norm(r[i]) for i in ix) for r in want)
    ok = a == b and not off
    text = f"rows={len(a)}/{len(b)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if off:
        text += f" TYPES {off}"
    if a != b:
        sa, sb = set(a), set(b)
        text += f"\n   only spark {len(sa - sb)}: {sorted(sa - sb)[:3]}\n   only sql {len(sb - sa)}: {sorted(sb - sa)[:3]}\n   cols {order}"
    return text, ok


def main():
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session("check")
    con = connect(root)
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            text, ok = compare(spark, con, root, name, fn, sql.get(name))
        except Exception as e:  # report and go on with the next query
            text, ok = f"ERROR {type(e).__name__}: {str(e)[:1500]}", False
        print(("ok   " if ok else "FAIL ") + name, text, flush=True)
        if not ok:
            bad.append(name)
    print("unregistered SQL:", sorted(set(sql) - set(queries)))
    print("failed:", bad)


if __name__ == "__main__":
    main()
