"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ledgerline.plans.registry import oracle_sql, queries  # noqa: E402
from ledgerline.session import build_session  # noqa: E402
from ledgerline.sources.tables import TABLES, table_path  # noqa: E402


def norm(v, sig):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if sig is None:
            return repr(v)
        return f"{v:.{sig}g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    return str(v)


def rows_of(cols, records, sig):
    return sorted(tuple(norm(r[c], sig) for c in cols) for r in records)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf, t)}')")
    qs, sqls = queries(), oracle_sql()
    names = names or list(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, sf)
            srows = [r.asDict(recursive=True) for r in sdf.collect()]
            scols = sorted(sdf.columns)
            stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        except Exception:
            bad += 1
            print(f"[SPARK-ERR] {n}\n{traceback.format_exc()[-1500:]}")
            continue
        dt = time.time() - t0
        if n not in sqls:
            print(f"[rows-only] {n}: {len(srows)} rows  ({dt:.2f}s)")
            continue
        try:
            cur = con.execute(sqls[n])
            dcols = [d[0] for d in cur.description]
            drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
            dtypes = {d[0]: str(d[1]) for d in cur.description}
        except Exception as e:
            bad += 1
            print(f"[SQL-ERR] {n}: {e}")
            continue
        if sorted(dcols) != scols:
            bad += 1
            print(f"[COLS] {n}: spark={scols} sql={sorted(dcols)}")
            continue
        exact = rows_of(scols, srows, None) == rows_of(scols, drows, None)
        approx = rows_of(scols, srows, 9) == rows_of(scols, drows, 9)
        tag = "OK" if exact else ("APPROX" if approx else "MISMATCH")
        if not exact:
            bad += 1
        print(f"[{tag}] {n}: spark={len(srows)} sql={len(drows)} rows ({dt:.2f}s)")
        if not exact:
            a, b = rows_of(scols, srows, None), rows_of(scols, drows, None)
            sa, sb = set(a), set(b)
            print("   cols :", scols)
            print("   types:", [(c, stypes[c], dtypes[c]) for c in scols])
            print("   only spark:", [r for r in a if r not in sb][:3])
            print("   only sql  :", [r for r in b if r not in sa][:3])
    print(f"done: {len(names)} queries, {bad} not exact")
    spark.stop()


if __name__ == "__main__":
    main()
