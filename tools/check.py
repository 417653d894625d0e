"""Compare registered queries with their SQL twins in DuckDB: ``check.py [regex] [sf]``."""

from __future__ import annotations

import os
import re
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c].dtype) or str(df[c].dtype) == "Float64":
            df[c] = df[c].astype("float64") + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True) if len(df.columns) else df


def main() -> int:
    from cytofleet.plans import catalogue
    from cytofleet.session import build_session

    pat = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    sf = sys.argv[2] if len(sys.argv) > 2 else "sf0.01"
    d = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = 0
    for name, fn in catalogue.QUERIES.items():
        if not pat.search(name):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, d)
            got = norm(sdf.toPandas())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {str(e)[:600]}", flush=True)
            continue
        t1 = time.time()
        sql = catalogue.ORACLES.get(name)
        if sql is None:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            if "-v" in sys.argv:
                print(got.head(10).to_string())
            continue
        try:
            want = norm(con.sql(sql).df())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: sql {str(e)[:600]}", flush=True)
            continue
        kinds = {n: t for n, t in zip(con.sql(sql).columns, map(str, con.sql(sql).types))}
        group = lambda t: ("int" if t in ("int", "bigint", "INTEGER", "BIGINT") else "num" if t in ("double", "DOUBLE") else
                           "str" if t in ("string", "VARCHAR") else "bool" if t in ("boolean", "BOOLEAN") else t)
        odd = [f"{n}: {t}/{kinds[n]}" for n, t in sdf.dtypes if n in kinds and group(t) != group(kinds[n])]
        t2 = time.time()
        state = "ok   "
        note = ""
        if list(got.columns) != list(want.columns):
            state, note = "FAIL ", f"columns {list(got.columns)} / {list(want.columns)}"
        elif len(got) != len(want):
            state, note = "FAIL ", f"rows {len(got)} / {len(want)}"
        else:
            diffs = []
            for c in got.columns:
                a, b = got[c], want[c]
                if a.dtype == "float64" and b.dtype == "float64":
                    ne = ~((a == b) | (a.isna() & b.isna()))
                else:
                    ne = ~((a.astype(object).where(a.notna(), None).astype(str) == b.astype(object).where(b.notna(), None).astype(str)))
                if ne.any():
                    i = ne.idxmax()
                    diffs.append(f"{c}: {int(ne.sum())} differ, row {i}: {a[i]!r} / {b[i]!r}")
            if diffs:
                state, note = "FAIL ", "; ".join(diffs[:4])
        if state != "ok   ":
            bad += 1
        elif len(got) == 0:
            note = "EMPTY"
        if odd:
            note += " TYPES " + ", ".join(odd)
        print(f"{state} {name}: {len(got)} rows spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s {note}", flush=True)
        if state != "ok   " and "-v" in sys.argv:
            print(got.head(8).to_string())
            print(want.head(8).to_string())
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
