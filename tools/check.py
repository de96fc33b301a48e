"""Compare registered queries with their SQL twins on one scale factor.

    python tools/check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docloom import registry  # noqa: E402
from docloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
                out.append("<null>")
            elif isinstance(v, float):
                out.append(f"{v:.6f}" if abs(v) < 1e12 else repr(v))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", cpus=8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    oracles, failed = registry.oracles(), []
    for name, query in registry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            got = query(spark, sf_dir)
            types = dict(got.dtypes)
            got = got.toPandas()
        except Exception as e:
            print(f"FAIL {name}: {str(e)[:1500]}")
            failed.append(name)
            continue
        took = time.time() - started
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s {types}")
            continue
        started = time.time()
        try:
            relation = con.sql(oracles[name])
            sql_types = dict(zip(relation.columns, map(str, relation.types)))
            expected = relation.df()
        except Exception as e:
            print(f"FAIL {name} (sql): {str(e)[:1500]}")
            failed.append(name)
            continue
        a, b = normal(got), normal(expected)
        ok = a == b and sorted(got.columns) == sorted(expected.columns)
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {len(a)} rows, spark {took:.1f}s, sql {time.time() - started:.1f}s")
        pairs = {c: (types.get(c), sql_types.get(c)) for c in {*types, *sql_types}}
        plain = {("bigint", "BIGINT"), ("string", "VARCHAR"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"),
                 ("timestamp", "TIMESTAMP"), ("int", "INTEGER"), ("timestamp_ntz", "TIMESTAMP")}
        odd = {c: t for c, t in pairs.items() if t not in plain}
        if odd:
            print("     types", odd)
        if not ok:
            failed.append(name)
            left, right = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
            print("     columns", sorted(got.columns), sorted(expected.columns), len(b))
            print("     spark only", [str(x)[:300] for x in left[:3]])
            print("     sql only  ", [str(x)[:300] for x in right[:3]])
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
