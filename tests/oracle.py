"""Runs registered queries and their SQL side by side: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What tells the query's rows from the SQL's; nothing if they are equal."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    if set(names) != set(df.columns):
        return [f"columns {sorted(set(names) ^ set(df.columns))}"]
    plain = lambda row: tuple(str(row[c]) for c in sorted(names))
    got, want = sorted(plain(r.asDict()) for r in df.collect()), sorted(map(plain, want))
    out = [f"rows {len(got)} and {len(want)}"] if len(got) != len(want) else []
    return out + [f"{g}\n   {w}" for g, w in zip(got, want, strict=False) if g != w][:2]


if __name__ == "__main__":
    import __spark_entry__ as entry
    from wxlake.session import local

    spark, sf = local("8"), sys.argv[1]
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            found = differences(queries[name](spark, sf), sql[name], sf) if name in sql else [f"no SQL, {queries[name](spark, sf).count()} rows"]
        except Exception as e:  # noqa: BLE001
            found = [f"failed: {str(e)[:700]}"]
        print("ROW", name, "ok" if not found else found[0], f"{time.time() - start:.1f}s", *found[1:2], flush=True)
