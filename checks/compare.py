"""Run registered queries against their SQL: python -m checks.compare SF [name prefix ...]"""

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or str(type(v)).find("bool") >= 0:
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return round(float(v), 9) + 0.0
        return str(v)

    return sorted((tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False)), key=str)


def differences(spark_df, con, sql: str) -> tuple[str | None, int]:
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}", len(got)
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and len(got)}
    a, b = _canon(got), _canon(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(a)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {sorted(got.columns)}\n   {x}\n   {y}", len(a)
    if odd:
        return f"types {odd}", len(a)
    return None, len(a)


def main(argv):
    from .registry import all_checks
    from .session import session
    from .sqlkit import statement

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark = session()
    con = connect(sf_dir)
    bad = 0
    for name, (query, final) in all_checks().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if final is None:
                n, diff = query(spark, sf_dir).count(), None
            else:
                diff, n = differences(query(spark, sf_dir), con, statement(final))
        except Exception as e:  # report and go on to the next query
            diff, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += diff is not None
        flag = "ok" if diff is None else "BAD"
        empty = " EMPTY" if n == 0 else ""
        print(f"{flag:4}{name:36}{n:8} rows {time.time() - start:6.1f}s{empty} {diff or ''}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
