"""Hold registered queries against DuckDB over the same tables.

python -m tests.compare FOLDER [NAME...]: every query that has SQL, or those named."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(plain(r[k]) for k in order) for r in records]
    return sorted(names), sorted(out, key=lambda r: [(x is not None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in r])


def database(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def difference(spark, folder, run, sql, c=None) -> str:
    """Empty if both give the same columns and rows."""
    df = run(spark, folder)
    got = rows(df.columns, df.collect())
    cursor = (c or database(folder)).execute(sql)
    want = rows([x[0] for x in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        only = [r for r in got[1] if r not in set(want[1])][:2], [r for r in want[1] if r not in set(got[1])][:2]
        return f"{len(got[1])} rows and {len(want[1])}; only here {only[0]}, only there {only[1]}"
    bad = [(x, y) for x, y in zip(got[1], want[1], strict=True) if x != y]
    return f"{len(bad)} of {len(want[1])} rows differ: {bad[0]}" if bad else ""


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from quillon.session import session

    spark = session("compare", f"local[{os.environ.get('CPUS', '6')}]", 6, spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    c, queries, sql, failed = database(folder), entry.queries(), entry.oracle_sql(), 0
    for name in names or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            said = difference(spark, folder, queries[name], sql[name], c) if name in sql else f"no SQL, {queries[name](spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        ok = not said or said.startswith("no SQL")
        failed += not ok
        print("ok  " if ok else "FAIL", name, round(time.time() - began, 1), said, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
