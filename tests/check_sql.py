"""Run registered queries against their check SQL.  Usage: check_sql.py [-s SF] [keys or prefixes...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, key, query, sql, sf_dir):
    began = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    middle = time.time()
    message = ""
    ok = True
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        types = {d[0]: str(d[1]) for d in cur.description}
        want = cur.fetchall()
        if sorted(names) != sorted(df.columns):
            return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
        kinds = {"bigint": ("BIGINT", "INTEGER"), "string": ("VARCHAR",), "double": ("DOUBLE",), "boolean": ("BOOLEAN",)}
        bad = [(n, k, types[n]) for n, k in df.dtypes if types[n] not in kinds.get(k, ())]
        if bad:
            message += f" TYPES {bad}"
        a, b = table_of(df.columns, got), table_of(names, want)
        if a != b:
            ok = False
            sa, sb = set(a), set(b)
            message += f" rows {len(a)} vs {len(b)}; spark only {list(sa - sb)[:2]}; sql only {list(sb - sa)[:2]}"
    return ok, f"{len(got)} rows spark {middle - began:.1f}s sql {time.time() - middle:.1f}s{message}"


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["-s"]:
        sf_dir, argv = f"/root/testdata/sf{argv[1]}", argv[2:]
    import __spark_entry__ as entry

    from briefmill.session import build_session

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for key, fn in queries.items():
        if argv and not any(key == a or (a.endswith("*") and key.startswith(a[:-1])) for a in argv):
            continue
        try:
            ok, message = compare(spark, con, key, fn, oracle.get(key), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, message = False, f"{type(exc).__name__} {str(exc)[:1500]}"
        if not ok:
            failed.append(key)
        print(("ok  " if ok else "FAIL"), key, "" if oracle.get(key) else "(no sql)", message, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
