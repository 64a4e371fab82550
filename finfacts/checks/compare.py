"""Run registered queries beside their oracle SQL on the same Parquet tables.

    python -m finfacts.checks.compare [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def difference(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    allowed = {
        "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
        "boolean": "BOOLEAN", "date": "DATE",
    }
    for column, kind in df.dtypes:
        if allowed.get(kind) != types[column]:
            return f"type of {column}: {kind} vs {types[column]}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(df.columns)}\n   spark  {a}\n   oracle {b}"
    if not mine:
        return "no rows on either side"
    return None


def main() -> None:
    from finfacts.checks.catalog import ORACLES, QUERIES
    from finfacts.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "finfacts-compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                           "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(args.sf)
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t0 = time.time()
        try:
            if name in ORACLES:
                problem = difference(spark, con, name, fn, ORACLES[name], args.sf)
                verdict = "ok" if problem is None else f"DIFF {problem}"
            else:
                verdict = f"rows {fn(spark, args.sf).count()}"
                problem = None
        except Exception as exc:  # report and go on with the next query
            problem = verdict = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{name:34s} {time.time() - t0:6.2f}s {verdict}", flush=True)
    print(f"{bad} problem(s)")


if __name__ == "__main__":
    main()
