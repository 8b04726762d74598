"""Compare registered queries with their SQL: `python tests/check.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from spendmart.session import local_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, build, sql):
    df = build(spark, sf_dir)
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows-only {len(got)}", []
    relation = con.sql(sql)
    want_cols = relation.columns
    want = relation.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return "COLUMNS", [sorted(got_cols), sorted(want_cols)]
    a, b = canonical(got_cols, got), canonical(want_cols, want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [x for x in a if x not in in_b][:3]
        only_b = [x for x in b if x not in in_a][:3]
        return f"DIFFERENT {len(a)} vs {len(b)}", [sorted(got_cols), *only_a, "--", *only_b]
    return f"ok {len(a)}", []


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    builders, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in builders.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            verdict, details = compare(spark, con, sf_dir, name, build, oracles.get(name))
        except Exception as error:  # report and go on with the other queries
            verdict, details = "ERROR", [str(error)[:1500]]
        bad += not (verdict.startswith("ok") or verdict.startswith("rows-only"))
        print(f"{name:28s} {verdict:24s} {time.time() - start:6.2f}s", flush=True)
        for line in details:
            print("    ", line)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
