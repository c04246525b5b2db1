"""Run registered queries next to their SQL twins and compare whole results.

    python tests/sidebyside.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {
    "bigint": "int", "int": "int", "hugeint": "int", "integer": "int", "smallint": "int",
    "double": "double", "float": "double", "string": "text", "varchar": "text",
    "boolean": "bool",
}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql) -> list[str]:
    """What differs between a DataFrame and the SQL result; empty when equal."""
    got_types = {c: KINDS.get(t.lower(), t) for c, t in spark_df.dtypes}
    found = con.execute(sql)
    want_types = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1])) for d in found.description}
    want = found.fetchall()
    if got_types != want_types:
        return [f"schema {got_types} != {want_types}"]
    got = [tuple(r) for r in spark_df.collect()]
    a, b = _rows(spark_df.columns, got), _rows(list(want_types), want)
    out = []
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}")
    return out


def main() -> int:
    from lapstream.session import local_session

    import __spark_entry__ as entry

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session(os.environ.get("SIDE_CPUS", "8"), int(os.environ.get("SIDE_PARTITIONS", "8")))
    con = oracle(sf_dir)
    sqls = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            if name in sqls:
                df = build(spark, sf_dir)
                wrong = differences(df, con, sqls[name])
                note = ""
            else:
                wrong, note = [], f"rows only: {build(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            wrong, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok  '} {name:<34} {time.time() - began:6.2f}s {note} {' | '.join(wrong)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
