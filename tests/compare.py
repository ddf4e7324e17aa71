"""Holds queries against their SQL: ``python -m tests.compare SF_DIR [NAME...]``."""

from __future__ import annotations

import decimal
import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (decimal.Decimal, float)):
        value = float(value)
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_frame, relation) -> str | None:
    """What differs between a DataFrame and a DuckDB result, or None."""
    columns = relation.columns
    if sorted(spark_frame.columns) != sorted(columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(columns)}"
    a = rows_of(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    b = rows_of(columns, relation.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}; first: {a[:1]} and {b[:1]}"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ; first: {wrong[0]}, columns {sorted(columns)}" if wrong else None


def main(sf_dir: str, names: list[str]) -> int:
    import time

    from tidemark.plans import catalogue
    from tidemark.session import local_session

    spark, con, bad = local_session(cpus=int(__import__("os").environ.get("CPUS", "8"))), tables(sf_dir), 0
    for name in names or catalogue.QUERIES:
        start = time.time()
        try:
            frame = catalogue.QUERIES[name](spark, sf_dir)
            if name in catalogue.ORACLES:
                said = difference(frame, con.sql(catalogue.ORACLES[name]))
            else:
                said = None if frame.count() else "no rows"
            print(f"{'ok  ' if said is None else 'BAD '} {name} {time.time() - start:.1f}s {said or ''}"[:1500], flush=True)
            bad += said is not None
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name} {str(e)[:900]}", flush=True)
            bad += 1
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
