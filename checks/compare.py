"""Run every registered query next to its SQL and report differences.

    python -m checks.compare [--shuffled] [sf_dir] [query ...]

``--shuffled`` treats every table as too large to broadcast.
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from checks.oracles import ORACLES
from checks.queries import QUERIES
from clubhouse.binding import bound_tables
from clubhouse.session import local_session
from clubhouse.tables import BROADCAST_ROWS

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def _rows(table) -> tuple[dict[str, str], Counter]:
    names = sorted(table.column_names)
    types = {n: str(table.schema.field(n).type) for n in names}
    columns = [table.column(n).to_pylist() for n in names]
    return types, Counter(zip(*columns))


def difference(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns, types and rows in any order."""
    have_types, have = _rows(df.toArrow())
    want_types, want = _rows(db.sql(sql).to_arrow_table())
    if have_types != want_types:
        return f"types: {sorted(set(have_types.items()) ^ set(want_types.items()))}"
    if have != want:
        extra, lacking = list((have - want).items())[:2], list((want - have).items())[:2]
        return f"rows {have.total()} / {want.total()}: extra {extra}, lacking {lacking}"
    return ""


def main(*arguments: str) -> int:
    shuffled = "--shuffled" in arguments
    sf_dir, *names = [a for a in arguments if a != "--shuffled"] or ["/root/testdata/sf0.01"]
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    if shuffled:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = bound_tables(spark, sf_dir, 0 if shuffled else BROADCAST_ROWS)
    db = database(sf_dir)
    failures = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            found = difference(QUERIES[name](tables), db, ORACLES[name])
        except Exception as error:  # report it and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {found}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
