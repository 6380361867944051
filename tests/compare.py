"""Rows of a query and of its SQL, for comparison."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return rows_of(names, got.fetchall())


def rows_of(names: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(names)
    at = [names.index(n) for n in order]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
