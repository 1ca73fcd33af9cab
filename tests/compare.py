"""A Spark result against DuckDB SQL over the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differing_rows(df, sql: str, sf_dir: str) -> tuple[int, list, list]:
    """Number of rows, and up to three rows that only one side has."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    con.register("mine", df.toArrow())
    con.sql(f"CREATE TABLE wanted AS {sql}")
    names = lambda t: sorted(r[0] for r in con.sql(f"DESCRIBE {t}").fetchall())
    assert names("mine") == names("wanted")
    columns = ", ".join(f'"{c}"' for c in names("mine"))
    only = lambda a, b: con.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall()
    return con.sql("SELECT count(*) FROM mine").fetchall()[0][0], only("mine", "wanted"), only("wanted", "mine")
