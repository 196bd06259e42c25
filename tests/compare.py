"""Compare a Spark result with the check SQL's rows, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def check_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    return names, cursor.fetchall()


def sorted_rows(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    arranged = [tuple(row[i] for i in order) for row in rows]
    return sorted(arranged, key=lambda row: [(v is not None, str(v)) for v in row])


def difference(df, folder: str, sql: str) -> str | None:
    """None when both sides agree in columns and rows, else what differs."""
    names, expected = check_rows(folder, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    left = sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    right = sorted_rows(names, expected)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for mine, theirs in zip(left, right):
        if mine != theirs:
            return f"{mine} against {theirs}"
    return None
