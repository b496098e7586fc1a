"""Spark result against SQL result: columns, Python types and values, in any order."""

from __future__ import annotations

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def run_sql(sql: str, folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    result = db.execute(sql)
    names = [column[0] for column in result.description]
    return names, result.fetchall()


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


def differences(df, sql: str, folder: str) -> list[str]:
    names, expected = run_sql(sql, folder)
    found = [tuple(row) for row in df.collect()]
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} but {sorted(names)}"]
    if len(found) != len(expected):
        problems.append(f"{len(found)} rows but {len(expected)}")
    left, right = as_rows(df.columns, found), as_rows(names, expected)
    for mine, theirs in zip(left, right):
        if repr(mine) != repr(theirs):
            problems.append(f"{mine}\n   but {theirs}")
            if len(problems) > 2:
                break
    return problems
