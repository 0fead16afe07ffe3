"""Rows of a Spark query against those of the same query in DuckDB."""

from __future__ import annotations


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(df, duck, sql: str) -> None:
    rows, names = df.collect(), df.columns
    cursor = duck.execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(theirs)
    assert canonical(rows, names) == canonical(cursor.fetchall(), theirs)
