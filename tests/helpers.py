from __future__ import annotations

from collections import Counter


def _plain(value: object) -> object:
    if value is None or value != value:
        return None
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def bag(columns: list[str], rows: list) -> Counter:
    """Rows as a bag, with columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(_plain(row[i])) for i in order) for row in rows)


def same(df, con, sql: str) -> None:
    """The DataFrame has the columns and rows of the SQL."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, df.collect()) == bag(columns, result.fetchall())
