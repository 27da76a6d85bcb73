"""Comparisons shared by the tests."""


def same_rows(left, right):
    """Equal as multisets of rows, by column name."""
    names = sorted(left[0]) if left else []
    order = lambda rows: sorted((tuple(r[n] for n in names) for r in rows), key=repr)
    assert (sorted(right[0]) if right else []) == names
    assert order(left) == order(right)


def through_sql(sql, **tables):
    """Rows of a DuckDB query over the rows of DataFrames."""
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    return con.sql(sql).to_arrow_table().to_pylist()
