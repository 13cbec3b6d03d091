"""Rows of a DataFrame in a comparable order, for the tests."""


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
