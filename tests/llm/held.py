"""Comparison of results with rows made the plain way."""

import pandas as pd


def frame(df, *keys):
    got = df.toPandas()
    return got.sort_values(list(keys) or list(got.columns), ignore_index=True, na_position="first", kind="stable")


def same(got: pd.DataFrame, want: list[tuple]):
    """Rows equal as bags; a null is a null."""
    tidy = lambda rows: sorted((tuple("null" if v is None or v != v else (int(v) if isinstance(v, float) and v == int(v) else v) for v in r) for r in rows), key=repr)
    assert tidy(got.itertuples(index=False, name=None)) == tidy(want)
