"""QR of tall matrices over partitions: triangles of parts of the rows are stacked and reduced again (Demmel, Grigori, Hoemmen and Langou, 2012).

Singular values of the triangle are those of the matrix, to the last digits, where the eigenvalues of B'B lose half of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are reduced at a time.
CHUNK = 4096


def reduced(top: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of ``top`` above ``rows``, with a diagonal that is not negative."""
    r = np.linalg.qr(np.vstack([top, rows]), mode="r")
    return r * np.where(np.diag(r)[: len(r)] < 0, -1.0, 1.0)[:, None] if r.shape[0] <= r.shape[1] else r


def triangle(rows: DataFrame, width: int, dense: Callable[[pd.DataFrame], np.ndarray], salts: int = 32) -> DataFrame:
    """(r): the triangle of all rows as one flat array, width squared numbers. ``dense`` makes a matrix of a batch of ``rows``.

    A task reduces its own rows; triangles meet in ``salts`` tasks, a few at a time, and those in one. Without rows there is no result.
    """
    def own(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, seen = np.zeros((0, width)), False
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                r, seen = reduced(r, dense(batch.iloc[at : at + CHUNK])), True
        if seen:
            yield pd.DataFrame({"r": [square(r).ravel().tolist()]})

    def square(r: np.ndarray) -> np.ndarray:
        return np.vstack([r, np.zeros((max(width - len(r), 0), width))])

    def stack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, seen = np.zeros((0, width)), False
        for batch in batches:
            for flat in batch["r"]:
                r, seen = reduced(r, np.array(flat, float).reshape(width, width)), True
        if seen:
            yield pd.DataFrame({"r": [square(r).ravel().tolist()]})

    parts = rows.mapInPandas(own, "r array<double>")
    return parts.repartition(salts, F.spark_partition_id()).mapInPandas(stack, "r array<double>").coalesce(1).mapInPandas(stack, "r array<double>")


def matrix_of(flat: Iterable[float]) -> np.ndarray:
    r = np.array(flat, float)
    n = int(round(np.sqrt(len(r))))
    return r.reshape(n, n)
