"""Covariances of moves, by coordinates (i, j, c).

Each estimator is made from the moments of the rows (t, x), which are made where the rows are; the last step works on one row of numbers,
as many as the grid squared. Cross joins here have one row, or an axis of the grid, on a side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from .sums import Moments, whole_moments


def from_sums(rows: DataFrame, size: int, run: Callable[[Moments], np.ndarray], upper: bool = True) -> DataFrame:
    """(i, j, c) of the matrix that ``run`` makes of the sums of all rows; for i <= j if ``upper``. Without rows, or enough of them, it is empty."""
    def matrices(batches):
        for batch in batches:
            for flat in batch["moments"]:
                try:
                    m = run(Moments.from_flat(np.array(flat)))
                except ValueError:  # too few rows
                    continue
                i, j = np.triu_indices(len(m)) if upper else (a.ravel() for a in np.indices(m.shape))
                yield pd.DataFrame({"i": i, "j": j, "c": m[i, j]})

    return whole_moments(rows, {"even": np.ones(size)}).mapInPandas(matrices, "i int, j int, c double")


def estimate(rows: DataFrame, dims: tuple[int, int], method: str = "sample", alpha: float = 0.0, rank: int = 3) -> DataFrame:
    """(i, j, c) for i <= j of an estimator by name: the same arithmetic that models are fitted with, repairs and the hold of alpha included."""
    def run(sums: Moments) -> np.ndarray:
        _, products, fourth = sums.centred()
        return linalg.covariance_from_sums(sums.n, products, fourth, method, alpha, rank, dims)

    return from_sums(rows, dims[0] * dims[1], run)


def two_way(rows: DataFrame, dims: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Covariances along expiries and along tenors, (i, j, c) for all i and j."""
    along = lambda side: from_sums(rows, dims[0] * dims[1], lambda sums: linalg.two_way_from_products(sums.centred()[1], sums.n, *dims)[side], upper=False)
    return along(0), along(1)


def kronecker(one: DataFrame, two: DataFrame, tenors: int) -> DataFrame:
    """(i, j, c) of the Kronecker product, as a product of indices; both sides are small by their grid."""
    b = two.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("c").alias("c2"))
    return one.crossJoin(F.broadcast(b)).select((F.col("i") * tenors + F.col("i2")).alias("i"), (F.col("j") * tenors + F.col("j2")).alias("j"), (F.col("c") * F.col("c2")).alias("c"))


def separable_target(rows: DataFrame, dims: tuple[int, int]) -> DataFrame:
    return kronecker(*two_way(rows, dims), dims[1])


def trace(cov: DataFrame) -> DataFrame:
    return cov.where("i = j").agg(F.sum("c").alias("trace"))


def norms(cov: DataFrame) -> DataFrame:
    """(frobenius, largest, diagonal): the Frobenius norm, the largest entry's size and the mean of the diagonal, of (i, j, c) with i <= j."""
    times = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return cov.agg(F.sqrt(F.sum(times * F.col("c") ** 2)).alias("frobenius"), F.max(F.abs("c")).alias("largest"), F.avg(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("diagonal"))


def repaired(cov: DataFrame, least: float = 1e-12) -> DataFrame:
    """(i, j, c), i <= j, with eigenvalues of at least ``least``; the matrix is as large as the grid is."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group[["i", "j"]].max().max()) + 1
        m = np.zeros((n, n))
        m[group["i"], group["j"]] = m[group["j"], group["i"]] = group["c"]
        fixed, (i, j) = linalg.positive_definite(m, least), np.triu_indices(n)
        return pd.DataFrame({"i": i, "j": j, "c": fixed[i, j]})

    return cov.groupBy().applyInPandas(run, "i int, j int, c double")


def stretched(cov: DataFrame, factor: float) -> DataFrame:
    """Off-diagonal entries times ``factor``, as a stress; over 1 the matrix may be none of a covariance any more (see :func:`repaired`)."""
    return cov.withColumn("c", F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(F.col("c") * factor))
