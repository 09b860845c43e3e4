"""Walk-forward folds over row numbers, derived from the panel's own rows and assigned by arithmetic instead of a range join."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import small_table


def row_count(rows: DataFrame) -> DataFrame:
    """(n): one row, the number of rows that ``t`` counts from 0."""
    return rows.agg(F.coalesce(F.max("t") + 1, F.lit(0)).cast("long").alias("n"))


def windows_frame(rows: DataFrame, windows: Sequence[int], min_train: int | None = None) -> DataFrame:
    """(window, first, n): each window with the row at which its first fold starts."""
    table = small_table(rows.sparkSession, [(w, min_train or w) for w in windows], "window int, first int")
    return table.crossJoin(F.broadcast(row_count(rows)))


def fold_table(rows: DataFrame, windows: Sequence[int], horizon: int = 20, step: int = 20, min_train: int | None = None) -> DataFrame:
    """(window, fold, train_from, train_to, test_from, test_to), ends exclusive, for the rows that ``t`` counts.

    A fold starts every ``step`` rows from ``min_train`` (or else the window) on; it trains on up to ``window`` rows before and tests on up to
    ``horizon`` rows from its start. Folds that have fewer than ``min_train`` training rows are skipped.
    """
    starts = F.when(F.col("first") < F.col("n"), F.sequence(F.col("first").cast("long"), F.col("n") - 1, F.lit(step).cast("long")))
    found = windows_frame(rows, windows, min_train).select("window", "first", "n", F.posexplode(starts).alias("fold", "start"))
    low = F.greatest(F.col("start") - F.col("window"), F.lit(0)).cast("long")
    kept = found.withColumn("low", low).where(F.col("start") - F.col("low") >= F.col("first"))
    return kept.select("window", "fold", F.col("low").alias("train_from"), F.col("start").alias("train_to"), F.col("start").alias("test_from"), F.least(F.col("start") + horizon, F.col("n")).alias("test_to"))


def block_size(windows: Sequence[int], step: int, min_train: int | None = None) -> int:
    """The longest blocks of which every training set of these folds is made."""
    return gcd(step, *(w for w in windows), *([min_train] if min_train else []))


def refit_table(rows: DataFrame, window: int, step: int = 20) -> DataFrame:
    """(fold, train_from, train_to) of refits whose last row comes every ``step`` rows from the first full window on; the last may end at the last row."""
    ends = F.when(F.col("n") >= window, F.sequence(F.lit(window).cast("long"), F.col("n"), F.lit(step).cast("long")))
    return row_count(rows).select(F.posexplode(ends).alias("fold", "train_to")).select("fold", (F.col("train_to") - window).alias("train_from"), "train_to")


def _assign(df: DataFrame, windows: Sequence[int], step: int, min_train: int | None, low, high) -> DataFrame:
    known = windows_frame(df, windows, min_train)
    last = F.ceil((F.col("n") - F.col("first")) / step) - 1
    folds = F.when((F.col("_low") <= F.col("_high")) & (F.col("first") <= F.col("window")), F.sequence("_low", "_high"))
    dealt = df.crossJoin(F.broadcast(known)).withColumn("_low", F.greatest(low, F.lit(0)).cast("int")).withColumn("_high", F.least(high, last).cast("int"))
    return dealt.select("window", F.explode(folds).alias("fold"), *df.columns)


def training_rows(df: DataFrame, windows: Sequence[int], step: int = 20, min_train: int | None = None) -> DataFrame:
    """Each row once for each fold that trains on it; ``df`` has the row number ``t``."""
    t, first = F.col("t"), F.col("first")
    return _assign(df, windows, step, min_train, F.ceil((t - first + 1) / step), F.floor((t + F.col("window") - first) / step))


def test_rows(df: DataFrame, windows: Sequence[int], horizon: int = 20, step: int = 20, min_train: int | None = None) -> DataFrame:
    """Each row once for each fold that tests on it."""
    t, first = F.col("t"), F.col("first")
    return _assign(df, windows, step, min_train, F.ceil((t - first - horizon + 1) / step), F.floor((t - first) / step))


test_rows.__test__ = False


def latest_rows(df: DataFrame, window: int) -> DataFrame:
    """The last ``window`` rows by t; all, if there are fewer."""
    last = df.agg(F.max("t").alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col("t") > F.col("_last") - window).drop("_last")
