"""Walk-forward validation of many models at once, their metrics and rankings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.tables import small_table
from . import factors
from .factors import Spec
from .folds import block_size
from .grid import align_vega
from .moves import all_move_rows, dot
from .quantile import exact_quantile
from .sums import Weights, fold_moments, merged, stacked

#: Names of the metrics.
METRICS = ("n_test_obs", "full_pnl_std", "proj_pnl_std", "error_mean", "error_rmse", "error_mae", "error_p95_abs", "error_max_abs", "explained_pnl_variance", "full_vs_projected_corr")


def vega_array(grid: DataFrame, vega: DataFrame, on_missing: str = "zero") -> np.ndarray:
    """The book as one array in bucket order; it is as long as the grid."""
    rows = align_vega(grid, vega, on_missing).orderBy("bucket").collect()
    return np.array([np.nan if r["vega"] is None else r["vega"] for r in rows], float)


def dims_of(grid: DataFrame) -> tuple[int, int]:
    row = grid.agg((F.max("e_idx") + 1).alias("e"), (F.max("t_idx") + 1).alias("t")).first()
    return row["e"], row["t"]


def fold_kernel(specs: Sequence[Spec], vega: np.ndarray, dims: tuple[int, int]):
    """Fits every spec on one fold's moments and scores it on the fold's test rows; specs that share a decomposition fit once. A failed fit gives one row that says so."""
    kinds = dict(c.split(" ") for c in schemas.PREDICTIONS.split(", "))

    def run(test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in kinds}
        if not train.empty and not test.empty:
            test = test.sort_values("t")
            transform, window, fold = (test[c].iloc[0] for c in ("kind", "window", "fold"))
            x, full = stacked(test["x"]), test["full_pnl"].to_numpy()
            prev = None if transform == "absolute" else stacked(test["prev"])
            sums = {name: merged(group["moments"]) for name, group in train.groupby("weighting")}
            fits = {}
            for spec in (s for s in specs if s.transform == transform):
                row = {"model": spec.name, "window": window, "fold": fold, "transform": transform, "family": spec.family, "train_start": min(train["low"]), "train_end": max(train["high"])}
                try:
                    if spec.fit_key() not in fits:
                        fits[spec.fit_key()] = factors.fit_sums(sums[spec.weighting()], spec, vega, dims)
                    hat = factors.projected_pnl(fits[spec.fit_key()], x, prev, spec, vega)
                    found = {"t": test["t"].tolist(), "date": test["date"].tolist(), "full_pnl": full.tolist(), "projected_pnl": hat.tolist(), "error": (full - hat).tolist()}
                except Exception as error:  # one fold's failure is its own, whatever it is
                    found = {"failure": [f"{type(error).__name__}: {error}"]}
                many = len(next(iter(found.values())))
                for c, values in out.items():
                    values += found.get(c, [row.get(c)] * many)
        return pd.DataFrame({c: pd.Series(v, dtype=object if kinds[c] in ("string", "date") else None if v else float) for c, v in out.items()})

    return run


def walk_forward(surface: DataFrame, grid: DataFrame, vega: DataFrame, specs: Sequence[Spec], windows: Sequence[int], horizon: int = 20, step: int = 20, min_train: int | None = None) -> DataFrame:
    """Predictions of every spec, window and fold (PREDICTIONS).

    The moves of all transforms are made once and summed in blocks; a fold's training set is a merge of a few parts (see ``fold_moments``), so only test
    rows travel as rows, with the levels before them only where a transform needs them. Which fold a row or a block belongs to is arithmetic. Each fold of a
    transform is one group, small by its horizon and the grid, and all groups run side by side.
    """
    price, dims, block = vega_array(grid, vega), dims_of(grid), block_size(windows, step, min_train)
    transforms, starts = sorted({s.transform for s in specs}), fold_starts(windows, min_train)
    rows = all_move_rows(surface, grid, transforms).withColumnRenamed("transform", "kind")
    train = fold_moments(rows, weightings(specs, price), starts, step, block)
    return scored(test_folds(rows, price, starts, horizon, step), train, specs, price, dims)


def fold_starts(windows: Sequence[int], min_train: int | None = None) -> list[tuple[int, int]]:
    """Each window with the row at which its first fold starts; windows that never hold ``min_train`` rows are out."""
    return [(w, min_train or w) for w in windows if (min_train or w) <= w]


def weightings(specs: Sequence[Spec], price: np.ndarray) -> Weights:
    """The scalings of buckets that the specs of each transform need."""
    return {t: {s.weighting(): factors.fit_weights(s, price) for s in specs if s.transform == t} for t in {s.transform for s in specs}}


def test_folds(rows: DataFrame, price: np.ndarray, starts: Sequence[tuple[int, int]], horizon: int, step: int) -> DataFrame:
    """Rows (kind, t, date, x, dvol, prev) with their full PnL, once for each window and fold that tests on them; levels stay only with moves that are not absolute."""
    needed = rows.select("kind", "t", "date", "x", F.when(F.col("kind") != "absolute", F.col("prev")).alias("prev"), dot("dvol", factors.literal(price)).alias("full_pnl"))
    t, first = F.col("t"), F.col("first")
    low, high = F.greatest(F.ceil((t - first - horizon + 1) / step), F.lit(0)), F.floor((t - first) / step)
    folds = F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))
    known = F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.lit(f).alias("first")) for w, f in starts)))
    return needed.withColumn("w", known).select("*", "w.window", "w.first").select("kind", "window", folds.alias("fold"), "t", "date", "x", "prev", "full_pnl")


test_folds.__test__ = False


def scored(tests: DataFrame, train: DataFrame, specs: Sequence[Spec], price: np.ndarray, dims: tuple[int, int]) -> DataFrame:
    """PREDICTIONS of test rows by the models of their fold's training parts; folds that have only one of both give nothing."""
    keys = ("kind", "window", "fold")
    return tests.groupBy(*keys).cogroup(train.groupBy(*keys)).applyInPandas(fold_kernel(specs, price, dims), schemas.PREDICTIONS)


def guarded_corr(a: str, b: str, least: int) -> Column:
    enough = (F.count(a) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 1e-16)
    return F.when(enough, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def pnl_metrics(predictions: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """The ten metrics over all predictions of each key (which are not null); those that their rows cannot give are null, as is a correlation of under ``least`` rows.

    The passes of the quantile read four columns of the predictions, which are kept (in memory, else on disk) so that no model is fitted twice.
    """
    error = F.col("error")
    spread = F.var_samp("full_pnl")
    names = list(keys) or ["_all"]
    rows = (predictions if keys else predictions.withColumn("_all", F.lit(0))).select(*names, "full_pnl", "projected_pnl", "error").persist()
    sums = rows.groupBy(*names).agg(
        F.count("error").alias("n_test_obs"), F.stddev_samp("full_pnl").alias("full_pnl_std"), F.stddev_samp("projected_pnl").alias("proj_pnl_std"),
        F.avg(error).alias("error_mean"), F.sqrt(F.avg(error * error)).alias("error_rmse"), F.avg(F.abs(error)).alias("error_mae"), F.max(F.abs(error)).alias("error_max_abs"),
        F.when(spread > 1e-16, 1 - F.var_samp("error") / spread).alias("explained_pnl_variance"), guarded_corr("full_pnl", "projected_pnl", least).alias("full_vs_projected_corr"))
    return sums.join(exact_quantile(rows, names, F.abs(error), 0.95, "error_p95_abs", few=True), names, "left").select(*keys, *METRICS)


def summary(predictions: DataFrame, specs: DataFrame, windows: Sequence[int], least: int = 3) -> DataFrame:
    """One row a spec and window: ids, metrics (correlations from ``least`` rows on), the spec's fields; status says where nothing was predicted."""
    spark = specs.sparkSession
    tried = specs.crossJoin(F.broadcast(small_table(spark, [(w,) for w in windows], "window int")))
    measured = pnl_metrics(predictions.where("failure is null"), "model", "window", least=least).withColumnRenamed("model", "name")
    joined = tried.join(measured, ["name", "window"], "left")
    done = F.col("n_test_obs").isNotNull()
    return joined.select(
        F.col("name").alias("model"), F.when(done, F.col("family")).alias("family"), F.when(done, F.col("transform")).alias("transform"), "window", *METRICS,
        *(F.when(done, F.col(c)).alias(f"spec_{c}") for c in factors.spec_columns()), F.when(~done, F.lit("failed_or_no_predictions")).alias("status"))


def ranking() -> list[Column]:
    """Smallest error first, then the smaller tail; ties by name and window; nulls last."""
    return [F.asc_nulls_last("error_rmse"), F.asc_nulls_last("error_p95_abs"), F.asc("model"), F.asc("window")]


def leaderboard(summary: DataFrame, most: int = 20) -> DataFrame:
    return summary.orderBy(*ranking()).limit(most)


def best_by_window(summary: DataFrame, most: int = 5) -> DataFrame:
    """The best of each window, all in the order of the leaderboard."""
    place = F.row_number().over(W.partitionBy("window").orderBy(*ranking()))
    return summary.withColumn("place", place).where(F.col("place") <= most).orderBy(*ranking())


def by_window(summary: DataFrame) -> DataFrame:
    return summary.groupBy("window").agg(
        F.median("error_rmse").alias("median_rmse"), F.min("error_rmse").alias("best_rmse"),
        F.median("explained_pnl_variance").alias("median_explained"), F.max("explained_pnl_variance").alias("best_explained")).orderBy("window")


def by_group(summary: DataFrame, most: int = 30) -> DataFrame:
    """By family, transform and estimator; a null of these is a group of its own."""
    keys = ["family", "transform", F.col("spec_covariance_method").alias("covariance")]
    grouped = summary.groupBy(*keys).agg(F.min("error_rmse").alias("best_rmse"), F.median("error_rmse").alias("median_rmse"), F.max("explained_pnl_variance").alias("best_explained"))
    return grouped.orderBy(F.asc_nulls_last("best_rmse"), "family", "transform", "covariance").limit(most)


def best_spec(summary: DataFrame, specs: Sequence[Spec]) -> tuple[Spec, int]:
    """The leaderboard's first and its window; names are keys, the first of equal names counts."""
    row = best_model(summary).first()
    if row is None:
        raise ValueError("no model has a prediction")
    return next(s for s in specs if s.name == row["model"]), row["window"]


def best_model(summary: DataFrame) -> DataFrame:
    """The leaderboard's first row, with its spec."""
    return leaderboard(summary.where("error_rmse is not null"), 1)
