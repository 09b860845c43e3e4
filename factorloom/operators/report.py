"""The report on the chosen model: residual risk, component statistics, stability, matrices for display."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import factors
from .factors import Spec
from .folds import block_size, latest_rows
from .grid import align_vega
from .moves import move_rows
from .validate import best_spec, dims_of, pnl_metrics, summary, vega_array, walk_forward


def residual_cells(fit: DataFrame, grid: DataFrame) -> DataFrame:
    """(t, bucket, expiry, tenor, dvol, residual) of projected rows."""
    cells = fit.select("t", F.posexplode(F.arrays_zip("dvol", "dvol_hat")).alias("bucket", "c"))
    return cells.select("t", "bucket", F.col("c.dvol").alias("dvol"), (F.col("c.dvol") - F.col("c.dvol_hat")).alias("residual")).join(F.broadcast(grid.select("bucket", "expiry", "tenor")), "bucket")


def residual_risk(fit: DataFrame, grid: DataFrame, vega: DataFrame, with_noise: bool = True) -> DataFrame:
    """By bucket: vega, residual_vol, residual_risk = |vega| * residual_vol, and the residual's share of the moves' variance; riskiest first."""
    spread = residual_cells(fit, grid).groupBy("bucket").agg(F.stddev_samp("residual").alias("residual_vol"), (F.var_samp("residual") / F.greatest(F.var_samp("dvol"), F.lit(1e-16))).alias("noise_ratio"))
    joined = align_vega(grid, vega).join(spread, "bucket").withColumn("residual_risk", F.abs("vega") * F.col("residual_vol"))
    columns = ["bucket", "expiry", "tenor", "vega", "residual_vol", "residual_risk", *(["noise_ratio"] if with_noise else [])]
    return joined.select(*columns).orderBy(F.desc_nulls_last("residual_risk"), "bucket")


def residual_factors(fit: DataFrame, grid: DataFrame, most: int = 5) -> DataFrame:
    """(rank, eigenvalue, loadings) of an unweighted model of the residual moves."""
    dims = dims_of(grid)
    rows = fit.select("t", F.zip_with("dvol", "dvol_hat", lambda a, b: a - b).alias("x"))
    model = factors.fit_rows(rows, Spec("residual", n_components=most), np.ones(dims[0] * dims[1]), dims)
    one = factors.model_frame(fit.sparkSession, model, most=most).select(F.posexplode(F.slice("eigenvalues", 1, most)).alias("pos", "eigenvalue"), "factors")
    return one.select((F.col("pos") + 1).alias("rank"), "eigenvalue", F.get("factors", F.col("pos")).alias("loadings")).orderBy("rank")


def component_stats(contributions: DataFrame) -> DataFrame:
    pnl = F.col("pnl")
    return contributions.groupBy("component").agg(
        F.avg(pnl).alias("mean_contribution"), F.stddev_samp(pnl).alias("std_contribution"), F.avg(F.abs(pnl)).alias("avg_abs_contribution"), F.max(F.abs(pnl)).alias("max_abs_contribution"),
    ).orderBy(F.desc_nulls_last("avg_abs_contribution"), "component")


def top_component_pnl(contributions: DataFrame, most: int = 6) -> DataFrame:
    """(t, date, pnl): the sum of the components that are largest by mean size."""
    top = component_stats(contributions).limit(most).select("component")
    return contributions.join(F.broadcast(top), "component", "left_semi").groupBy("t", "date").agg(F.sum("pnl").alias("pnl"))


def loadings(models: DataFrame, grid: DataFrame, most: int = 6) -> DataFrame:
    """(component, bucket, expiry, tenor, loading): PCA factors in the moves' units, or the two-way family's products of an expiry and a tenor factor, expiry by expiry."""
    tenors = F.broadcast(grid.agg((F.max("t_idx") + 1).alias("tenors")))
    one = models.where("tenor_factors is null").select(F.posexplode(F.slice("factors", 1, most)).alias("j", "f"), "weights")
    one = one.select(F.concat(F.lit("PC"), (F.col("j") + 1).cast("string")).alias("component"), F.posexplode(F.zip_with("f", "weights", lambda f, w: f / w)).alias("bucket", "loading"))
    two = models.where("tenor_factors is not null").crossJoin(tenors).select(F.posexplode("factors").alias("i", "f"), "tenor_factors", "tenors").select("i", "f", F.posexplode("tenor_factors").alias("j", "g"), "tenors")
    two = two.where(F.col("i") * F.col("tenors") + F.col("j") < most * F.col("tenors")).select(F.concat(F.lit("E"), (F.col("i") + 1).cast("string"), F.lit("xT"), (F.col("j") + 1).cast("string")).alias("component"), F.posexplode("f").alias("e", "a"), "g", "tenors")
    two = two.select("component", "e", "a", F.posexplode("g").alias("m", "b"), "tenors").select("component", (F.col("e") * F.col("tenors") + F.col("m")).alias("bucket"), (F.col("a") * F.col("b")).alias("loading"))
    return one.unionByName(two).join(F.broadcast(grid.select("bucket", "expiry", "tenor")), "bucket").select("component", "bucket", "expiry", "tenor", "loading")


def projector(models: DataFrame, k: int) -> DataFrame:
    """(i, j, p): the projector onto a model's first k factors."""
    factor = models.select(F.posexplode(F.slice("factors", 1, k)).alias("rank", "f"))
    cells = factor.select("f", F.posexplode("f").alias("i", "a")).select("i", "a", F.posexplode("f").alias("j", "b"))
    return cells.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("p"))


def rolling_models(rows: DataFrame, spec: Spec, vega: np.ndarray, dims: tuple[int, int], window: int, step: int = 20) -> DataFrame:
    """One fitted model a refit, with fold and end_date; failed ones say why."""
    return factors.fold_models(rows, window, step, block_size([window], step), spec, vega, dims, max(spec.n_components, spec.r_expiry, spec.r_tenor))


def distance(a: str, b: str, k: int):
    """Frobenius distance of the projectors onto the first k of two arrays of orthonormal factors: sqrt(2k - 2 |A'B|^2)."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda u: F.aggregate(F.transform(F.slice(b, 1, k), lambda v: F.pow(dot(u, v), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    overlap = F.aggregate(F.transform(F.slice(a, 1, k), square), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(2 * F.lit(float(k)) - 2 * overlap, F.lit(0.0)))


def stability(models: DataFrame, spec: Spec) -> DataFrame:
    """Distance of each model's factor space from that of the model before it: fold, end_date, and distance (PCA) or expiry_distance and tenor_distance."""
    before = W.orderBy("fold")  # one row a refit
    paired = models.where("failure is null").select("fold", "end_date", "factors", "tenor_factors", F.lag("factors").over(before).alias("old"), F.lag("tenor_factors").over(before).alias("old_tenor")).where("old is not null")
    if spec.family == "pca":
        return paired.select("fold", "end_date", distance("old", "factors", spec.n_components).alias("distance"))
    return paired.select("fold", "end_date", distance("old", "factors", spec.r_expiry).alias("expiry_distance"), distance("old_tenor", "tenor_factors", spec.r_tenor).alias("tenor_distance"))


@dataclass
class Report:
    """What the latest fit says, one table each."""

    models: DataFrame
    metrics: DataFrame
    pnl: DataFrame
    contributions: DataFrame
    components: DataFrame
    residual_risk: DataFrame


def latest_report(surface: DataFrame, grid: DataFrame, vega: DataFrame, spec: Spec, window: int) -> Report:
    """Fits the model on the last ``window`` moves and describes it on the same rows. The book must hold every bucket."""
    price, dims = vega_array(grid, vega, on_missing="error"), dims_of(grid)
    rows = latest_rows(move_rows(surface, grid, spec.transform), window)
    model = factors.fit_rows(rows, spec, price, dims)
    fit = factors.projected(rows, model, spec)
    pnl = factors.priced(rows, model, spec, price).withColumn("error", F.col("full_pnl") - F.col("projected_pnl"))
    parts = factors.contribution_rows(rows, model, spec, price)
    models = factors.model_frame(surface.sparkSession, model, window, max(spec.n_components, spec.r_expiry, spec.r_tenor))
    return Report(models, pnl_metrics(pnl), pnl, parts, component_stats(parts), residual_risk(fit, grid, vega, with_noise=False))


def best_report(surface: DataFrame, grid: DataFrame, vega: DataFrame, specs: list[Spec], windows: list[int], horizon: int = 20, step: int = 20) -> tuple[Spec, int, Report]:
    """Walks all specs forward, takes the best and reports on its latest fit."""
    tried = summary(walk_forward(surface, grid, vega, specs, windows, horizon, step), factors.specs_frame(surface.sparkSession, specs), windows)
    spec, window = best_spec(tried, specs)
    return spec, window, latest_report(surface, grid, vega, spec, window)


def scatter_bounds(pnl: DataFrame) -> DataFrame:
    """The range of the identity line under full against projected PnL."""
    return pnl.agg(F.least(F.min("full_pnl"), F.min("projected_pnl")).alias("low"), F.greatest(F.max("full_pnl"), F.max("projected_pnl")).alias("high"))
