"""Factor models of moves: weighted PCA and two-way (separable) projection.

A model is fitted from the sums of its training rows (see ``sums``), which are of the size of the grid; rows are then projected where they are.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import linalg
from ..functions.tables import small_table
from .moves import dot
from .sums import Moments, fold_moments, merged, stacked, whole_sums

Array = np.ndarray


@dataclass(frozen=True)
class Spec:
    """One candidate model."""

    name: str
    family: str = "pca"
    transform: str = "absolute"
    n_components: int = 3
    covariance_method: str = "sample"
    shrinkage_alpha: float = 0.0
    factor_rank: int = 3
    vega_weight_power: float = 0.0
    weight_min: float = 0.10
    weight_max: float = 5.0
    r_expiry: int = 3
    r_tenor: int = 3

    def fit_key(self) -> tuple:
        """Specs with one key differ in how many factors they keep and share a decomposition."""
        if self.family == "separable":
            return (self.family, self.transform)
        return (self.family, self.transform, self.covariance_method, self.shrinkage_alpha, self.factor_rank, self.weighting())

    def weighting(self) -> str:
        """Specs with one name weigh the buckets alike."""
        return f"{self.vega_weight_power}:{self.weight_min}:{self.weight_max}" if self.family == "pca" and self.vega_weight_power else "even"


def specs_frame(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    return small_table(spark, [tuple(asdict(s).values()) for s in specs], schemas.SPECS)


def spec_columns() -> list[str]:
    return [f.name for f in fields(Spec)]


def default_specs() -> list[Spec]:
    """The standard grid of candidates. Names and parameters, which appear in the results."""
    found = [Spec(f"Abs PCA sample k={k}", n_components=k) for k in (1, 2, 3, 5, 8, 10)]
    for short, transform in (("Rel", "relative"), ("LogRel", "log_relative")):
        found += [Spec(f"{short} PCA sample k={k}", transform=transform, n_components=k) for k in (2, 3, 5, 8)]
    found += [Spec(f"Abs weighted PCA p={p} k={k}", vega_weight_power=p, n_components=k) for p in (0.25, 0.5, 1.0) for k in (3, 5, 8)]
    found += [Spec(f"Abs PCA {m} k={k}", covariance_method=m, n_components=k) for m in ("ledoit_wolf", "oas") for k in (3, 5, 8)]
    shrunk = ("diagonal_shrink", "correlation_shrink", "factor_diag", "separable_shrink")
    found += [Spec(f"Abs PCA {m} alpha={a} k={k}", covariance_method=m, shrinkage_alpha=a, n_components=k) for m in shrunk for a in (0.2, 0.5, 0.8) for k in (3, 5, 8)]
    found += [Spec(f"Separable PCA rE={e} rT={t}", family="separable", r_expiry=e, r_tenor=t) for e, t in ((1, 1), (2, 2), (3, 2), (2, 3), (3, 3), (4, 3), (3, 4))]
    return found


def kernel_weights(vega: Array, spec: Spec, epsilon: float = 1e-8) -> Array:
    size = np.abs(vega)
    positive = size[size > epsilon]
    scale = float(np.median(positive)) if len(positive) else 1.0
    raw = ((size + epsilon) / (scale + epsilon)) ** spec.vega_weight_power
    return np.ones_like(size) if spec.vega_weight_power == 0 else np.clip(raw, spec.weight_min, spec.weight_max)


@dataclass
class PcaFit:
    """Decomposition of weighted, centred rows; ``vectors`` has all factors as columns."""

    mean: Array
    weights: Array
    values: Array
    vectors: Array

    def components(self, k: int) -> Array:
        return self.vectors[:, : min(k, len(self.values))]

    def scores(self, x: Array, k: int) -> Array:
        return ((x - self.mean) * self.weights) @ self.components(k)

    def reconstruct(self, x: Array, k: int) -> Array:
        return self.scores(x, k) @ self.components(k).T / self.weights + self.mean

    def loadings(self, k: int) -> Array:
        """Factors in the units of the moves, one a row."""
        return self.components(k).T / self.weights


@dataclass
class TwoWayFit:
    """Factors along both axes of the grid."""

    mean: Array
    along_expiry: Array
    along_tenor: Array
    expiry_values: Array
    tenor_values: Array

    def cube(self, x: Array) -> Array:
        return (x - self.mean).reshape(len(x), len(self.along_expiry), len(self.along_tenor))

    def scores(self, x: Array, e: int, t: int) -> Array:
        return np.einsum("nij,ia,jb->nab", self.cube(x), self.along_expiry[:, :e], self.along_tenor[:, :t])

    def reconstruct(self, x: Array, e: int, t: int) -> Array:
        back = np.einsum("nab,ia,jb->nij", self.scores(x, e, t), self.along_expiry[:, :e], self.along_tenor[:, :t])
        return back.reshape(len(x), -1) + self.mean


def fit_weights(spec: Spec, vega: Array) -> Array:
    return np.ones(len(vega)) if spec.weighting() == "even" else np.maximum(kernel_weights(vega, spec), 1e-12)


def fit_sums(sums: Moments, spec: Spec, vega: Array, dims: tuple[int, int], demean: bool = True) -> PcaFit | TwoWayFit:
    """The model of the rows whose weighted sums these are; without ``demean`` their mean counts as 0."""
    if demean:
        mean, products, fourth = sums.centred()
    else:
        mean = np.zeros(len(vega))
        products, _, fourth = sums.about(mean)
    if spec.family == "pca":
        weights = fit_weights(spec, vega)
        cov = linalg.covariance_from_sums(sums.n, products, fourth, spec.covariance_method, spec.shrinkage_alpha, spec.factor_rank, dims)
        return PcaFit(mean / weights, weights, *linalg.eigen_descending(cov))
    if spec.family == "separable":
        (ev, a), (tv, b) = (linalg.eigen_descending(c) for c in linalg.two_way_from_products(products, sums.n, *dims))
        return TwoWayFit(mean, a, b, ev, tv)
    raise ValueError(f"no model family named {spec.family}")


def fit(x: Array, spec: Spec, vega: Array, dims: tuple[int, int], demean: bool = True) -> PcaFit | TwoWayFit:
    """The model of a few rows at hand."""
    return fit_sums(Moments.of(x * fit_weights(spec, vega)), spec, vega, dims, demean)


def reconstruct(model: PcaFit | TwoWayFit, x: Array, spec: Spec) -> Array:
    return model.reconstruct(x, spec.n_components) if isinstance(model, PcaFit) else model.reconstruct(x, spec.r_expiry, spec.r_tenor)


def absolute(x: Array, prev: Array, transform: str, linear: bool = False) -> Array:
    """Absolute moves for moves of a transform; ``linear`` to first order."""
    if transform == "absolute":
        return x
    return prev * x if linear or transform == "relative" else prev * (np.exp(x) - 1)


def contributions(model: PcaFit | TwoWayFit, x: Array, prev: Array, vega: Array, spec: Spec) -> dict[str, Array]:
    """PnL of each factor, to first order and without the mean: ``PC1`` and on, or ``E1xT1`` and on."""
    price = np.broadcast_to(vega, x.shape) if spec.transform == "absolute" else prev * vega
    if isinstance(model, PcaFit):
        scores, loadings = model.scores(x, spec.n_components), model.loadings(spec.n_components)
        return {f"PC{j + 1}": scores[:, j] * (price @ loadings[j]) for j in range(len(loadings))}
    scores = model.scores(x, spec.r_expiry, spec.r_tenor)
    sides = [(i, j) for i in range(scores.shape[1]) for j in range(scores.shape[2])]
    return {f"E{i + 1}xT{j + 1}": scores[:, i, j] * (price @ np.outer(model.along_expiry[:, i], model.along_tenor[:, j]).ravel()) for i, j in sides}


# ---- fits over tables of move vectors -------------------------------------------------------------

MODEL_COLUMNS = "n int, mean array<double>, weights array<double>, eigenvalues array<double>, factors array<array<double>>, tenor_values array<double>, tenor_factors array<array<double>>"


def model_row(model: PcaFit | TwoWayFit, n: float, most: int) -> dict:
    """A model's columns; the two-way family also has tenor_values and tenor_factors."""
    if isinstance(model, PcaFit):
        return {"n": int(n), "mean": model.mean.tolist(), "weights": model.weights.tolist(), "eigenvalues": model.values.tolist(), "factors": model.components(most).T.tolist(), "tenor_values": None, "tenor_factors": None}
    return {"n": int(n), "mean": model.mean.tolist(), "weights": None, "eigenvalues": model.expiry_values.tolist(), "factors": model.along_expiry.T.tolist(), "tenor_values": model.tenor_values.tolist(), "tenor_factors": model.along_tenor.T.tolist()}


def fit_rows(rows: DataFrame, spec: Spec, vega: Array, dims: tuple[int, int]) -> PcaFit | TwoWayFit:
    """Fits all rows (t, x) as one training set."""
    return fit_sums(whole_sums(rows, fit_weights(spec, vega)), spec, vega, dims)


def model_frame(spark: SparkSession, model: PcaFit | TwoWayFit, n: float = 0, most: int = 10) -> DataFrame:
    """A fitted model as a table of one row."""
    return small_table(spark, [tuple(model_row(model, n, most).values())], MODEL_COLUMNS)


def fold_models(rows: DataFrame, window: int, step: int, block: int, spec: Spec, vega: Array, dims: tuple[int, int], most: int = 10) -> DataFrame:
    """One model a refit on the ``window`` rows (t, date, x) before every ``step``-th row, with fold and end_date. Failed fits have a null model and say why."""
    parts = fold_moments(rows.withColumn("kind", F.lit("all")), {"all": {"all": fit_weights(spec, vega)}}, [(window, window)], step, block)
    names = [c.split(" ")[0] for c in MODEL_COLUMNS.split(", ")]
    schema = f"fold int, {MODEL_COLUMNS}, failure string, end_date date"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = merged(group["moments"])
        own = {"fold": int(group["fold"].iloc[0]), **dict.fromkeys(names), "failure": None, "end_date": max(group["high"])}
        try:
            own |= model_row(fit_sums(total, spec, vega, dims), total.n, most)
        except Exception as error:  # one training set's failure is its own
            own["failure"] = f"{type(error).__name__}: {error}"
        return pd.DataFrame({k: pd.Series([v] if total.n == window else [], dtype=object) for k, v in own.items()})

    return parts.groupBy("fold").applyInPandas(run, schema)


def literal(values: Array) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def priced(rows: DataFrame, model: PcaFit | TwoWayFit, spec: Spec, vega: Array) -> DataFrame:
    """(t, date, full_pnl, projected_pnl) of rows, with plain column expressions.

    The factors are priced before they meet the rows. An absolute row's projected PnL is one sum over its buckets; a relative one takes a score and a
    price a factor; only log moves, which are not linear, are rebuilt by bucket.
    """
    mean, factor, scale = price_parts(model, spec)
    full = dot("dvol", literal(vega))
    if spec.transform == "absolute":
        along = factor @ (scale @ vega)  # what a move in each bucket is worth
        hat = dot("x", literal(along)) + F.lit(float(mean @ vega - mean @ along))
    else:
        scores = F.array(*(dot("x", literal(f)) - F.lit(float(mean @ f)) for f in factor.T))
        if spec.transform == "relative":
            prices = F.array(*(dot("prev", literal(s * vega)) for s in scale))
            hat = dot("prev", literal(mean * vega)) + dot(scores, prices)
        else:
            by_bucket = [literal(np.concatenate([[m], s])) for m, s in zip(mean, scale.T, strict=True)]
            back = F.transform(F.array(*by_bucket), lambda row: dot(row, "with_one"))
            rows = rows.withColumn("with_one", F.concat(F.array(F.lit(1.0)), scores))
            hat = dot(F.zip_with("prev", back, lambda p, h: p * (F.exp(h) - 1)), literal(vega))
    return rows.select("t", "date", full.alias("full_pnl"), hat.alias("projected_pnl"))


def price_parts(model: PcaFit | TwoWayFit, spec: Spec) -> tuple[Array, Array, Array]:
    """Mean, what makes scores of a centred row (a column a factor), and what makes moves of scores (a row a factor)."""
    if isinstance(model, PcaFit):
        return model.mean, model.weights[:, None] * model.components(spec.n_components), model.loadings(spec.n_components)
    plane = np.einsum("ia,jb->abij", model.along_expiry[:, : spec.r_expiry], model.along_tenor[:, : spec.r_tenor]).reshape(-1, len(model.mean))
    return model.mean, plane.T, plane


def projected_pnl(model: PcaFit | TwoWayFit, x: Array, prev: Array | None, spec: Spec, vega: Array) -> Array:
    """The projected PnL of rows at hand; ``prev`` is not needed for absolute moves."""
    mean, factor, scale = price_parts(model, spec)
    scores = (x - mean) @ factor
    if spec.transform == "absolute":
        return mean @ vega + scores @ (scale @ vega)
    if spec.transform == "relative":
        return prev @ (mean * vega) + (scores * (prev @ (scale * vega).T)).sum(axis=1)
    return (prev * (np.exp(mean + scores @ scale) - 1)) @ vega


def projected(rows: DataFrame, model: PcaFit | TwoWayFit, spec: Spec) -> DataFrame:
    """Rows rebuilt by a model, bucket by bucket: t, date, dvol, dvol_hat."""
    def run(batches):
        for batch in batches:
            hat = absolute(reconstruct(model, stacked(batch["x"]), spec), stacked(batch["prev"]), spec.transform)
            yield pd.DataFrame({"t": batch["t"], "date": batch["date"], "dvol": batch["dvol"], "dvol_hat": hat.tolist()})

    return rows.select("t", "date", "x", "dvol", "prev").mapInPandas(run, "t long, date date, dvol array<double>, dvol_hat array<double>")


def contribution_rows(rows: DataFrame, model: PcaFit | TwoWayFit, spec: Spec, vega: Array) -> DataFrame:
    """(t, date, component, pnl) of a model's factors on rows."""
    def run(batches):
        for batch in batches:
            parts = contributions(model, stacked(batch["x"]), stacked(batch["prev"]), vega, spec)
            for name, pnl in parts.items():
                yield pd.DataFrame({"t": batch["t"], "date": batch["date"], "component": pd.Series([name] * len(pnl), dtype=object), "pnl": pnl})

    return rows.select("t", "date", "x", "prev").mapInPandas(run, "t long, date date, component string, pnl double")


def eigenvalues(cov: DataFrame) -> DataFrame:
    """(rank, eigenvalue) of a covariance (i, j, c) with i <= j; the matrix is as large as the grid is."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group[["i", "j"]].max().max()) + 1
        m = np.zeros((n, n))
        m[group["i"], group["j"]] = m[group["j"], group["i"]] = group["c"]
        return pd.DataFrame({"rank": np.arange(1, n + 1), "eigenvalue": linalg.eigen_descending(m)[0]})

    return cov.groupBy().applyInPandas(run, "rank int, eigenvalue double")


def tucker_errors(rows: DataFrame, dims: tuple[int, int], ranks: list[tuple[int, int, int]]) -> DataFrame:
    """(rank_t, rank_e, rank_m, rmse) of Tucker models of the centred cube.

    The time mode enters only through the Gram matrix of the cells: a cube of as many rows as cells and with the same Gram matrix
    has the same core, grid factors and norm of the error. So rows are summed up where they are, and the kernel's cube is as large as the grid is.
    """
    size = dims[0] * dims[1]
    means = rows.select(F.posexplode("x").alias("bucket", "x")).groupBy("bucket").agg(F.avg("x").alias("mean"))
    means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "mean"))), lambda s: s["mean"]).alias("means"))
    centred = rows.crossJoin(F.broadcast(means)).select(F.zip_with("x", "means", lambda x, mean: x - mean).alias("x"))

    def products(batches):
        n, total = 0, np.zeros((size, size))
        for batch in batches:
            x = stacked(batch["x"])
            n, total = n + len(x), total + (x.T @ x if len(x) else 0)
        if n:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel(), "n": n})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros((size, size))
        gram[group["i"], group["j"]] = group["g"]
        values, vectors = linalg.eigen_descending(gram)
        cube = (np.sqrt(np.maximum(values, 0))[:, None] * vectors.T).reshape(size, *dims)
        scale = np.sqrt(size / group["n"].iloc[0])
        return pd.DataFrame([(*r, linalg.tucker(cube, r)[2] * scale) for r in ranks], columns=["rank_t", "rank_e", "rank_m", "rmse"])

    summed = centred.mapInPandas(products, "i long, j long, g double, n long").groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    return summed.groupBy().applyInPandas(run, "rank_t int, rank_e int, rank_m int, rmse double")
