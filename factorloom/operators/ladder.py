"""Projection of a fine vega ladder onto a coarse one, with diagnostics.

The basis is a table of its non-zero weights (o, r, w). What is solved or measured starts from one row, the triangle of [B y], which is made where
the buckets are (see ``tall``) and has the size of the coarse ladder squared; its results go back to the buckets as one row beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import linalg
from .tall import matrix_of, triangle


def hat_weights(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(i, k, w): weights of each point (i, years) on the nodes (i as k, years), linear in log time and held at both ends."""
    ends = W.orderBy("years")
    at = nodes.select(F.col("i").alias("k"), F.log("years").alias("node"), F.log(F.lag("years").over(ends)).alias("lo"), F.log(F.lead("years").over(ends)).alias("hi"))
    span = nodes.agg(F.log(F.min("years")).alias("first"), F.log(F.max("years")).alias("last"))
    x = points.crossJoin(F.broadcast(span)).select("i", F.least(F.greatest(F.log("years"), "first"), "last").alias("x"))
    node, lo, hi, v = (F.col(c) for c in ("node", "lo", "hi", "x"))
    rising, falling = F.try_divide(v - lo, node - lo), F.try_divide(hi - v, hi - node)
    w = F.when(v == node, 1.0).when((v > lo) & (v < node), rising).when((v > node) & (v < hi), falling)
    return x.crossJoin(F.broadcast(at)).select("i", "k", w.alias("w")).where("w > 0")


def bilinear_basis(fine_expiries: DataFrame, fine_tenors: DataFrame, expiries: DataFrame, tenors: DataFrame) -> DataFrame:
    """(o, r, w): the product of the two axes' weights. Fine bucket o and coarse bucket r count tenors fastest. Axes are (i, years)."""
    size = fine_tenors.agg(F.count("*").cast("int").alias("n")).crossJoin(tenors.agg(F.count("*").cast("int").alias("m")))
    n, m = F.col("n"), F.col("m")
    e = hat_weights(fine_expiries, expiries).toDF("ei", "ek", "ew")
    t = hat_weights(fine_tenors, tenors).toDF("ti", "tk", "tw")
    return e.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(size)).select((F.col("ei") * n + F.col("ti")).alias("o"), (F.col("ek") * m + F.col("tk")).alias("r"), (F.col("ew") * F.col("tw")).alias("w"))


def bilinear(fine: DataFrame, basis: DataFrame) -> DataFrame:
    """(r, v): each fine bucket's vega dealt by its weights, so the total stays."""
    return fine.join(F.broadcast(basis), "o").groupBy("r").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def bucket_rows(fine: DataFrame, basis: DataFrame) -> DataFrame:
    """(o, v, entries): each fine bucket's vega (null if the ladder lacks it) beside its weights as an array of (r, w)."""
    rows = basis.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("r", "w"))).alias("entries"))
    return rows.join(fine.select("o", "v"), "o", "left").select("o", "v", "entries")


def dense_rows(batch: pd.DataFrame, m: int) -> np.ndarray:
    """Rows of [B y] of a batch of bucket rows."""
    out = np.zeros((len(batch), m + 1))
    for i, (v, entries) in enumerate(zip(batch["v"], batch["entries"], strict=True)):
        out[i, [e["r"] for e in entries]] = [e["w"] for e in entries]
        out[i, m] = 0.0 if v is None or np.isnan(v) else v
    return out


def normal_row(fine: DataFrame, basis: DataFrame, m: int) -> DataFrame:
    """(r): the triangle of [B y], one row of (m + 1) squared numbers. R'R holds B'B, B'y and y'y, so all that is solved or measured below starts from it."""
    return triangle(bucket_rows(fine, basis), m + 1, lambda batch: dense_rows(batch, m))


def gram_of(flat: Iterable[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """B'B, B'y and the triangle of [B y]."""
    r = matrix_of(flat)
    whole = r.T @ r
    return whole[:-1, :-1], whole[:-1, -1], r


def total_constraint(fine: DataFrame, basis: DataFrame) -> DataFrame:
    """(c, r, a): the coarse ladder sums to the fine one; r null holds the right-hand side."""
    ones = basis.select(F.lit(0).alias("c"), "r", F.lit(1.0).alias("a")).distinct()
    return ones.unionByName(fine.agg(F.sum("v").alias("a")).select(F.lit(0).alias("c"), F.lit(None).cast("int").alias("r"), "a"))


def row_constraints(fine: DataFrame, expiry_basis: DataFrame, coarse_tenors: int) -> DataFrame:
    """One constraint a coarse expiry: its row sums to the fine vega dealt to it by the expiry axis's weights (i, k, w). ``fine`` has e_idx."""
    rhs = fine.join(F.broadcast(expiry_basis), fine["e_idx"] == expiry_basis["i"]).groupBy(F.col("k").alias("c")).agg(F.sum(F.col("w") * F.col("v")).alias("a"))
    left = rhs.select("c", F.explode(F.sequence(F.col("c") * coarse_tenors, F.col("c") * coarse_tenors + coarse_tenors - 1)).alias("r"), F.lit(1.0).alias("a"))
    return left.unionByName(rhs.select("c", F.lit(None).cast("int").alias("r"), "a"))


def smoothness(expiries: int, tenors: int) -> np.ndarray:
    """D'D of first differences between neighbours along both axes of the coarse ladder."""
    along = lambda n: np.diff(np.eye(n), axis=0)
    d = np.vstack([np.kron(along(expiries), np.eye(tenors)), np.kron(np.eye(expiries), along(tenors))])
    return d.T @ d


def constraint_arrays(rows: Iterable, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right sides of (c, r, a): as many numbers as constraints times the coarse ladder."""
    rows = [(x["c"], x["r"], x["a"]) for x in rows]
    names = sorted({c for c, _, _ in rows})
    a, b = np.zeros((len(names), m)), np.zeros(len(names))
    for c, r, x in rows:
        if pd.isna(r):
            b[names.index(c)] = x
        else:
            a[names.index(c), int(r)] = x
    return a, b


def with_constraints(row: DataFrame, constraints: DataFrame) -> DataFrame:
    """A one-row table beside the constraints as an array ``rules``."""
    return row.crossJoin(F.broadcast(constraints.agg(F.collect_list(F.struct("c", "r", "a")).alias("rules"))))


def solve(normal: DataFrame, constraints: DataFrame, m: int, penalty: np.ndarray | None = None) -> DataFrame:
    """(r, v): constrained least squares, with ``penalty`` (m by m, as lambda D'D) added to B'B. A singular system raises (contradictory or repeated constraints)."""
    def run(batches):
        for batch in batches:
            for flat, rules in zip(batch["r"], batch["rules"], strict=True):
                gram, rhs, _ = gram_of(flat)
                v = linalg.constrained_least_squares(gram if penalty is None else gram + penalty, rhs, *constraint_arrays(rules, m))
                yield pd.DataFrame({"r": np.arange(m), "v": v})

    return with_constraints(normal, constraints).mapInPandas(run, "r int, v double")


def constrained_ladder(fine: DataFrame, basis: DataFrame, constraints: DataFrame, m: int) -> DataFrame:
    return solve(normal_row(fine, basis, m), constraints, m)


def smoothed_ladder(fine: DataFrame, basis: DataFrame, constraints: DataFrame, dims: tuple[int, int], strength: float) -> DataFrame:
    """(r, v): Tikhonov-regularised: neighbours on the coarse ladder are drawn together by ``strength`` times their squared differences; the constraints hold exactly."""
    return solve(normal_row(fine, basis, dims[0] * dims[1]), constraints, dims[0] * dims[1], strength * smoothness(*dims))


def residuals(fine: DataFrame, basis: DataFrame, coarse: DataFrame) -> DataFrame:
    """(o, v, fitted, residual)."""
    fitted = basis.join(F.broadcast(coarse.withColumnRenamed("v", "x")), "r").groupBy("o").agg(F.sum(F.col("w") * F.col("x")).alias("fitted"))
    return fine.join(fitted, "o").select("o", "v", "fitted", (F.col("v") - F.col("fitted")).alias("residual"))


def on_triangle(normal: DataFrame, run: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What ``run`` makes of the triangle of B and of the column beside it."""
    def each(batches):
        for batch in batches:
            for flat in batch["r"]:
                yield run(matrix_of(flat))

    return normal.mapInPandas(each, schema)


def inverse_of(triangle: np.ndarray) -> np.ndarray:
    """The pseudo-inverse of B'B."""
    half = np.linalg.pinv(triangle[:, :-1])
    return half @ half.T


def leverage(fine: DataFrame, basis: DataFrame, m: int) -> DataFrame:
    """(o, leverage): the diagonal of the hat matrix; a fine bucket meets only its own few weights."""
    g = on_triangle(normal_row(fine, basis, m), lambda r: pd.DataFrame({"g": [inverse_of(r).ravel().tolist()]}), "g array<double>")
    return bucket_rows(fine, basis).crossJoin(F.broadcast(g)).select("o", hat_diagonal(m).alias("leverage"))


def hat_diagonal(m: int) -> Column:
    """w' G w of a bucket's entries, G flat in column g."""
    add = lambda s, x: s + x
    against = lambda a: F.aggregate(F.transform("entries", lambda b: a["w"] * b["w"] * F.get("g", a["r"] * m + b["r"])), F.lit(0.0), add)
    return F.aggregate(F.transform("entries", against), F.lit(0.0), add)


def leave_one_out(residual: DataFrame, leverage: DataFrame) -> DataFrame:
    """(o, residual, leverage, loo): residuals over 1 - leverage (at least 1e-6)."""
    return residual.join(leverage, "o").select("o", "residual", "leverage", (F.col("residual") / F.greatest(1 - F.col("leverage"), F.lit(1e-6))).alias("loo"))


def singular_values(fine: DataFrame, basis: DataFrame, m: int) -> DataFrame:
    """(rank, sigma) of the basis, from its triangle."""
    run = lambda r: pd.DataFrame({"rank": np.arange(1, m + 1), "sigma": np.linalg.svd(r[:, :-1], compute_uv=False)})
    return on_triangle(normal_row(fine, basis, m), run, "rank int, sigma double")


SOLVED = "x array<double>, g array<double>, condition double, captured double"


def solved_row(normal: DataFrame, constraints: DataFrame, m: int) -> DataFrame:
    """One row: the constrained ladder x, the pseudo-inverse g of B'B, the basis's condition (null if singular), and the squared size of the part of the vega that the basis can make."""
    def run(batches):
        for batch in batches:
            for flat, rules in zip(batch["r"], batch["rules"], strict=True):
                gram, rhs, r = gram_of(flat)
                sigma, g = np.linalg.svd(r[:, :-1], compute_uv=False), inverse_of(r)
                x = linalg.constrained_least_squares(gram, rhs, *constraint_arrays(rules, m))
                yield pd.DataFrame({"x": [x.tolist()], "g": [g.ravel().tolist()], "condition": pd.Series([sigma[0] / sigma[-1] if sigma[-1] else None], dtype=object), "captured": [rhs @ g @ rhs]})

    return with_constraints(normal, constraints).mapInPandas(run, SOLVED)


def buckets(fine: DataFrame, basis: DataFrame, solved: DataFrame, m: int) -> DataFrame:
    """(o, v, fitted, residual, leverage, loo) of every fine bucket, each from its own few weights and the one solved row."""
    rows = bucket_rows(fine, basis).where("v is not null").crossJoin(F.broadcast(solved))
    fitted = F.aggregate(F.transform("entries", lambda e: e["w"] * F.get("x", e["r"])), F.lit(0.0), lambda s, v: s + v)
    found = rows.select("o", "v", fitted.alias("fitted"), hat_diagonal(m).alias("leverage"), "captured", "condition", "x").withColumn("residual", F.col("v") - F.col("fitted"))
    return found.withColumn("loo", F.col("residual") / F.greatest(1 - F.col("leverage"), F.lit(1e-6)))


def summary(fine: DataFrame, basis: DataFrame, constraints: DataFrame, m: int, samples: DataFrame) -> DataFrame:
    """One row of quality figures; ``samples`` are the bootstrap's."""
    cells = buckets(fine, basis, solved_row(normal_row(fine, basis, m), constraints, m), m)
    row = cells.agg(
        F.count("*").alias("original_buckets"), F.sum("v").alias("total_original"), F.sqrt(F.avg(F.col("residual") ** 2)).alias("rmse"), F.avg(F.abs("residual")).alias("mae"),
        F.max(F.abs("residual")).alias("max_abs_residual"), F.max_by("o", F.struct(F.abs("residual"), -F.col("o"))).alias("worst_bucket"),
        (1 - F.sum(F.col("residual") ** 2) / F.nullif(F.var_pop("v") * F.count("*"), F.lit(0.0))).alias("r2"), F.sqrt(F.avg(F.col("loo") ** 2)).alias("loo_rmse"),
        F.avg("leverage").alias("mean_leverage"), F.max("leverage").alias("max_leverage"), F.sum(F.col("v") ** 2).alias("energy"),
        *(F.any_value(c).alias(c) for c in ("captured", "condition", "x")))
    row = row.crossJoin(F.broadcast(spread(samples).agg(F.avg("std").alias("mean_bootstrap_std"), F.max("std").alias("max_bootstrap_std"))))
    row = row.withColumn("total_reduced", F.aggregate("x", F.lit(0.0), lambda s, v: s + v)).withColumn("reduced_buckets", F.size("x").cast("long"))
    return row.select(
        "original_buckets", "reduced_buckets", (F.col("original_buckets") / F.col("reduced_buckets")).alias("compression"), "total_original", "total_reduced",
        F.abs(F.col("total_original") - F.col("total_reduced")).alias("total_error"), "rmse", "mae", "r2", "max_abs_residual", "worst_bucket", "loo_rmse", "condition",
        (100 * F.sqrt(F.greatest(F.col("energy") - F.col("captured"), F.lit(0.0)) / F.nullif(F.col("energy"), F.lit(0.0)))).alias("unrepresentable_pct"), "mean_leverage", "max_leverage", "mean_bootstrap_std", "max_bootstrap_std")


def mixed(rep: Column, slot: Column, choices: Column) -> Column:
    """A number under ``choices`` by a fixed arithmetic rule, whatever the partitions; its last step is quadratic, as a linear one draws few places in some samples."""
    z = (rep * 7919 + slot * 104729 + 12345) * 48271 % 2147483647
    return z * (z % 65521 + 1) % 2147483647 % choices


def draws(fine: DataFrame, reps: int) -> DataFrame:
    """(rep, o, times): how often each bootstrap sample holds a bucket."""
    size = F.broadcast(fine.agg(F.count("*").alias("n")))
    places = fine.sparkSession.range(reps).select(F.col("id").alias("rep")).crossJoin(size).select("rep", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    return places.select("rep", mixed(F.col("rep"), F.col("slot"), F.col("n")).cast("int").alias("o")).groupBy("rep", "o").agg(F.count("*").alias("times"))


def patch_draws(spark: SparkSession, dims: tuple[int, int], patch: tuple[int, int], reps: int) -> DataFrame:
    """(rep, o, times) of a block bootstrap: samples of contiguous patches of the two-way grid, as neighbours share what moves them.

    A sample draws as many patches as tile the grid, each from a bucket on and wrapped around at the grid's ends, so all buckets are drawn alike.
    """
    (expiries, tenors), (high, wide) = dims, patch
    patches = -(-expiries // high) * -(-tenors // wide)
    places = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(patches - 1))).alias("slot"))
    start = places.select("rep", mixed(F.col("rep"), F.col("slot"), F.lit(expiries * tenors)).alias("at"))
    cell = start.select("rep", "at", F.explode(F.sequence(F.lit(0), F.lit(high * wide - 1))).alias("k"))
    e = (F.floor(F.col("at") / tenors) + F.floor(F.col("k") / wide)) % expiries
    t = (F.col("at") % tenors + F.col("k") % wide) % tenors
    return cell.select("rep", (e * tenors + t).cast("int").alias("o")).groupBy("rep", "o").agg(F.count("*").alias("times"))


def bootstrap(fine: DataFrame, basis: DataFrame, constraints: DataFrame, m: int, drawn: DataFrame) -> DataFrame:
    """(rep, r, v): the constrained ladder of each sample (rep, o, times); a sample counts by weights in its normal equations.

    Samples are spread over tasks; beside each comes the ladder with its weights as one row, as long as the ladder's axes make it. A sample
    that leaves a coarse bucket without any weight, or whose system is singular, gives the solution on all buckets.
    """
    ladder = bucket_rows(fine, basis).agg(F.array_sort(F.collect_list(F.struct("o", "v", "entries"))).alias("ladder"))
    samples = drawn.groupBy("rep").agg(F.collect_list(F.struct("o", "times")).alias("drawn"))

    def run(batches):
        whole = None
        for batch in batches:
            for rep, own, rows, rules in batch.itertuples(index=False):
                if whole is None:  # the same for all samples
                    table = pd.DataFrame({"v": [x["v"] for x in rows], "entries": [x["entries"] for x in rows]})
                    whole, place, (a, b) = dense_rows(table, m), {x["o"]: i for i, x in enumerate(rows)}, constraint_arrays(rules, m)
                    base = linalg.constrained_least_squares(whole[:, :m].T @ whole[:, :m], whole[:, :m].T @ whole[:, m], a, b)
                known = [x for x in own if x["o"] in place]
                at, times = [place[x["o"]] for x in known], np.array([x["times"] for x in known], float)
                x, y = whole[at, :m], whole[at, m]
                gram, v = (x.T * times) @ x, base
                if np.diag(gram).all():
                    with suppress(np.linalg.LinAlgError):
                        v = linalg.constrained_least_squares(gram, (x.T * times) @ y, a, b)
                yield pd.DataFrame({"rep": rep, "r": np.arange(m), "v": v})

    beside = with_constraints(samples.crossJoin(F.broadcast(ladder)), constraints)
    return beside.select("rep", "drawn", "ladder", "rules").mapInPandas(run, "rep long, r int, v double")


def spread(samples: DataFrame) -> DataFrame:
    """(r, std) of bootstrap samples, over n."""
    return samples.groupBy("r").agg(F.stddev_pop("v").alias("std"))


def reliability(samples: DataFrame, coarse: DataFrame, least: float = 1e-6) -> DataFrame:
    """(r, v, std, cv, place): bootstrap spread (over n) and its ratio to the vega, most reliable first; buckets of no size have no ratio and come last."""
    cv = F.when(F.abs("v") > least, F.col("std") / F.abs("v"))
    scored = coarse.join(spread(samples), "r").select("r", "v", "std", cv.alias("cv"))
    return scored.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last("cv"), "r")))


def labelled(df: DataFrame, index: str, expiries: Sequence[float], tenors: Sequence[float], prefix: str = "") -> DataFrame:
    """Adds the years of a flat index's expiry and tenor, tenors counting fastest."""
    years = lambda axis, place: F.get(F.lit([float(y) for y in axis]), place.cast("int"))
    return df.withColumn(f"{prefix}expiry", years(expiries, F.floor(F.col(index) / len(tenors)))).withColumn(f"{prefix}tenor", years(tenors, F.col(index) % len(tenors)))


def extremes(ranked: DataFrame, most: int = 5) -> DataFrame:
    """The first and last of a reliability ranking."""
    n = ranked.agg(F.max("place").alias("n"))
    side = F.when(F.col("place") <= most, "best").otherwise("worst")
    return ranked.crossJoin(F.broadcast(n)).where((F.col("place") <= most) | (F.col("place") > F.col("n") - most)).withColumn("side", side).drop("n")
