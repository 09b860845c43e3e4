import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import ladder, tall
from factorloom.sources.panels import LADDER_EXPIRIES, LADDER_TENORS, REDUCED_EXPIRIES, REDUCED_TENORS, axis_frame

M = 24


@pytest.fixture(scope="module")
def parts(spark):
    axis = lambda y: axis_frame(spark, y)
    basis = ladder.bilinear_basis(axis(LADDER_EXPIRIES), axis(LADDER_TENORS), axis(REDUCED_EXPIRIES), axis(REDUCED_TENORS)).persist()
    fine = spark.createDataFrame(
        [(o, o // 10, o % 10, float(v)) for o, v in enumerate(np.random.default_rng(0).normal(size=140) * 100)], "o int, e_idx int, t_idx int, v double").persist()
    b = np.zeros((140, M))
    for r in basis.collect():
        b[r["o"], r["r"]] = r["w"]
    y = np.array([r["v"] for r in fine.orderBy("o").collect()])
    return fine, basis, b, y


def column(df, name, key):
    return np.array([r[name] for r in df.orderBy(key).collect()])


def test_hat_weights(spark):
    w = {(r["i"], r["k"]): r["w"] for r in ladder.hat_weights(axis_frame(spark, [0.1, 1.0, 2.0, 50.0]), axis_frame(spark, [1.0, 4.0, 9.0])).collect()}
    assert w == {(0, 0): 1.0, (1, 0): 1.0, (2, 0): pytest.approx(0.5), (2, 1): pytest.approx(0.5), (3, 2): 1.0}


def test_projection_and_diagnostics(parts):
    fine, basis, b, y = parts
    assert np.allclose(b.sum(axis=1), 1) and (b > 0).sum() == 315
    assert column(ladder.bilinear(fine, basis), "v", "r").sum() == pytest.approx(y.sum())
    rule = ladder.total_constraint(fine, basis)
    coarse = ladder.constrained_ladder(fine, basis, rule, M).persist()
    v = column(coarse, "v", "r")
    assert v.sum() == pytest.approx(y.sum())
    h = np.einsum("ij,jk,ik->i", b, np.linalg.pinv(b.T @ b), b)
    assert np.allclose(column(ladder.leverage(fine, basis, M), "leverage", "o"), h) and h.mean() == pytest.approx(24 / 140)
    res = y - b @ v
    assert np.allclose(column(ladder.residuals(fine, basis, coarse), "residual", "o"), res)
    assert np.allclose(column(ladder.singular_values(fine, basis, M), "sigma", "rank"), np.linalg.svd(b, compute_uv=False))
    samples = ladder.bootstrap(fine, basis, rule, M, ladder.draws(fine, 6)).persist()
    row = ladder.summary(fine, basis, rule, M, samples).first()
    assert row["condition"] == pytest.approx(np.linalg.cond(b)) and row["total_reduced"] == pytest.approx(y.sum())
    seen = ladder.buckets(fine, basis, ladder.solved_row(ladder.normal_row(fine, basis, M), rule, M), M)
    assert np.allclose(column(seen, "loo", "o"), (y - b @ v) / (1 - h))
    spread = column(ladder.spread(samples), "std", "r")
    assert row["mean_bootstrap_std"] == pytest.approx(spread.mean()) and row["max_bootstrap_std"] == pytest.approx(spread.max())
    at = ladder.labelled(coarse, "r", REDUCED_EXPIRIES, REDUCED_TENORS).where("r = 5").first()
    assert (at["expiry"], at["tenor"]) == (REDUCED_EXPIRIES[1], REDUCED_TENORS[1])
    assert row["rmse"] == pytest.approx(np.sqrt((res**2).mean())) and row["worst_bucket"] == np.abs(res).argmax() and row["loo_rmse"] > row["rmse"]
    # Without constraints, the closed form of leaving one out equals refitting.
    free = np.linalg.lstsq(b, y, rcond=None)[0]
    again = np.linalg.lstsq(np.delete(b, 7, 0), np.delete(y, 7), rcond=None)[0]
    assert (y - b @ free)[7] / (1 - h[7]) == pytest.approx(y[7] - b[7] @ again)


def test_bootstrap_and_ranking(parts):
    fine, basis, _, y = parts
    rule = ladder.total_constraint(fine, basis)
    samples = ladder.bootstrap(fine, basis, rule, M, ladder.draws(fine, 8)).persist()
    assert np.allclose([r["s"] for r in samples.groupBy("rep").agg(F.sum("v").alias("s")).collect()], y.sum())
    assert ladder.draws(fine, 3).groupBy("rep").agg(F.sum("times").alias("n")).select("n").distinct().first()["n"] == 140
    coarse = ladder.constrained_ladder(fine, basis, rule, M).withColumn("v", F.when(F.col("r") == 3, 0.0).otherwise(F.col("v")))
    ranked = ladder.reliability(samples, coarse)
    assert ranked.where("r = 3").first()["place"] == 24 and ranked.where("r = 3").first()["cv"] is None



def test_smoothed_ladder(parts):
    fine, basis, b, y = parts
    rule = ladder.total_constraint(fine, basis)
    square = lambda v: sum((np.diff(v.reshape(6, 4), axis=k) ** 2).sum() for k in (0, 1))
    sizes = []
    for strength in (0.0, 0.5, 1e6):
        v = column(ladder.smoothed_ladder(fine, basis, rule, (6, 4), strength), "v", "r")
        assert v.sum() == pytest.approx(y.sum())
        # no step that keeps the total makes the penalised error smaller
        slope = 2 * (b.T @ (b @ v - y) + strength * ladder.smoothness(6, 4) @ v)
        assert np.allclose(slope, slope.mean(), atol=1e-6 * max(strength, 1) * 100)
        sizes.append(square(v))
    assert sizes[0] > sizes[1] > sizes[2] and np.allclose(v, y.sum() / M, atol=1e-3)
    assert np.isclose(np.arange(24.0) @ ladder.smoothness(6, 4) @ np.arange(24.0), square(np.arange(24.0)))


def test_patches(spark, parts):
    fine, basis, b, y = parts
    drawn = ladder.patch_draws(spark, (14, 10), (2, 3), 40).toPandas()
    assert (drawn.groupby("rep").times.sum() == 7 * 4 * 6).all() and drawn.o.between(0, 139).all()
    one = ladder.patch_draws(spark, (14, 10), (14, 10), 2)  # a patch as large as the grid is the grid
    assert one.count() == 280 and one.where("times <> 1").count() == 0
    rule = ladder.total_constraint(fine, basis)
    whole = column(ladder.constrained_ladder(fine, basis, rule, M), "v", "r")
    found = ladder.bootstrap(fine, basis, rule, M, one)
    assert np.allclose(column(found.where("rep = 1"), "v", "r"), whole)
    single = spark.createDataFrame([(0, 5, 1)], "rep long, o int, times long")  # leaves most coarse buckets bare
    assert np.allclose(column(ladder.bootstrap(fine, basis, rule, M, single), "v", "r"), whole)


def test_singular_values_of_an_ill_conditioned_matrix(spark):
    rng = np.random.default_rng(4)
    q, w = np.linalg.qr(rng.normal(size=(500, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = q * np.logspace(0, -8, 6) @ w
    table = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(7)
    flat = tall.triangle(table, 6, lambda batch: np.array(batch["x"].tolist())).first()["r"]
    r = tall.matrix_of(flat)
    sigma = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(sigma, np.logspace(0, -8, 6), rtol=1e-7, atol=1e-15) and np.allclose(r.T @ r, x.T @ x) and np.allclose(np.tril(r, -1), 0)
    few = tall.triangle(table.limit(2), 6, lambda batch: np.array(batch["x"].tolist())).first()["r"]
    assert np.linalg.matrix_rank(tall.matrix_of(few), 1e-9) <= 2
    assert tall.triangle(table.limit(0), 6, lambda batch: np.zeros((0, 6))).count() == 0
