import datetime as dt
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.functions import linalg
from factorloom.operators import covariance, factors, report, sums, validate
from factorloom.operators.factors import Spec
from factorloom.sources import files

DIMS = (3, 2)


def rows(n=40, p=6, seed=0):
    return np.random.default_rng(seed).normal(size=(n, p)) @ np.random.default_rng(1).normal(size=(p, p))


@settings(max_examples=25, deadline=None)
@given(st.integers(5, 40), st.floats(0, 1), st.integers(0, 1000))
def test_shrinkage_identities(n, alpha, seed):
    x = rows(n, seed=seed)
    x -= x.mean(axis=0)
    a, b = (linalg.estimate_covariance(x, m, alpha) for m in ("diagonal_shrink", "correlation_shrink"))
    assert np.allclose(a, b, atol=1e-8 * np.trace(a))
    for m in ("factor_diag", "separable_shrink"):
        c = linalg.estimate_covariance(x, m, alpha, 2, DIMS)
        assert np.linalg.eigvalsh(c).min() >= 0.9e-12 and np.allclose(c, c.T)
    assert np.isclose(np.trace(linalg.estimate_covariance(x, "separable_shrink", 1.0, 2, DIMS)), np.trace(linalg.sample_covariance(x)))


def test_shrinking_to_identity_keeps_the_projection():
    x = rows()
    base = factors.fit(x, Spec("a", n_components=2), np.ones(6), DIMS).reconstruct(x, 2)
    for m in ("ledoit_wolf", "oas"):
        other = factors.fit(x, Spec("b", covariance_method=m), np.ones(6), DIMS).reconstruct(x, 2)
        assert np.allclose(base, other)


def test_full_rank_is_exact_and_errors_fall():
    x = rows()
    model = factors.fit(x, Spec("a", vega_weight_power=0.5), np.arange(1.0, 7.0), DIMS)
    errors = [np.linalg.norm(((model.reconstruct(x, k) - x) * model.weights)) for k in range(7)]
    assert errors[6] < 1e-9 and all(a >= b - 1e-9 for a, b in zip(errors, errors[1:]))
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(6))
    two = factors.fit(x, Spec("s", family="separable"), np.ones(6), DIMS)
    assert np.allclose(two.reconstruct(x, 3, 2), x)


def test_contributions_and_mean_make_the_projected_pnl():
    x, vega = rows(), np.arange(6.0) - 2
    for spec in (Spec("a", n_components=3), Spec("s", family="separable", r_expiry=2, r_tenor=1)):
        model = factors.fit(x, spec, vega, DIMS)
        total = sum(factors.contributions(model, x, x, vega, spec).values()) + model.mean @ vega
        assert np.allclose(total, factors.reconstruct(model, x, spec) @ vega)


def test_bad_inputs():
    with pytest.raises(ValueError):
        linalg.sample_covariance(np.ones((1, 3)))
    with pytest.raises(ValueError):
        linalg.estimate_covariance(rows(), "nothing")
    with pytest.raises(ValueError):
        linalg.estimate_covariance(rows(), "separable_shrink", 0.5)
    assert len(factors.default_specs()) == 72 and len({s.name for s in factors.default_specs()}) == 72
    assert factors.fit(np.ones((1, 6)), Spec("s", family="separable"), np.ones(6), DIMS).mean.shape == (6,)
    with pytest.raises(np.linalg.LinAlgError):
        linalg.constrained_least_squares(np.eye(2), np.ones(2), np.ones((2, 2)), np.array([1.0, 2.0]))


def test_tucker_with_full_ranks_is_exact():
    cube = np.random.default_rng(0).normal(size=(5, 3, 2))
    assert linalg.tucker(cube, (5, 3, 2))[2] < 1e-10
    assert linalg.tucker(cube, (1, 1, 1))[2] > linalg.tucker(cube, (3, 2, 2))[2]


def test_tucker_errors_need_a_cube_of_the_grid_only(spark, monkeypatch):
    x, ranks, tucker = rows(n=50) + 3, [(2, 2, 1), (1, 3, 2), (6, 3, 2)], linalg.tucker

    def small(cube, r):
        assert len(cube) <= 6
        return tucker(cube, r)

    monkeypatch.setattr(factors, "linalg", SimpleNamespace(tucker=small, eigen_descending=linalg.eigen_descending))
    got = factors.tucker_errors(spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(x)], "t long, x array<double>"), DIMS, ranks)
    want = [tucker((x - x.mean(axis=0)).reshape(-1, *DIMS), r)[2] for r in ranks]
    assert np.allclose([r["rmse"] for r in got.collect()], want, atol=1e-7)


def test_metric_guards(spark):
    metrics = lambda pairs: validate.pnl_metrics(spark.createDataFrame([("m", float(f), float(p), float(f - p)) for f, p in pairs], "model string, full_pnl double, projected_pnl double, error double"), "model").first()
    one = metrics([(1, 2)])
    assert one["full_pnl_std"] is None and one["explained_pnl_variance"] is None and one["error_rmse"] == 1.0
    assert metrics([(1, 2), (2, 1)])["full_vs_projected_corr"] is None
    constant = metrics([(1, 2), (2, 2), (4, 2)])
    assert constant["full_vs_projected_corr"] is None and constant["explained_pnl_variance"] == pytest.approx(0.0)
    assert metrics([(1, 1), (2, 2), (4, 3)])["full_vs_projected_corr"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 2, 3])[0, 1])


def test_queries_correlate_two_rows(spark, monkeypatch):
    """As their SQL does; windows that leave two test rows gave null."""
    from factorloom import schemas
    from factorloom.plans import catalog

    name = catalog.FEW_SPECS[0].name
    rows = [{"model": name, "window": 20, "full_pnl": float(f), "projected_pnl": float(p), "error": float(f - p)} for f, p in ((1, 2), (2, 1))]
    monkeypatch.setattr(catalog, "walk", lambda *_: spark.createDataFrame(rows, schemas.PREDICTIONS))
    found = catalog.walk_summary(spark, "", catalog.FEW_SPECS[:1], (20,)).first()
    assert found["n_test_obs"] == 2 and found["full_vs_projected_corr"] == pytest.approx(-1)


def test_failed_fits_are_rows(spark):
    from factorloom.operators.grid import make_grid

    grid = make_grid(spark, ["1Y"], ["5Y", "10Y"])
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    values = np.random.default_rng(0).uniform(10, 20, (6, 2))
    surface = spark.createDataFrame([(d, "1Y", t, float(v)) for d, row in zip(days, values) for t, v in zip(("5Y", "10Y"), row)], "date date, expiry string, tenor string, vol double")
    book = spark.createDataFrame([("1Y", "5Y", 1.0), ("1Y", "10Y", 2.0)], "expiry string, tenor string, vega double")
    specs = [Spec("pca", n_components=1), Spec("two", family="separable", r_expiry=1, r_tenor=1)]
    found = validate.walk_forward(surface, grid, book, specs, [1], 2, 2).collect()
    assert {r["failure"] for r in found if r["model"] == "pca"} == {"ValueError: a covariance needs two rows or more"}
    assert {r["model"] for r in found if r["failure"]} == {"pca"} and {r["model"] for r in found if not r["failure"]} == {"two"}


def vectors(spark, x, parts=5):
    days = [(t, dt.date(2024, 1, 1) + dt.timedelta(days=t), v.tolist(), v.tolist(), np.abs(v).tolist()) for t, v in enumerate(x)]
    return spark.createDataFrame(days, "t long, date date, x array<double>, dvol array<double>, prev array<double>").repartition(parts)


@pytest.mark.parametrize("method", ["sample", "ledoit_wolf", "oas", "diagonal_shrink", "correlation_shrink", "factor_diag", "separable_shrink"])
@pytest.mark.parametrize("n", [4, 30])
def test_distributed_estimates_equal_those_of_rows(spark, method, n):
    x = rows(n) + np.arange(6)
    for alpha in (0.4, 1.5):
        want = linalg.estimate_covariance(x - x.mean(axis=0), method, alpha, 2, DIMS)
        got = np.zeros((6, 6))
        for r in covariance.estimate(vectors(spark, x), DIMS, method, alpha, 2).collect():
            got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["c"]
        assert np.allclose(got, want, atol=1e-8)
    assert covariance.estimate(vectors(spark, x).limit(0), DIMS, method).count() == 0


def test_published_shrinkage_of_rows():
    """The closed forms of both papers, written out over rows."""
    x = rows(25)
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() / p for r in x) / n**2, d2)
    assert np.allclose(linalg.estimate_covariance(x, "ledoit_wolf"), b2 / d2 * mu * np.eye(p) + (1 - b2 / d2) * s)
    rho = min(((s**2).mean() + mu**2) / ((n + 1) * ((s**2).mean() - mu**2 / p)), 1)
    assert np.allclose(linalg.estimate_covariance(x, "oas"), (1 - rho) * s + rho * mu * np.eye(p))


def plain_moments(x):
    y = x - x.mean(axis=0)
    a = (y**2).sum(axis=1)
    return len(x), x.mean(axis=0), y.T @ y, a @ y, (a**2).sum()


def test_moments_merge(spark):
    x = rows(23) + 2
    parts = [sums.Moments.of(part) for part in np.array_split(x, 5)]
    total = sums.merged(m.flat() for m in parts)
    for got, want in zip((total.n, total.mean, total.products, total.sized, total.fourth), plain_moments(x)):
        assert np.allclose(got, want)
    assert np.allclose(sums.Moments.from_flat(total.flat()).products, total.products)
    empty = sums.Moments.of(np.zeros((0, 6)))
    assert empty.merge(empty).n == 0 and np.allclose(empty.merge(total).flat(), total.flat()) and np.allclose(total.merge(empty).flat(), total.flat())
    found = sums.whole_moments(vectors(spark, x), {"even": np.ones(6), "half": np.full(6, 0.5)}, salts=3).collect()
    assert {r["weighting"] for r in found} == {"even", "half"}
    for r in found:
        scale = 1.0 if r["weighting"] == "even" else 0.5
        assert np.allclose(r["moments"], sums.Moments.of(x * scale).flat())


@pytest.mark.parametrize("method", ["sample", "ledoit_wolf", "oas", "diagonal_shrink", "correlation_shrink", "factor_diag", "separable_shrink"])
def test_levels_far_above_the_spread(spark, method):
    """Mean over spread of a million: estimates are those of the rows without their mean, in both families."""
    d = np.round(rows(200) * 1024) / 1024  # exact beside the level
    level = 2.0**20 * np.arange(1, 7)
    x = d + level
    want = linalg.estimate_covariance(d - d.mean(axis=0), method, 0.4, 2, DIMS)
    got = np.zeros((6, 6))
    for r in covariance.estimate(vectors(spark, x), DIMS, method, 0.4, 2).collect():
        got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["c"]
    assert np.abs(got - want).max() < 1e-10 * np.abs(want).max()
    if method == "sample":
        spec = Spec("s", family="separable", r_expiry=2, r_tenor=1)
        far, near = factors.fit_rows(vectors(spark, x), spec, np.ones(6), DIMS), factors.fit(d, spec, np.ones(6), DIMS)
        assert np.allclose(far.expiry_values, near.expiry_values, rtol=1e-10) and np.allclose(far.mean - level, near.mean, atol=1e-8)


def test_a_tree_merges_any_run_of_blocks():
    x = rows(26)
    tree = sums.Tree({b: sums.Moments.of(x[2 * b : 2 * b + 2]) for b in range(13) if b != 5})
    for low in range(13):
        for high in range(low, 14):
            own = [x[2 * b : 2 * b + 2] for b in range(low, min(high, 13)) if b != 5]
            got = tree.run(low, high)
            assert (got is None) == (not own) and (got is None or np.allclose(got.flat(), sums.Moments.of(np.vstack(own)).flat()))
    assert len(tree.nodes) < 40


@pytest.mark.parametrize("windows", [[(8, 8), (12, 6), (20, 20)], [(2, 2)], [(64, 4)]])
def test_fold_moments_are_those_of_their_rows(spark, windows):
    x = rows(50)
    table = vectors(spark, x).withColumn("kind", F.lit("k"))
    found = sums.fold_moments(table, {"k": {"even": np.ones(6)}}, windows, 4, 2).collect()
    parts = {}
    for r in found:
        parts.setdefault((r["window"], r["fold"]), []).append(r["moments"])
    for window, first in windows:
        for fold, start in enumerate(range(first, 51, 4)):
            own = parts[window, fold]
            assert len(own) <= 3 and np.allclose(sums.merged(own).flat(), sums.Moments.of(x[max(0, start - window) : start]).flat())


def test_a_model_projects_rows_where_they_are(spark):
    x, vega = rows(), np.arange(6.0) - 2
    for spec in (Spec("a", n_components=2, vega_weight_power=0.5), Spec("s", family="separable", r_expiry=2, r_tenor=1), Spec("l", transform="log_relative", n_components=2), Spec("r", transform="relative", n_components=2, vega_weight_power=1.0)):
        table = vectors(spark, x)
        model, plain = factors.fit_rows(table, spec, vega, DIMS), factors.fit(x, spec, vega, DIMS)
        hat = factors.absolute(factors.reconstruct(plain, x, spec), np.abs(x), spec.transform)
        got = factors.priced(table, model, spec, vega).orderBy("t").toPandas()
        assert np.allclose(got.projected_pnl, hat @ vega) and np.allclose(got.full_pnl, x @ vega)
        assert np.allclose(factors.projected_pnl(plain, x, np.abs(x), spec, vega), hat @ vega)
        back = factors.projected(table, model, spec).orderBy("t").toPandas()
        assert np.allclose(np.array(back.dvol_hat.tolist()), hat) and np.allclose(np.array(back.dvol.tolist()), x)
        parts = factors.contribution_rows(table, model, spec, vega).toPandas().pivot(index="t", columns="component", values="pnl")
        want = factors.contributions(plain, x, np.abs(x), vega, spec)
        assert set(parts.columns) == set(want) and all(np.allclose(parts[c], want[c]) for c in want)


def test_without_a_mean():
    x = rows() + 5
    model = factors.fit(x, Spec("a", n_components=6), np.ones(6), DIMS, demean=False)
    assert not model.mean.any() and np.allclose(model.values.sum(), (x**2).sum() / (len(x) - 1))


def test_walk_forward_equals_fits_on_its_rows(spark):
    from factorloom.operators.grid import make_grid

    grid, x = make_grid(spark, ["1Y", "2Y", "3Y"], ["5Y", "10Y"]), np.exp(rows(30) / 20) * 30
    labels = [(e, t) for e in ("1Y", "2Y", "3Y") for t in ("5Y", "10Y")]
    surface = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), *at, float(v)) for i, row in enumerate(x) for at, v in zip(labels, row)], "date date, expiry string, tenor string, vol double")
    book = spark.createDataFrame([(*at, float(k) - 2) for k, at in enumerate(labels)], "expiry string, tenor string, vega double")
    specs = [Spec("a", n_components=2), Spec("w", n_components=2, vega_weight_power=1.0, covariance_method="ledoit_wolf"), Spec("l", transform="log_relative", n_components=1), Spec("s", family="separable", r_expiry=1, r_tenor=1)]
    found = validate.walk_forward(surface, grid, book, specs, [8, 12], 4, 5, 6).toPandas()
    vega, moved, prev = np.arange(6.0) - 2, {"absolute": x[1:] - x[:-1], "log_relative": np.log(x[1:] / x[:-1])}, x[:-1]
    seen = 0
    for spec in specs:
        y = moved[spec.transform]
        for window in (8, 12):
            for fold, start in enumerate(range(6, 29, 5)):
                train, test = y[max(0, start - window) : start], slice(start, start + 4)
                hat = factors.absolute(factors.reconstruct(factors.fit(train, spec, vega, DIMS), y[test], spec), prev[test], spec.transform) @ vega
                own = found[(found.model == spec.name) & (found.window == window) & (found.fold == fold)].sort_values("t")
                assert np.allclose(own.projected_pnl, hat) and own.train_end.iloc[0] == dt.date(2024, 1, 2) + dt.timedelta(days=start - 1)
                seen += len(own)
    assert seen == len(found)
    spec, window, chosen = report.best_report(surface, grid, book, specs, [8, 12], 4, 5)
    tried = validate.summary(validate.walk_forward(surface, grid, book, specs, [8, 12], 4, 5), factors.specs_frame(spark, specs), [8, 12])
    best = tried.toPandas().sort_values("error_rmse").iloc[0]
    assert (spec.name, window) == (best["model"], best["window"]) and chosen.metrics.first()["n_test_obs"] == window
    assert report.loadings(chosen.models, grid).count() > 0 and report.scatter_bounds(chosen.pnl).count() == 1


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("m", 20, 2.0, 3.0), ("n", 20, 1.0, 3.0), ("o", 40, None, None)], "model string, window int, error_rmse double, error_p95_abs double")
    files.write_results(table, str(tmp_path / "r"))
    assert [r["model"] for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()] == ["n", "m", "o"]
    for form in ("parquet", "csv"):
        files.write_predictions(table, str(tmp_path / form), form)
        assert getattr(spark.read.option("header", True), form)(str(tmp_path / form)).count() == 3


def test_files_of_odd_tables_come_back(spark, tmp_path):
    """Cells that are missing or null are empty fields; an empty table gives a header, or no rows."""
    cells = spark.createDataFrame([(dt.date(2024, 1, 2), "1Y", "5Y", 0.1 + 0.2), (dt.date(2024, 1, 1), "2Y", "1Y", None), (dt.date(2024, 1, 1), "1Y", "1Y", -1e-300)], "date date, expiry string, tenor string, vol double")
    files.write_surface(cells, ["1Y", "2Y"], ["1Y", "5Y"], str(tmp_path / "s"))
    back = files.read_surface(spark, str(tmp_path / "s"))
    assert back.count() == 8 and {tuple(r) for r in back.where("vol is not null").collect()} == {tuple(r) for r in cells.where("vol is not null").collect()}
    files.write_surface(cells.limit(0), ["1Y"], ["1Y"], str(tmp_path / "none"))
    assert files.read_surface(spark, str(tmp_path / "none")).count() == 0
    fine = spark.createDataFrame([(1, 0, 2.5), (0, 1, 1 / 3)], "e_idx int, t_idx int, v double")
    files.write_ladder(fine, [1 / 12, 2], [1, 10], str(tmp_path / "l"))
    got = {(r["e_idx"], r["t_idx"], r["e_years"], r["t_years"]): r["v"] for r in files.read_ladder(spark, str(tmp_path / "l")).collect()}
    assert got == {(0, 0, 1 / 12, 1.0): None, (0, 1, 1 / 12, 10.0): 1 / 3, (1, 0, 2.0, 1.0): 2.5, (1, 1, 2.0, 10.0): None}


def test_source_switch(spark, tmp_path):
    (tmp_path / "s.csv").write_text("date,1Yx5Y\n2024-01-01,1.5\n")
    (tmp_path / "v.csv").write_text(",5Y\n1Y,7\n")
    surface, book = files.load_inputs(spark, "csv", surface=str(tmp_path / "s.csv"), vega=str(tmp_path / "v.csv"))
    assert surface.first()["vol"] == 1.5 and book.first()["vega"] == 7.0
    surface, book = files.load_inputs(spark, "tables", sf_dir="/root/testdata/sf0.001")
    assert surface.columns == ["date", "expiry", "tenor", "vol"] and book.columns == ["expiry", "tenor", "vega"]
    with pytest.raises(ValueError):
        files.load_inputs(spark, "cloud")
