"""Every query with SQL equals it on the small tables; the entry point runs."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from factorloom.plans import catalog, oracle

SF = "/root/testdata/sf0.01"
#: Left out: rankings of the table that ``best_model`` ranks, and the whole grid, whose SQL takes minutes together.
SLOW = {"leaderboard", "best_by_window", "window_perf", "group_perf", "best_report_metrics", "best_report_risk", *(f"walk_forward_{k}" for k in catalog.KINDS if k != "two_way"), "ladder_summary", "bootstrap_std", "reliability_rank"}
NAMES = sorted(set(oracle.oracle_sql()) - SLOW)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = tables.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    columns = sorted(want.columns)
    keys = [c for c in columns if want[c].dtype.kind != "f"] + [c for c in columns if want[c].dtype.kind == "f"]
    tidy = lambda df: df[columns].assign(**{c: pd.to_datetime(df[c]) for c in columns if "date" in c}).sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, atol=2e-6, rtol=0)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kinds_are_the_whole_grid():
    from factorloom.operators.factors import default_specs

    own = [s.name for specs in catalog.KINDS.values() for s in specs]
    assert sorted(own) == sorted(s.name for s in default_specs()) and len(own) == 72


def test_rankings_of_all_candidates(spark, monkeypatch):
    """The ranked queries against plain sorting and grouping of the whole grid's rows; the grid is walked once for all of them, and once for the report."""
    from factorloom.operators.factors import default_specs

    whole, chosen = catalog.tried_all(spark, SF).persist(), catalog.best(spark, SF, default_specs())
    monkeypatch.setattr(catalog, "tried_all", lambda s, d: whole)
    monkeypatch.setattr(catalog, "best", lambda s, d, specs: chosen)
    found = {name: catalog.queries()[name](spark, SF).toPandas() for name in ("leaderboard_all", "best_by_window_all", "window_perf_all", "group_perf_all", "best_report_metrics_all", "best_report_risk_all")}
    rows = catalog.rounded(whole.select(*catalog.SHORT, *catalog.GRID_COLUMNS), 4).toPandas()
    done = rows[rows.error_rmse.notna()].sort_values(["error_rmse", "error_p95_abs", "model", "window"], ignore_index=True)
    assert len(rows) == 288 and len(done) == 288
    assert found["leaderboard_all"].error_rmse.tolist() == done.error_rmse[:20].tolist()
    own = found["best_by_window_all"]
    for window, part in done.groupby("window"):
        assert own[own.window == window].error_rmse.tolist() == part.error_rmse[:5].tolist()
    by_window = done.groupby("window").error_rmse.agg(["min", "median"])
    shown = found["window_perf_all"].set_index("window").sort_index()
    pd.testing.assert_frame_equal(shown[["best_rmse", "median_rmse"]], by_window.set_axis(["best_rmse", "median_rmse"], axis=1), atol=1e-4, check_dtype=False, check_index_type=False)
    groups = done.groupby(["family", "transform", "spec_covariance_method"]).error_rmse.min().sort_values()
    assert len(found["group_perf_all"]) == len(groups) and found["group_perf_all"].best_rmse.tolist() == groups.tolist()
    best = found["best_report_metrics_all"].iloc[0]
    assert best["window"] == best["n_test_obs"] and best["model"] in {s.name for s in default_specs()}
    assert done[(done.model == best["model"]) & (done.window == best["window"])].error_rmse.iloc[0] == done.error_rmse[0]
    assert len(found["best_report_risk_all"]) == 28
    whole.unpersist()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_appends_days(spark, tmp_path):
    from factorloom.streaming.daily import append_days

    day = "date date, expiry string, tenor string, vol double"
    spark.sql("select date'2024-01-01' date, '1Y' expiry, '5Y' tenor, 1.0D vol").write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        append_days(spark.readStream.schema(day).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), lambda h, batch: seen.append(h.count())).awaitTermination()
        spark.sql("select date'2024-01-02' date, '1Y' expiry, '5Y' tenor, 2.0D vol").write.mode("append").parquet(str(tmp_path / "in"))
    assert seen == [1, 2]
