import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from factorloom.functions.labels import business_days, label_years, split_label
from factorloom.operators.folds import fold_table, test_rows, training_rows
from factorloom.operators.grid import align_vega, make_grid, missing_cells, vega_weights
from factorloom.operators.moves import all_move_rows, check_transform, compute_moves, full_pnl, move_rows, to_absolute
from factorloom.sources.files import read_ladder, read_surface, read_vega


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def grid(spark):
    return make_grid(spark, ["1Y", "2Y"], ["5Y", "10Y"])


def surface(spark, rows):
    return spark.createDataFrame([(day(i), e, t, v) for i, e, t, v in rows], "date date, expiry string, tenor string, vol double")


def full(vols):
    """One value a day, the same in all buckets but for an offset."""
    return [(i, e, t, None if v is None else v + k) for i, v in enumerate(vols) for k, (e, t) in enumerate([("1Y", "5Y"), ("1Y", "10Y"), ("2Y", "5Y"), ("2Y", "10Y")])]


def test_label_years(spark):
    df = spark.createDataFrame([("18M",), (" 10y ",), ("0.5",), (None,)], "x string")
    assert [r[0] for r in df.select(label_years(F.col("x"))).collect()] == [1.5, 10.0, 0.5, None]
    with pytest.raises(Exception, match="not a tenor"):
        spark.createDataFrame([("abc",)], "x string").select(label_years(F.col("x"))).collect()


def test_split_label(spark):
    df = spark.createDataFrame([("1Yx2Y",), ("1Y_2Y_3Y",)], "x string").select(split_label(F.col("x")).alias("s"))
    assert [tuple(r["s"]) for r in df.collect()] == [("1Y", "2Y"), ("1Y", "2Y_3Y")]
    for bad in ("1Yx2Yx3Y", "1Y2Y"):
        with pytest.raises(Exception, match="not a surface column"):
            spark.createDataFrame([(bad,)], "x string").select(split_label(F.col("x"))).collect()


def test_business_days(spark):
    days = [r["date"] for r in business_days(spark, "2024-01-06", 7).orderBy("k").collect()]  # a Saturday
    assert days[0] == dt.date(2024, 1, 8) and days[5] == dt.date(2024, 1, 15) and all(d.weekday() < 5 for d in days)


def test_missing_cell_takes_two_dates(spark, grid):
    rows = full([10.0, 11.0, 13.0, 14.0, 16.0])
    rows = [r for r in rows if not (r[0] == 2 and r[1] == "2Y" and r[2] == "5Y")]
    s = surface(spark, rows)
    found = compute_moves(s, grid).select("t", "date").distinct().orderBy("t").collect()
    assert [(r["t"], r["date"]) for r in found] == [(0, day(1)), (1, day(4))]
    assert [(r["date"], r["bucket"]) for r in missing_cells(s, grid).collect()] == [(day(2), 2)]


def test_ranges_of_dates_give_the_moves_of_one_range(spark, grid):
    """Lags cross ranges, ranges without a date, and dates that no cell of the grid has; numbers go on from range to range."""
    days = [0, 1, 2, 5, 6, 20, 21, 22, 23, 40, 41]
    vols = dict(zip(days, [10.0, 11.5, 9.0, 8.0, 12.0, 13.0, 11.0, None, 10.5, 9.5, 14.0]))
    rows = [(d, e, t, None if v is None else v + k) for d, v in vols.items() for k, (e, t) in enumerate([("1Y", "5Y"), ("1Y", "10Y"), ("2Y", "5Y"), ("2Y", "10Y")])] + [(30, "9Y", "9Y", 1.0)]
    s = surface(spark, rows)
    want, before = [], None
    for d in sorted([*days, 30]):
        v = vols.get(d)
        if v is not None and before is not None:
            want.append((len(want), day(d), v - before))
        before = v
    for width in (1, 3, 10, 1000):
        found = sorted((r["transform"], r["t"], r["date"], r["x"][1]) for r in all_move_rows(s, grid, ["absolute", "relative"], days=width).collect())
        assert [(t, d, x) for k, t, d, x in found if k == "absolute"] == [(t, d, pytest.approx(x)) for t, d, x in want]
        assert [(t, d) for k, t, d, _ in found if k == "relative"] == [(t, d) for t, d, _ in want]
    lines = all_move_rows(s, grid, ["absolute"])._jdf.queryExecution().executedPlan().toString().split("\n")
    assert all("HashAggregate(keys=[]" in after for line, after in zip(lines, lines[1:]) if "SinglePartition" in line)  # the grid's size, a number a task


def test_nan_and_infinity_are_missing(spark, grid):
    for bad in (math.nan, math.inf, None):
        rows = full([10.0, 11.0, 12.0])
        rows[5] = (*rows[5][:3], bad)
        assert compute_moves(surface(spark, rows), grid).count() == 0


def test_floors_and_inverse(spark, grid):
    s = surface(spark, full([0.0, 2.0, 3.0]))
    rel = {(r["date"], r["bucket"]): r for r in compute_moves(s, grid, "relative").collect()}
    assert rel[day(1), 0]["x"] == pytest.approx(2.0 / 1e-8)
    log = compute_moves(s, grid, "log_relative").withColumn("back", to_absolute(F.col("x"), F.col("prev"), "log_relative"))
    for r in log.where("prev > 0").collect():
        assert r["back"] == pytest.approx(r["dvol"])
    assert next(r["back"] for r in log.where("prev = 0").collect()) == 0.0  # the level before is not floored
    with pytest.raises(ValueError):
        check_transform("cubic")


def test_vega_alignment(spark, grid):
    book = spark.createDataFrame([("1Y", "5Y", 3.0), ("1Y", "10Y", None), ("2Y", "5Y", -1.0)], "expiry string, tenor string, vega double")
    rows = {r["bucket"]: (r["vega"], r["missing"]) for r in align_vega(grid, book).collect()}
    assert rows == {0: (3.0, False), 1: (None, False), 2: (-1.0, False), 3: (0.0, True)}
    with pytest.raises(Exception, match="no bucket"):
        align_vega(grid, book, "error").collect()
    pnl = full_pnl(move_rows(surface(spark, full([10.0, 11.0])), grid), align_vega(grid, book.fillna(0.0))).collect()
    assert pnl[0]["full_pnl"] == pytest.approx(2.0)


def test_weights(spark, grid):
    zero = spark.createDataFrame([(e, t, 0.0) for e in ("1Y", "2Y") for t in ("5Y", "10Y")], "expiry string, tenor string, vega double")
    assert {r["weight"] for r in vega_weights(align_vega(grid, zero), 0.5).collect()} == {0.1}
    assert {r["weight"] for r in vega_weights(align_vega(grid, zero), 0.0).collect()} == {1.0}


@pytest.mark.parametrize("rows,window,horizon,step,least", [(50, 20, 10, 10, None), (50, 20, 5, 7, 8), (30, 40, 5, 5, None), (45, 10, 20, 5, 0), (40, 10, 5, 5, 15)])
def test_fold_assignment_equals_the_fold_table(spark, rows, window, horizon, step, least):
    t = spark.range(rows).select(F.col("id").alias("t"))
    folds = fold_table(t, [window], horizon, step, least).collect()
    train = {(r["fold"], r["t"]) for r in training_rows(t, [window], step, least).collect()}
    test = {(r["fold"], r["t"]) for r in test_rows(t, [window], horizon, step, least).collect()}
    assert train == {(f["fold"], k) for f in folds for k in range(f["train_from"], f["train_to"])}
    assert test == {(f["fold"], k) for f in folds for k in range(f["test_from"], f["test_to"])}


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("date,1Yx5Y,2Y_10Y\n2024-01-01,1.5,NaN\n2024-01-02,2.5,3\n")
    rows = {(str(r["date"]), r["expiry"], r["tenor"]): r["vol"] for r in read_surface(spark, str(tmp_path / "s.csv")).collect()}
    assert rows == {("2024-01-01", "1Y", "5Y"): 1.5, ("2024-01-01", "2Y", "10Y"): None, ("2024-01-02", "1Y", "5Y"): 2.5, ("2024-01-02", "2Y", "10Y"): 3.0}
    (tmp_path / "v.csv").write_text(",5Y,10Y\n1Y,1,2\n2Y,3,4\n")
    assert {(r["expiry"], r["tenor"]): r["vega"] for r in read_vega(spark, str(tmp_path / "v.csv")).collect()}["2Y", "10Y"] == 4.0
    (tmp_path / "l.csv").write_text(",5,2\n10,1,2\n0.5,3,4\n")
    assert [(r["o"], r["e_years"], r["t_years"], r["v"]) for r in read_ladder(spark, str(tmp_path / "l.csv")).orderBy("o").collect()] == [(0, 10.0, 5.0, 1.0), (1, 10.0, 2.0, 2.0), (2, 0.5, 5.0, 3.0), (3, 0.5, 2.0, 4.0)]
