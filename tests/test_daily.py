import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import validate
from factorloom.operators.factors import Spec
from factorloom.operators.grid import make_grid
from factorloom.streaming.daily import WalkForwardStore, append_days

LABELS = [(e, t) for e in ("1Y", "2Y") for t in ("5Y", "10Y")]
SPECS = [Spec("a", n_components=2), Spec("w", n_components=1, vega_weight_power=1.0, covariance_method="oas"), Spec("r", transform="relative", n_components=1), Spec("s", family="separable", r_expiry=1, r_tenor=1)]
DDL = "date date, expiry string, tenor string, vol double"


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(2)
    vols = np.exp(rng.normal(size=(40, 4)) / 5) * 20
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(day(i), *at, float(v)) for i, row in enumerate(vols) for at, v in zip(LABELS, row) if not (i == 17 and at == ("1Y", "5Y"))]
    book = spark.createDataFrame([(*at, float(k) - 1.5) for k, at in enumerate(LABELS)], "expiry string, tenor string, vega double")
    return rows, make_grid(spark, ["1Y", "2Y"], ["5Y", "10Y"]), book, day


def values(df):
    return df.toPandas().sort_values(["model", "window", "fold", "t"], ignore_index=True)


def test_days_in_batches_equal_one_run(spark, market, tmp_path):
    rows, grid, book, day = market
    store = WalkForwardStore(spark, str(tmp_path / "store"), SPECS, [6, 10], 4, 4, 6)
    for batch, until in enumerate((3, 9, 18, 20, 20, 31, 40)):
        surface = spark.createDataFrame([r for r in rows if r[0] < day(until)], DDL)
        store.extend(surface, grid, book, batch)
        if batch in (2, 5):
            store.extend(surface, grid, book, batch)  # run again
    want = values(validate.walk_forward(spark.createDataFrame(rows, DDL), grid, book, SPECS, [6, 10], 4, 4, 6))
    got = values(store.predictions())
    assert len(got) == len(want) > 100 and not got.failure.notna().any()
    for c in ("model", "window", "fold", "t", "date", "train_start", "train_end"):
        assert (got[c] == want[c]).all(), c
    for c in ("full_pnl", "projected_pnl", "error"):
        assert np.allclose(got[c], want[c])
    fitted = store.stored("predictions", "model string, fold int, t long").groupBy("batch").agg(F.min("t").alias("t")).orderBy("batch").collect()
    assert [r["t"] for r in fitted] == sorted(r["t"] for r in fitted)  # a batch predicts no row that an earlier one did
    with pytest.raises(ValueError, match="book has changed"):
        store.extend(surface, grid, book.withColumn("vega", F.lit(1.0)), 7)


def test_a_stream_carries_the_walk_on(spark, market, tmp_path):
    rows, grid, book, day = market
    store = WalkForwardStore(spark, str(tmp_path / "store"), SPECS[:1], [6], 4, 4)
    for low, high in ((0, 12), (12, 40)):
        spark.createDataFrame([r for r in rows if day(low) <= r[0] < day(high)], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        append_days(spark.readStream.schema(DDL).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), lambda history, batch: store.extend(history, grid, book, batch)).awaitTermination()
    want = values(validate.walk_forward(spark.createDataFrame(rows, DDL), grid, book, SPECS[:1], [6], 4, 4))
    assert np.allclose(values(store.predictions()).error, want.error)
