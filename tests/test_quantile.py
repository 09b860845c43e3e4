import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators.quantile import exact_quantile

RNG = np.random.default_rng(0)
GROUPS = {
    "ties": np.repeat([1.0, 2.0, 2.0, 9.0], [700, 5, 5, 3]), "same": np.full(50, 3.5), "one": np.array([7.0]), "two": np.array([-1.0, 4.0]), "odd": RNG.normal(size=1001),
    "tails": np.concatenate([np.exp(RNG.normal(size=2000) * 8), [1e300, -1e300]]), "ends": np.array([0.0, -0.0, 5e-324, 1.0])}


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.95, 1.0])
def test_quantiles_are_exact(spark, q):
    rows = [(g, float(v)) for g, values in GROUPS.items() for v in values] + [("ties", None), ("one", float("nan")), ("none", None), (None, 1.0)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for bins, rounds in ((1024, 1), (3, 2), (8, 0)):
        got = {r["g"]: r["x"] for r in exact_quantile(table, ["g"], F.col("v"), q, "x", bins, rounds).collect()}
        assert set(got) == set(GROUPS)
        for g, values in GROUPS.items():
            assert got[g] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-300), (g, bins)
    assert exact_quantile(table.limit(0), ["g"], F.col("v"), q, "x").count() == 0
