"""The expiry by tenor grid, and what aligns tables with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_years
from ..functions.tables import small_table


def make_grid(spark: SparkSession, expiries: Sequence[str], tenors: Sequence[str]) -> DataFrame:
    """All pairs of labels with their places; bucket = e_idx * tenors + t_idx. Labels are parameters, so this is a small table."""
    pairs = small_table(spark, [(e, t, i, j) for i, e in enumerate(expiries) for j, t in enumerate(tenors)], "expiry string, tenor string, e_idx int, t_idx int")
    return pairs.select(
        "expiry", "tenor", "e_idx", "t_idx", (F.col("e_idx") * len(tenors) + F.col("t_idx")).alias("bucket"),
        label_years(F.col("expiry")).alias("e_years"), label_years(F.col("tenor")).alias("t_years"))


def grid_of(surface: DataFrame) -> DataFrame:
    """The grid of a surface's own labels, ordered by years."""
    labels = lambda c: [r[c] for r in surface.select(c).distinct().orderBy(label_years(F.col(c)), c).collect()]
    return make_grid(surface.sparkSession, labels("expiry"), labels("tenor"))


def axis_in_order(df: DataFrame, label: str, order: str = "bucket") -> DataFrame:
    """Distinct labels by where each appears first."""
    return df.groupBy(label).agg(F.min(order).alias("first_seen"))


def missing_cells(surface: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells of the grid that a date lacks: date, bucket. Empty for a complete surface."""
    have = surface.where("vol is not null").join(F.broadcast(grid), ["expiry", "tenor"]).select("date", "bucket")
    return surface.select("date").distinct().crossJoin(F.broadcast(grid.select("bucket"))).join(have, ["date", "bucket"], "left_anti")


def align_vega(grid: DataFrame, vega: DataFrame, on_missing: str = "zero") -> DataFrame:
    """(bucket, expiry, tenor, vega, missing): the book in grid order.

    A bucket that the book lacks has vega 0 and missing set, or raises with ``on_missing="error"``. A null vega that the book does hold stays null.
    """
    held = grid.select("bucket", "expiry", "tenor").join(vega.select("expiry", "tenor", "vega", F.lit(True).alias("held")), ["expiry", "tenor"], "left")
    lost = F.col("held").isNull()
    absent = F.lit(0.0) if on_missing == "zero" else F.raise_error(F.concat_ws(" ", F.lit("the book has no bucket"), "expiry", "tenor")).cast("double")
    return held.select("bucket", "expiry", "tenor", F.when(lost, absent).otherwise(F.col("vega")).alias("vega"), lost.alias("missing"))


def vega_weights(aligned: DataFrame, power: float = 0.5, least: float = 0.10, most: float = 5.0, epsilon: float = 1e-8) -> DataFrame:
    """(bucket, weight): ((|vega| + epsilon) / (median positive |vega| + epsilon)) ^ power, held to [least, most]; power 0 gives 1."""
    size = F.abs("vega")
    scale = aligned.agg(F.coalesce(F.median(F.when(size > epsilon, size)), F.lit(1.0)).alias("scale"))
    raw = F.pow((size + epsilon) / (F.col("scale") + epsilon), F.lit(float(power)))
    weight = F.when(F.col("vega").isNotNull(), F.least(F.greatest(raw, F.lit(least)), F.lit(most)))
    return aligned.crossJoin(F.broadcast(scale)).select("bucket", (F.lit(1.0) if power == 0 else weight).alias("weight"))


def matrix(df: DataFrame, tenors: Sequence[str], value: str, keys: Sequence[str] = ("expiry",)) -> DataFrame:
    """Expiries as rows and the given tenors as columns."""
    return df.groupBy(*keys).pivot("tenor", list(tenors)).agg(F.first(value))


def vector(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Values in bucket order as one array a key."""
    ordered = F.array_sort(F.collect_list(F.struct("bucket", F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias(value))
