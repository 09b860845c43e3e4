"""Panels, books and move matrices over the warehouse tables, in the engine's layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import small_table
from ..operators.grid import make_grid

# The axes of the panel, the fine ladder and the coarse one.
PANEL_EXPIRIES, PANEL_TENORS = tuple(f"{i}Y" for i in range(1, 8)), tuple(f"{i}Y" for i in range(1, 5))
LADDER_EXPIRIES = (1 / 12, 3 / 12, 6 / 12, 9 / 12, 1, 1.5, 2, 3, 5, 7, 10, 15, 20, 30)
LADDER_TENORS = (1, 2, 3, 5, 7, 10, 15, 20, 25, 30)
REDUCED_EXPIRIES, REDUCED_TENORS = (0.25, 1, 2, 5, 10, 30), (2, 5, 10, 30)


def panel_grid(spark: SparkSession) -> DataFrame:
    return make_grid(spark, PANEL_EXPIRIES, PANEL_TENORS)


def bucket_labels(df: DataFrame) -> DataFrame:
    """Adds the panel's labels to line items."""
    return df.withColumn("expiry", F.concat(F.col("l_linenumber").cast("string"), F.lit("Y"))).withColumn("tenor", F.concat((F.col("l_partkey") % 4 + 1).cast("string"), F.lit("Y")))


def price_surface(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    """Average price in thousands by period and bucket: date, expiry, tenor, vol."""
    items = bucket_labels(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return items.groupBy(F.trunc(F.col("l_shipdate").cast("date"), grain).alias("date"), "expiry", "tenor").agg((F.avg("l_extendedprice") / 1000).alias("vol"))


def exposure():
    """A signed amount of a line item."""
    return F.sum(F.col("l_quantity") * (F.col("l_discount") - 0.05))


def panel_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book over the panel's buckets: expiry, tenor, vega."""
    return bucket_labels(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).groupBy("expiry", "tenor").agg(exposure().alias("vega"))


def ladder_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book over the fine ladder: o, e_idx, t_idx, v."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = items.groupBy((F.col("l_partkey") % len(LADDER_EXPIRIES)).cast("int").alias("e_idx"), (F.col("l_suppkey") % len(LADDER_TENORS)).cast("int").alias("t_idx")).agg(exposure().alias("v"))
    return at.select((F.col("e_idx") * len(LADDER_TENORS) + F.col("t_idx")).alias("o"), "e_idx", "t_idx", "v")


def embedding_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of moves: t, x."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("x"))


def axis_frame(spark: SparkSession, years: Sequence[float]) -> DataFrame:
    """(i, years) of an axis."""
    return small_table(spark, [(i, float(y)) for i, y in enumerate(years)], "i int, years double")
