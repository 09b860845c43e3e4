"""Exact quantiles of groups of any size: a histogram finds the bins that hold the places asked for, and only what is in them is ordered.

No task holds a group's values: counts are added where the rows are, and what is ordered is a bin's distinct values, in a sort that spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACES = ("_below", "_k", "_next", "_share")


def exact_quantile(df: DataFrame, keys: list[str], value: Column, q: float, name: str, bins: int = 1024, rounds: int = 1, few: bool = False) -> DataFrame:
    """(*keys, name): the ``q`` quantile of ``value`` by group, linear between neighbours; nulls and NaN do not count; a group without values, or with a null key, has no row.

    The first histogram has ``bins`` to each factor of e on both sides of zero, so it needs no pass for the ends; further rounds split what
    they found evenly. ``df`` is read once a round and once more. Where the caller knows that groups are ``few`` (candidates, cells of a
    grid), their bins are broadcast and only values inside them travel.
    """
    whole = F.lit(True)
    for key in keys:
        whole &= F.col(key).isNotNull()
    rows = df.select(*keys, value.cast("double").alias("_v")).where(whole & F.expr("_v is not null and not isnan(_v)"))
    state = None
    for _ in range(rounds):
        own = rows if state is None else within(rows, state, keys, few)
        counted = own.withColumn("_bin", by_size(bins) if state is None else evenly(bins)).groupBy(*keys, "_bin").agg(
            F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *kept(state))
        held = ranked(counted, keys, "_bin", q, state).where("_upto > _k and _upto - _c <= _next")
        state = held.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min(F.col("_upto") - F.col("_c")).alias("_below"), *(F.min(c).alias(c) for c in PLACES[1:]))
    values = (rows if state is None else within(rows, state, keys, few)).groupBy(*keys, "_v").agg(F.count("*").alias("_c"), *kept(state))
    at = lambda place: F.min(F.when(F.col("_upto") > F.col(place), F.col("_v")))
    found = ranked(values, keys, "_v", q, state).groupBy(*keys).agg(at("_k").alias("_a"), at("_next").alias("_b"), F.min("_share").alias("_share"))
    a, b = F.col("_a"), F.col("_b")
    return found.select(*keys, F.when(a == b, a).otherwise(a + (b - a) * F.col("_share")).alias(name))


def by_size(bins: int) -> Column:
    """A bin that grows with the value, by its sign and logarithm."""
    size = F.floor(F.least(F.log(F.abs("_v")), F.lit(1e3)) * bins) + 746 * bins  # the logarithm of no double is under -746
    return F.when(F.col("_v") > 0, size).when(F.col("_v") < 0, -size).otherwise(F.lit(0))


def evenly(bins: int) -> Column:
    """One of ``bins`` equal parts from ``_lo`` to ``_hi``."""
    at = F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    return F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0))


def within(rows: DataFrame, state: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Rows in their group's bins."""
    return rows.join(F.broadcast(state) if few else state, keys).where("_v between _lo and _hi")


def kept(state: DataFrame | None) -> list[Column]:
    """What is known of a group goes along with its rows."""
    return [] if state is None else [F.first(c).alias(c) for c in PLACES]


def ranked(counted: DataFrame, keys: list[str], order: str, q: float, state: DataFrame | None) -> DataFrame:
    """With ``_upto``, how many of the group's values there are up to each row; the places that the quantile lies between are found first where they are not known."""
    group = W.partitionBy(*keys)
    if state is None:
        place = F.lit(float(q)) * (F.sum("_c").over(group) - 1)
        counted = counted.withColumn("_place", place).select(
            "*", F.lit(0).cast("long").alias("_below"), F.floor("_place").alias("_k"), F.ceil("_place").alias("_next"), (F.col("_place") - F.floor("_place")).alias("_share"))
    upto = F.col("_below") + F.sum("_c").over(group.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return counted.withColumn("_upto", upto)
