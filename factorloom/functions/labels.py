"""Tenor labels and calendar columns, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_years(label: Column) -> Column:
    """Years of a label: ``18M`` is 1.5, ``10Y`` is 10, a bare number itself; anything else raises."""
    clean = F.upper(F.trim(label))
    number = F.when(clean.endswith("M") | clean.endswith("Y"), F.expr("0").cast("string")).otherwise(clean)
    body = F.substring(clean, F.lit(1), F.greatest(F.length(clean) - 1, F.lit(0)))
    value = F.when(clean.endswith("M"), body.try_cast("double") / 12).when(clean.endswith("Y"), body.try_cast("double")).otherwise(number.try_cast("double"))
    return F.when(label.isNull() | value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not a tenor: "), label)).cast("double"))


def split_label(label: Column) -> Column:
    """Struct of expiry and tenor from ``1Yx10Y`` (an ``x`` is looked for first; just two parts) or ``1Y_10Y`` (cut at the first ``_``)."""
    low = F.lower(label)
    by_x, by_bar = F.split(low, "x"), F.split(low, "_", 2)
    parts = F.when(low.contains("x") & (F.size(by_x) == 2), by_x).when(~low.contains("x") & low.contains("_"), by_bar)
    parts = F.when(parts.isNull(), F.raise_error(F.concat(F.lit("not a surface column: "), label)).cast("array<string>")).otherwise(parts)
    return F.struct(F.upper(parts[0]).alias("expiry"), F.upper(parts[1]).alias("tenor"))


def finite(value: Column) -> Column:
    """The number as a double, NaN and infinities as null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def weekday_after(start: Column, place: Column) -> Column:
    """The weekday (Monday to Friday) that comes ``place`` weekdays after the first one from ``start`` on, by arithmetic on the day number."""
    offset = F.weekday(start)  # Monday is 0
    at = place + F.least(offset, F.lit(5))  # weekdays of the first week before the start
    return F.date_add(F.date_sub(start, offset), (F.floor(at / 5) * 7 + at % 5).cast("int"))


def business_days(spark: SparkSession, start: str, periods: int) -> DataFrame:
    """(k, date) of the first ``periods`` weekdays from ``start`` on."""
    return spark.range(periods).select(F.col("id").alias("k"), weekday_after(F.to_date(F.lit(start)), F.col("id")).alias("date"))


def business_calendar(dates: DataFrame, column: str) -> DataFrame:
    """(k, date) of all weekdays from a table's first date to its last."""
    ends = dates.agg(F.min(F.col(column).cast("date")).alias("low"), F.max(F.col(column).cast("date")).alias("high"))
    days = ends.select("low", "high", F.explode(F.sequence(F.lit(0), F.datediff("high", "low"))).alias("k"))
    return days.select(F.col("k").cast("long").alias("k"), weekday_after(F.col("low"), F.col("k")).alias("date"), "high").where("date <= high").drop("high")
