"""CSV and Parquet in and out."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.labels import finite, split_label
from ..operators.grid import matrix

SHARED = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for files that driver and executors share, in the folder that the session names; a temporary one only where none is named and they are one process."""
    place = spark.sparkContext.getConf().get(SHARED) or spark.conf.get(SHARED, None)
    if not place:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError(f"set {SHARED} to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="factorloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        place = f"file://{local}"
        spark.conf.set(SHARED, place)
    return f"{place}/files/{name}-{uuid.uuid4().hex}"


def unpivot(wide: DataFrame, key: str, name: str, value: str) -> DataFrame:
    return wide.unpivot([key], [c for c in wide.columns if c != key], name, value)


def surface_from_wide(wide: DataFrame, date: str | None = None) -> DataFrame:
    """(date, expiry, tenor, vol) of a table with a date column (the first, if none is named) and one column a bucket, labelled ``1Yx10Y`` or ``1Y_10Y``."""
    date = date or wide.columns[0]
    cast = wide.select(F.col(date).cast("date").alias("date"), *(F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns if c != date))
    long = unpivot(cast, "date", "label", "vol")
    return long.select("date", split_label(F.col("label")).alias("at"), finite(F.col("vol")).alias("vol")).select("date", "at.expiry", "at.tenor", "vol")


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    """A history file: header, first column the date."""
    return surface_from_wide(spark.read.csv(path, header=True))


def vega_from_wide(wide: DataFrame, expiry: str | None = None) -> DataFrame:
    """(expiry, tenor, vega) of a matrix with expiries in the first column and one column a tenor."""
    expiry = expiry or wide.columns[0]
    cast = wide.select(F.upper(F.trim(F.col(expiry))).alias("expiry"), *(F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns if c != expiry))
    long = unpivot(cast, "expiry", "label", "vega")
    return long.select("expiry", F.upper(F.trim("label")).alias("tenor"), finite(F.col("vega")).alias("vega"))


def read_vega(spark: SparkSession, path: str) -> DataFrame:
    return vega_from_wide(spark.read.csv(path, header=True))


def read_ladder(spark: SparkSession, path: str) -> DataFrame:
    """(o, e_idx, t_idx, e_years, t_years, v) of a matrix whose labels are years; rows and columns keep the file's order."""
    wide = spark.read.csv(path, header=True)
    tenors = [float(c) for c in wide.columns[1:]]
    rows = wide.select(F.col(wide.columns[0]).cast("double").alias("e_years"), F.array(*(F.col(f"`{c}`").cast("double") for c in wide.columns[1:])).alias("cells"), F.monotonically_increasing_id().alias("line"))
    places = [r["e_years"] for r in rows.orderBy("line").select("e_years").collect()]  # an axis, as long as the matrix has rows
    at = rows.select(F.array_position(F.lit(places), F.col("e_years")).cast("int").alias("e"), "e_years", F.posexplode("cells").alias("t_idx", "v"))
    years = F.lit(tenors)
    return at.select(((F.col("e") - 1) * len(tenors) + F.col("t_idx")).alias("o"), (F.col("e") - 1).alias("e_idx"), "t_idx", "e_years", F.get(years, F.col("t_idx")).alias("t_years"), finite(F.col("v")).alias("v"))


def write_matrix(wide: DataFrame, path: str, *order: str) -> None:
    """A matrix in one CSV file with a header, its rows in order; it has a row a date or expiry."""
    wide.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_surface(surface: DataFrame, expiries: Sequence[str], tenors: Sequence[str], path: str) -> None:
    """A history file that :func:`read_surface` reads: a row a date, a column a bucket of the axes; cells without a value are empty."""
    labels = [f"{e}x{t}" for e in expiries for t in tenors]
    cells = surface.select("date", F.concat("expiry", F.lit("x"), "tenor").alias("label"), "vol")
    write_matrix(cells.groupBy("date").pivot("label", labels).agg(F.first("vol")), path, "date")


def write_vega(vega: DataFrame, tenors: Sequence[str], path: str) -> None:
    """A book file that :func:`read_vega` reads: a row an expiry, a column a tenor."""
    write_matrix(matrix(vega, tenors, "vega"), path, "expiry")


def write_ladder(fine: DataFrame, expiries: Sequence[float], tenors: Sequence[float], path: str) -> None:
    """A ladder (e_idx, t_idx, v) as the matrix that :func:`read_ladder` reads, labelled in years."""
    rows = fine.select("e_idx", F.get(F.lit([float(y) for y in expiries]), F.col("e_idx")).alias("years"), "t_idx", "v")
    wide = rows.groupBy("years").pivot("t_idx", list(range(len(tenors)))).agg(F.first("v"))
    write_matrix(wide.toDF("years", *(str(float(y)) for y in tenors)), path, "years")


def write_results(summary: DataFrame, path: str) -> None:
    """The ranked summary in one CSV file with a header; the table has a row a model and window."""
    from ..operators.validate import ranking

    summary.orderBy(*ranking()).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files that :func:`write_results`, or :func:`write_predictions` as CSV, wrote: empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True)


def write_predictions(predictions: DataFrame, path: str, form: str = "parquet") -> None:
    """Predictions by window; as Parquet, or CSV with a header."""
    writer = predictions.write.mode("overwrite").partitionBy("window")
    writer.parquet(path) if form == "parquet" else writer.csv(path, header=True)


def load_inputs(spark: SparkSession, source: str, *, surface: str = "", vega: str = "", sf_dir: str = "") -> tuple[DataFrame, DataFrame]:
    """The surface and the book, from two CSV files (``csv``) or from the warehouse tables (``tables``)."""
    from . import panels

    if source == "csv":
        return read_surface(spark, surface), read_vega(spark, vega)
    if source == "tables":
        return panels.price_surface(spark, sf_dir), panels.panel_book(spark, sf_dir)
    raise ValueError(f"no source named {source}")
