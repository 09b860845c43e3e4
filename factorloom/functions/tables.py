"""Small tables made of parameters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, rows: Iterable[Sequence], columns: str) -> DataFrame:
    """A few rows at hand as a local relation, which the optimiser sees through and which needs no task of its own, as rows handed over as an RDD do."""
    schema = StructType.fromDDL(columns)
    listed = [dict(zip(schema.names, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(listed, schema=to_arrow_schema(schema)), schema)
