"""What the text operators share: scratch tables, Arrow batches, packed integers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a record batch between Spark and a worker, which both hold outside the heap, in more than one copy.
BATCH_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and driver and executors are one process."""
    place = spark.sparkContext.getConf().get(SHARED) or spark.conf.get(SHARED, None)
    if not place:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError(f"set {SHARED} to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="factorloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        place = f"file://{local}"
        spark.conf.set(SHARED, place)
    return place


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and a lost executor costs nothing. ``free`` deletes the shuffled files of this step at its end, not when the driver collects its garbage."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` made, when nothing that is still to run reads them."""
    for table in tables:
        delete_path(table.sparkSession, table.scratch_path)


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def body(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions_for(df: DataFrame, least: int = 12) -> int:
    """Shuffle partitions as the session has them, for an explicit repartition."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bound_batches(spark: SparkSession) -> None:
    """Lets the session's record batches have no more than BATCH_BYTES (a lower bound of its own stays). It must hold when the plan runs, so it is not put back."""
    own = spark.conf.get(ARROW_BYTES, None) or ""
    now = int(own[:-1]) if re.fullmatch(r"-?\d+b", own) else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow: ``make()`` runs once a task and gives a function from a record batch, of about ``most`` bytes, to columns (or None).

    A worker outlives its task, so what Arrow's pool holds unused goes back at the task's end.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, most):
                out = work(part)
                if out is not None:
                    yield out
            part = out = None
        batch = work = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in even runs of rows of about ``most`` bytes, half as much again at most, so that work on a batch has bounded memory."""
    rows = batch.num_rows
    if not rows:
        return
    step = -(-rows // min(rows, max(1, round(batch.nbytes / most))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def batch_of(types: dict[str, pa.DataType], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if not isinstance(columns[k], pa.Array) else columns[k] for k, t in types.items()], names=list(types))
