"""Days as they arrive: a stream of surface rows appended to the history, and the walk-forward carried on from what it had."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.tables import small_table
from ..operators import sums
from ..operators.factors import Spec
from ..operators.folds import block_size
from ..operators.moves import all_move_rows
from ..operators.validate import dims_of, fold_starts, scored, test_folds, vega_array, weightings


def append_days(stream: DataFrame, path: str, checkpoint: str, renew: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends a stream (date, expiry, tenor, vol) to a Parquet history once a batch, then calls ``renew`` with the whole history and the batch's number.

    A batch that is run again after a failure replaces its own part, so no day comes twice.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if renew:
            renew(batch.sparkSession.read.parquet(path).drop("batch"), number)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class WalkForwardStore:
    """A walk-forward that grows by days: the moments of all whole blocks and the predictions so far, as Parquet files by batch.

    A new batch of days is read from the last whole block on. Its blocks are added, and only folds with new test rows are fitted, from stored
    blocks and new ones. Days come in ascending order. Weights and prices come from the book, so a store keeps its first one and refuses another. A batch that is run
    again replaces its own files and reads only those of batches before it.
    """

    def __init__(self, spark: SparkSession, path: str, specs: Sequence[Spec], windows: Sequence[int], horizon: int = 20, step: int = 20, min_train: int | None = None):
        self.spark, self.path, self.specs = spark, path, list(specs)
        self.windows, self.horizon, self.step = list(windows), horizon, step
        self.starts, self.block = fold_starts(windows, min_train), block_size(windows, step, min_train)

    def stored(self, name: str, columns: str, before: int | None = None) -> DataFrame:
        """A table's rows of all batches, or of those before one; the batch is a column."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return small_table(self.spark, [], f"{columns}, batch int")
        rows = self.spark.read.schema(f"{columns}, batch int").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def predictions(self) -> DataFrame:
        """PREDICTIONS of all batches; a fold that failed in several counts once."""
        return self.stored("predictions", schemas.PREDICTIONS).drop("batch").dropDuplicates(["model", "window", "fold", "t", "failure"])

    def checked_price(self, grid: DataFrame, vega: DataFrame, batch: int) -> np.ndarray:
        price = vega_array(grid, vega)
        first = self.stored("book", "price array<double>", batch).orderBy("batch").first()
        if first and not np.array_equal(np.array(first["price"], float), price, equal_nan=True):
            raise ValueError("the book has changed: weights and prices of the stored batches were others; begin a new store")
        self.write(small_table(self.spark, [(price.tolist(),)], "price array<double>"), "book", batch)
        return price

    def extend(self, surface: DataFrame, grid: DataFrame, vega: DataFrame, batch: int) -> None:
        """Takes in the days that the history (date, expiry, tenor, vol) has beyond those of the batches before."""
        price, dims = self.checked_price(grid, vega, batch), dims_of(grid)
        blocks, weights = self.stored("blocks", sums.PARTS, batch), weightings(self.specs, price)
        ends = {r["kind"]: (r["blocks"], r["high"]) for r in blocks.groupBy("kind").agg((F.max("block") + 1).alias("blocks"), F.max("high").alias("high")).collect()}
        seen = {r["transform"]: r["n"] for r in self.stored("predictions", schemas.PREDICTIONS, batch).groupBy("transform").agg((F.max("t") + 1).alias("n")).collect()}
        tails = []
        for kind in sorted(weights):
            count, high = ends.get(kind, (0, None))
            tail = surface if high is None else surface.where(F.col("date") >= F.lit(high))  # that day's levels are those before the next
            tails.append(all_move_rows(tail, grid, [kind]).withColumnRenamed("transform", "kind").withColumn("t", F.col("t") + count * self.block))
        rows = reduce(DataFrame.unionByName, tails)
        made = sums.whole_blocks(sums.partial_moments(rows, weights, self.block), self.block)
        self.write(made, "blocks", batch)
        new = reduce(lambda a, b: a | b, ((F.col("kind") == k) & (F.col("t") >= F.lit(seen.get(k, 0) or 0)) for k in weights))
        reach = max(w for w, _ in self.starts) + self.horizon
        near = reduce(lambda a, b: a | b, ((F.col("kind") == k) & ((F.col("block") + 1) * self.block > (seen.get(k, 0) or 0) - reach) for k in weights))
        known = self.stored("blocks", sums.PARTS, batch + 1).where(near).drop("batch")
        train = sums.fold_parts(known, self.starts, self.step, self.block)
        self.write(scored(test_folds(rows.where(new), price, self.starts, self.horizon, self.step), train, self.specs, price, dims), "predictions", batch)
