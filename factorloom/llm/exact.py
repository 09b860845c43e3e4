"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are first reduced to one row a digest
(combined before the shuffle, so a text with very many copies is no hot key), then a sort-merge
anti-join against the index, which needs no shuffle of the index, finds the digests not seen before;
those are appended.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import body, delete_path, dropped, path_exists, scratch_path, written

#: Ranges of doc_id, one after the other, in which a whole table is admitted.
RANGES = 2


def digest(column: str = "text") -> Column:
    """SHA-256 of the text in UTF-8; null counts as the empty text."""
    return F.unhex(F.sha2(body(column), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row) of every row, written."""
    return written(docs.select(F.col("doc_id").cast("long"), digest().alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


class DigestIndex:
    """Digests admitted so far: (digest, keep_id, batch), bucketed and sorted by digest.

    A batch that failed half-way is run again under its name: the digests that it had appended count as its own, so their rows stay.

    The files at ``path`` are the index; the catalogue's entry is made anew where it is missing, as after a restart. Files that are
    there but cannot be opened as an index raise.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = 48):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, "digest-index")
        if not self.exists() and path_exists(spark, self.path):
            self.buckets = spark.read.parquet(f"{self.path}-layout").first()["buckets"]
            spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds one row a digest; each bucket is written by one task."""
        if not self.exists():
            self.spark.createDataFrame([(self.buckets,)], "buckets int").write.mode("overwrite").parquet(f"{self.path}-layout")
        own = groups.select("digest", F.col("keep_id").cast("long").alias("keep_id"), F.lit(batch).alias("batch"))
        own.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        """Removes the index with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for place in (self.path, f"{self.path}-layout"):
            delete_path(self.spark, place)

    def decide(self, rows: DataFrame, batch: str) -> DataFrame:
        """(digest, keep_id, keep_row, group_size), one row a digest of ``rows`` (doc_id, digest, row); new digests are appended. The result is a written table.

        keep_row is the row that stays, null if the index had the text before; keep_id is then the indexed row's. What this batch
        itself appended for the same doc_id, in a run that failed, is not "before".
        """
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
        groups = written(groups.select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"), "digest-groups")
        if not self.exists():
            self.append(groups, batch)
            return groups
        known = self.table().select("digest", F.col("keep_id").alias("known_id"), "batch")
        fresh = written(groups.join(known.select("digest").hint("merge"), "digest", "left_anti"), "digest-fresh")
        again = (F.col("batch") == batch) & F.col("known_id").eqNullSafe(F.col("keep_id"))
        met = groups.join(known.hint("merge"), "digest").select("digest", F.col("known_id").alias("keep_id"), F.when(again, F.col("keep_row")).alias("keep_row"), "group_size")
        decisions = written(fresh.union(met), "digest-decisions")  # before the index grows
        self.append(fresh, batch)
        dropped(groups, fresh)
        return decisions

    def admit(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Decides on every row of ``docs`` and appends its new digests under the batch's name; a batch that failed is run again under the same one.

        Returns one row a row: doc_id, keep_id, group_size (rows of this batch with the text), kept,
        text_sha256. Of equal texts the row with the largest doc_id stays (a null doc_id counts as the
        smallest); of repeated rows with the same doc_id and text exactly one stays; if the index has the
        text already, none stays and keep_id is the indexed row's. Null text counts as empty. An empty table gives
        an empty result. Further columns are ignored.
        """
        rows = digests(docs)
        return judged(rows, self.decide(rows, batch or uuid.uuid4().hex))


def judged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The decisions on digests, row by row. ``groups`` is a written table, so Spark can split a digest of very many rows."""
    return rows.hint("merge").join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, ranges: int = RANGES, batch: str | None = None) -> DataFrame:
    """All of ``docs`` against one index, by ranges of doc_id from the highest down and null ids last; see :meth:`DigestIndex.admit`.

    So of equal texts the largest doc_id is the first to be admitted, and the anti-join drops the others of later ranges. group_size
    counts the rows of all ranges. A run that fails between ranges is made again under its ``batch`` name with the same result. Without an
    index one is made for the run and removed after it.
    """
    own, batch, rows = index or DigestIndex(docs.sparkSession), batch or uuid.uuid4().hex, digests(docs)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)]).alias("at")).first()["at"] or []
    edges = [None, *sorted(set(cuts), reverse=True), None]
    parts = []
    for above, low in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if above is None else F.coalesce(F.col("doc_id") < above, F.lit(True))
        parts.append(own.decide(rows.where(inside & (F.lit(True) if low is None else F.coalesce(F.col("doc_id") >= low, F.lit(False)))), batch))
    groups = reduce(DataFrame.union, parts).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"), F.sum("group_size").alias("group_size"))
    groups = written(groups, "digest-groups")
    dropped(*parts)
    if index is None:
        own.drop()
    return judged(rows, groups)


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without its exact copies, all columns as they were whatever their names; the rows that stay are those that :func:`exact_dedup` keeps.

    Null texts count as empty, null ids as the smallest; of repeated rows one stays; an empty table stays empty.
    """
    kept = exact_dedup(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), digest().alias("digest"))
    paired = own.hint("merge").join(kept, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    once = W.partitionBy("id", "digest").orderBy(F.lit(0))
    return paired.withColumn("copy", F.row_number().over(once)).where("copy = 1").select("row.*")
