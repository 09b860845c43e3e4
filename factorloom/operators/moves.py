"""Daily moves of a surface and their inverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import finite

TRANSFORMS = ("absolute", "relative", "log_relative")
FLOOR = 1e-8
#: Days of a range of dates, the unit of parallel work on a surface.
RANGE_DAYS = 92


def check_transform(transform: str) -> str:
    if transform not in TRANSFORMS:
        raise ValueError(f"transform must be one of {TRANSFORMS}, not {transform!r}")
    return transform


def moved(vol: Column, prev: Column, transform: str, floor: float = FLOOR) -> Column:
    """The move from prev to vol; null if either is."""
    floored = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))
    return {
        "absolute": vol - prev,
        "relative": (vol - prev) / floored(prev),
        "log_relative": F.log(floored(vol)) - F.log(floored(prev)),
    }[check_transform(transform)]


def to_absolute(x: Column, prev: Column, transform: str) -> Column:
    """The absolute move that x stands for, from the level before it as it is (not floored)."""
    return {"absolute": x, "relative": prev * x, "log_relative": prev * (F.exp(x) - 1)}[check_transform(transform)]


def to_absolute_linear(x: Column, prev: Column, transform: str) -> Column:
    """The same to first order, so that parts add up."""
    return x if check_transform(transform) == "absolute" else prev * x


def earlier(ranges: DataFrame, value: Column, *same: str) -> DataFrame:
    """(part, *same, found): ``value`` over the ranges before each one, of equal ``same``. There are as many rows as ranges of dates, so pairs of them are few; no task sees all."""
    a, b = ranges.alias("a"), F.broadcast(ranges).alias("b")
    rule = F.col("b.part") < F.col("a.part")
    for c in same:
        rule = rule & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, rule).groupBy("a.part", *(f"a.{c}" for c in same)).agg(value.alias("found"))


def levels(surface: DataFrame, grid: DataFrame, days: int = RANGE_DAYS) -> DataFrame:
    """(part, date, vol, prev): each date's levels in bucket order and those of the date before, null where a bucket has none.

    Cells are dealt by ranges of dates, and all that follows stays in its range; only the last date of each range goes to the next that has rows.
    """
    at = F.floor(F.datediff(F.col("date"), F.lit("1970-01-01")) / days).cast("int")
    cells = surface.join(F.broadcast(grid.select("expiry", "tenor", "bucket")), ["expiry", "tenor"], "left")
    cells = cells.select(at.alias("part"), "date", "bucket", finite(F.col("vol")).alias("vol")).repartition("part")
    present = F.collect_list(F.when(F.col("vol").isNotNull() & F.col("bucket").isNotNull(), F.struct("bucket", "vol")))
    by_date = cells.groupBy("part", "date").agg(F.array_sort(present).alias("cells")).crossJoin(F.broadcast(grid.agg(F.count("*").alias("p"))))
    rows = by_date.select("part", "date", F.when(F.size("cells") == F.col("p"), F.col("cells.vol")).alias("vol"))
    order = W.partitionBy("part").orderBy("date")
    last = rows.groupBy("part").agg(F.max_by(F.struct("vol"), "date").alias("end"))
    lead = earlier(last, F.max_by("b.end", "b.part"))
    joined = rows.join(F.broadcast(lead), "part", "left")
    prev = F.when(F.row_number().over(order) == 1, F.col("found.vol")).otherwise(F.lag("vol").over(order))
    return joined.select("part", "date", "vol", prev.alias("prev"))


def all_move_rows(surface: DataFrame, grid: DataFrame, transforms: Sequence[str], floor: float = FLOOR, days: int = RANGE_DAYS) -> DataFrame:
    """(transform, t, date, x, dvol, prev) with arrays in bucket order: moves of the dates on which every bucket has one; t counts them from 0.

    A missing cell takes this date's and the next date's moves with it, and dates that are not neighbours are never paired. A date's number is its place
    in its range and the count of rows in the ranges before.
    """
    known = levels(surface, grid, days).where("vol is not null and prev is not null")
    kind = lambda t: F.struct(F.lit(check_transform(t)).alias("transform"), F.zip_with("vol", "prev", lambda v, p: moved(v, p, t, floor)).alias("x"))
    kinds = F.explode(F.array(*map(kind, transforms)))
    moves = known.select("part", "date", kinds.alias("k"), F.zip_with("vol", "prev", lambda v, p: v - p).alias("dvol"), "prev").select("part", "k.transform", "date", "k.x", "dvol", "prev")
    whole = moves.where(F.forall("x", lambda v: finite(v).isNotNull()))
    counts = whole.groupBy("part", "transform").agg(F.count("*").alias("n"))
    before = earlier(counts, F.sum("b.n"), "transform")
    place = F.row_number().over(W.partitionBy("part", "transform").orderBy("date")) - 1
    numbered = whole.withColumn("place", place).join(F.broadcast(before), ["part", "transform"], "left")
    return numbered.select("transform", (F.coalesce("found", F.lit(0)) + F.col("place")).cast("long").alias("t"), "date", "x", "dvol", "prev")


def move_rows(surface: DataFrame, grid: DataFrame, transform: str = "absolute", floor: float = FLOOR) -> DataFrame:
    """(t, date, x, dvol, prev) of one transform."""
    return all_move_rows(surface, grid, [transform], floor).drop("transform")


def move_cells(rows: DataFrame) -> DataFrame:
    """(t, date, bucket, x, dvol, prev) of rows with arrays."""
    cells = rows.select("t", "date", F.posexplode(F.arrays_zip("x", "dvol", "prev")).alias("bucket", "c"))
    return cells.select("t", "date", "bucket", "c.x", "c.dvol", "c.prev")


def compute_moves(surface: DataFrame, grid: DataFrame, transform: str = "absolute", floor: float = FLOOR) -> DataFrame:
    """(t, date, bucket, x, dvol, prev): :func:`move_rows` by bucket."""
    return move_cells(move_rows(surface, grid, transform, floor))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def full_pnl(rows: DataFrame, aligned: DataFrame) -> DataFrame:
    """(t, date, full_pnl): each date's absolute moves, as an array, priced with the book, which is one array beside them."""
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "vega")))
    book = aligned.agg(ordered["vega"].alias("book"))
    return rows.crossJoin(F.broadcast(book)).select("t", "date", dot("dvol", "book").alias("full_pnl"))
