"""Moments of move vectors: what every factor model and covariance needs of its rows, in parts that merge.

Each part holds its rows' mean and sums about that mean, so nothing is lost where the level is large against the spread; two parts merge by
moving both to their common mean (Chan, Golub and LeVeque, 1983). Rows are summed where they are; what leaves a task is of the size of the grid
squared, whatever the number of rows. A training set is the merge of its blocks, so windows that overlap share the work on their rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Array = np.ndarray


def stacked(column: pd.Series) -> Array:
    """A column of arrays as a matrix of doubles."""
    return np.array(column.tolist(), float).reshape(len(column), -1)


@dataclass
class Moments:
    """Of rows y: how many, their mean, and with d = y - mean the sums of d d', |d|^2 d and |d|^4."""

    n: float
    mean: Array
    products: Array
    sized: Array
    fourth: float

    @classmethod
    def of(cls, y: Array) -> Moments:
        p = y.shape[1]
        if not len(y):
            return cls(0, np.zeros(p), np.zeros((p, p)), np.zeros(p), 0.0)
        mean = y.mean(axis=0)
        mean = mean + (y - mean).mean(axis=0)  # what rounding left of the first mean
        d = y - mean
        a = (d**2).sum(axis=1)
        return cls(len(y), mean, d.T @ d, a @ d, float((a**2).sum()))

    def about(self, point: Array) -> tuple[Array, Array, float]:
        """Products, sized and fourth about another point than the mean."""
        s = self.mean - point
        c, moved, size = s @ s, self.products @ s, np.trace(self.products)
        sized = self.sized + 2 * moved + (size + self.n * c) * s
        fourth = self.fourth + 4 * s @ self.sized + 4 * s @ moved + 2 * c * size + self.n * c * c
        return self.products + self.n * np.outer(s, s), sized, float(fourth)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        mean = self.mean + (other.mean - self.mean) * (other.n / n)
        return Moments(n, mean, *(a + b for a, b in zip(self.about(mean), other.about(mean), strict=True)))

    def flat(self) -> Array:
        return np.concatenate([[self.n, self.fourth], self.mean, self.sized, self.products.ravel()])

    @classmethod
    def from_flat(cls, flat: Array) -> Moments:
        p = int(round(np.sqrt(len(flat) - 1) - 1))  # 2 + 2p + p^2 numbers
        return cls(flat[0], flat[2 : 2 + p], flat[2 + 2 * p :].reshape(p, p), flat[2 + p : 2 + 2 * p], float(flat[1]))

    def centred(self) -> tuple[Array, Array, float]:
        """Mean, products of the centred rows, and the sum of their sizes' fourth powers."""
        if self.n < 1:
            raise ValueError("no rows")
        return self.mean, self.products, max(self.fourth, 0.0)


def merged(column: Iterable) -> Moments:
    """All flat moments of a column as one."""
    parts = [Moments.from_flat(np.asarray(v, float)) for v in column]
    total = parts[0]
    for part in parts[1:]:
        total = total.merge(part)
    return total


# ---- moments over tables of rows -------------------------------------------------------------------

#: kind tells sets of rows apart (transforms, say), weighting the scalings of their buckets.
PARTS = "kind string, weighting string, block long, low date, high date, moments array<double>"
Weights = Mapping[str, Mapping[str, Array]]


def part_frame(rows: list[tuple], columns: str = PARTS) -> pd.DataFrame:
    return pd.DataFrame({c.split(" ")[0]: pd.Series(v, dtype=object) for c, v in zip(columns.split(", "), zip(*rows, strict=True) if rows else [[]] * columns.count(", ") + [[]], strict=True)})


def partial_moments(rows: DataFrame, weights: Weights, block: int | None = None, most_kept: int = 64) -> DataFrame:
    """PARTS of rows (kind, t, date, x), made where the rows are: for each kind, weighting and block of ``block`` values of t (or all as block 0).

    A task keeps the moments of a few blocks and passes the others on, so a block may have several parts.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, tuple] = {}

        def drain() -> pd.DataFrame:
            out = part_frame([(*key, low, high, m.flat().tolist()) for key, (low, high, m) in kept.items()])
            kept.clear()
            return out

        for batch in batches:
            x, at = stacked(batch["x"]), batch["t"].to_numpy() // block if block else np.zeros(len(batch), np.int64)
            for (kind, b), own in pd.Series(np.arange(len(batch))).groupby([batch["kind"].to_numpy(), at]):
                days, y = batch["date"].iloc[own], x[own]
                for name, w in weights[kind].items():
                    low, high, m = min(days), max(days), Moments.of(y * w)
                    if (before := kept.get((kind, name, int(b)))) is not None:
                        low, high, m = min(low, before[0]), max(high, before[1]), before[2].merge(m)
                    kept[kind, name, int(b)] = low, high, m
                if len(kept) >= most_kept:
                    yield drain()
        if kept:
            yield drain()

    return rows.select("kind", "t", "date", "x").mapInPandas(run, PARTS)


def runs_of_blocks(batches: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, dict[int, tuple]]]:
    """Key and merged blocks (low, high, moments) of parts sorted by ``keys``, one key at a time, however many parts it has."""
    key, blocks = None, {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            own = tuple(getattr(row, k) for k in keys)
            if own != key:
                if blocks:
                    yield key, blocks
                key, blocks = own, {}
            low, high, m = row.low, row.high, Moments.from_flat(np.asarray(row.moments, float))
            if row.block in blocks:
                before = blocks[row.block]
                low, high, m = min(low, before[0]), max(high, before[1]), before[2].merge(m)
            blocks[row.block] = low, high, m
    if blocks:
        yield key, blocks


def whole_moments(rows: DataFrame, weights: Mapping[str, Array], salts: int = 32) -> DataFrame:
    """(weighting, moments) of all rows (x). Parts of one weighting meet in ``salts`` tasks first, each a few at a time, and those in one."""
    keys = ["kind", "weighting", "salt"]

    def run(batches):
        for (kind, name, _), blocks in runs_of_blocks(batches, keys):
            yield part_frame([(kind, name, b, *v[:2], v[2].flat().tolist()) for b, v in blocks.items()])

    parts = partial_moments(rows.select(F.lit("all").alias("kind"), F.lit(0).cast("long").alias("t"), F.lit("1970-01-01").cast("date").alias("date"), "x"), {"all": weights})
    for salt in (F.spark_partition_id() % salts, F.lit(0)):
        parts = parts.withColumn("salt", salt).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, PARTS)
    return parts.select("weighting", "moments")


def whole_sums(rows: DataFrame, weights: Array) -> Moments:
    """The moments of all rows, on the driver: as many numbers as the grid squared."""
    found = whole_moments(rows, {"all": weights}).first()
    return Moments.from_flat(np.array(found["moments"])) if found else Moments.of(np.zeros((0, len(weights))))


def whole_blocks(parts: DataFrame, block: int) -> DataFrame:
    """PARTS with one row a block, of those blocks that have all their rows."""
    keys = ["kind", "weighting", "block"]

    def run(batches):
        for (kind, name, _), blocks in runs_of_blocks(batches, keys):
            yield part_frame([(kind, name, b, low, high, m.flat().tolist()) for b, (low, high, m) in blocks.items() if m.n == block])

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, PARTS)


class Tree:
    """Merges of runs of consecutive blocks by dyadic nodes, each made once: any run takes a number of nodes that grows with its logarithm."""

    def __init__(self, blocks: Mapping[int, Moments]):
        self.nodes: dict[tuple[int, int], Moments | None] = {(0, b): m for b, m in blocks.items()}

    def node(self, level: int, at: int) -> Moments | None:
        if level and (level, at) not in self.nodes:
            self.nodes[level, at] = both(self.node(level - 1, 2 * at), self.node(level - 1, 2 * at + 1))
        return self.nodes.get((level, at))

    def run(self, low: int, high: int) -> Moments | None:
        """The moments of blocks low to high, end exclusive; None if there are none."""
        total, level = None, 0
        while low < high:
            if low & 1:
                total, low = both(total, self.node(level, low)), low + 1
            if high & 1:
                total, high = both(total, self.node(level, high - 1)), high - 1
            low, high, level = low >> 1, high >> 1, level + 1
        return total


def both(a: Moments | None, b: Moments | None) -> Moments | None:
    return a if b is None else b if a is None else a.merge(b)


FOLD_PARTS = "kind string, weighting string, window int, fold int, low date, high date, moments array<double>"


def fold_moments(rows: DataFrame, weights: Weights, windows: Sequence[tuple[int, int]], step: int, block: int) -> DataFrame:
    """:func:`fold_parts` of the blocks of rows (kind, t, date, x)."""
    return fold_parts(partial_moments(rows, weights, block), windows, step, block)


def fold_parts(parts: DataFrame, windows: Sequence[tuple[int, int]], step: int, block: int) -> DataFrame:
    """FOLD_PARTS of training sets, from PARTS of blocks: fold f of a (window, first) trains on the up to ``window`` rows before row first + f * step; all these are multiples of ``block``.

    Blocks meet in groups of as many as the longest window has, each group in one task; it holds a tree of its blocks and passes on one part for each
    fold that it has rows of. So a fold is the merge of two or three parts, whatever its length. Folds that start beyond the rows come out too, with what rows they have.
    """
    spread = 1 << max(max(w for w, _ in windows) // block - 1, 1).bit_length()
    keys = ["kind", "weighting", "spread"]

    def run(batches):
        for (kind, name, group), blocks in runs_of_blocks(batches, keys):
            tree, begin, end = Tree({b: m for b, (_, _, m) in blocks.items()}), group * spread, (group + 1) * spread
            days = sorted(blocks)
            out = []
            for window, first in windows:
                low_fold = max(0, -(-(begin * block + 1 - first) // step))
                for fold in range(low_fold, (end * block - 1 + window - first) // step + 1):
                    start = first + fold * step
                    low, high = max(max(start - window, 0) // block, begin), min(start // block, end)
                    own = [b for b in days if low <= b < high]
                    if own:
                        out.append((kind, name, window, fold, blocks[own[0]][0], blocks[own[-1]][1], tree.run(low, high).flat().tolist()))
                    if len(out) >= 64:
                        yield part_frame(out, FOLD_PARTS)
                        out = []
            if out:
                yield part_frame(out, FOLD_PARTS)

    dealt = parts.withColumn("spread", F.floor(F.col("block") / spread)).repartition(*keys).sortWithinPartitions(*keys, "block")
    return dealt.mapInPandas(run, FOLD_PARTS)
