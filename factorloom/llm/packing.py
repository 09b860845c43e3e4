"""Best-fit packing of tokenised documents into sequences, by bin completion over a histogram of lengths.

Pieces of equal length are interchangeable, so the search works on how many pieces there are of each length: at most ``capacity``
numbers, however large the corpus. Its answer, a list of fillings with multiplicities, goes back to the pieces by their
rank within their length, which is counted part by part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import WORDS, Vocabulary
from .common import batch_of, body, map_batches, written

CAPACITY, END_ID = 1024, 2
#: Fillings that the search may try, over all, before it returns the best packing so far: its one bound.
NODES = 5_000

Filling = tuple[int, ...]


def lower_bound(counts: list[int], capacity: int) -> int:
    """Martello and Toth's second bound: pieces over half share no bin, and large ones leave room for few others."""
    c = np.array(counts[: capacity + 1], np.int64)
    size = np.arange(capacity + 1)
    best, total = -(-int(c @ size) // capacity), c * size
    n_up, s_up = np.cumsum(c[::-1])[::-1], np.cumsum(total[::-1])[::-1]
    half = capacity // 2 + 1
    for k in range(1, capacity // 2 + 1):  # large: over capacity - k; middle: over half; small: at least k
        large = capacity - k + 1
        middle_n, middle_s = int(n_up[half] - (n_up[large] if large <= capacity else 0)), int(s_up[half] - (s_up[large] if large <= capacity else 0))
        small = int(s_up[k] - s_up[half])
        best = max(best, int(n_up[half]) + max(0, -(-(small - (middle_n * capacity - middle_s)) // capacity)))
    return best


def best_fit_decreasing(counts: list[int], capacity: int) -> list[tuple[Filling, int]]:
    """Fillings with multiplicities: each length, largest first, goes to the fullest bins with room."""
    open_bins: dict[int, list[list]] = {}
    for size in range(capacity, 0, -1):
        left = counts[size]
        while left:
            room = next((r for r in range(size, capacity) if open_bins.get(r)), None)
            if room is None:
                fits = capacity // size
                full, rest = divmod(left, fits)
                if full:
                    open_bins.setdefault(capacity - fits * size, []).append([(size,) * fits, full])
                if rest:
                    open_bins.setdefault(capacity - rest * size, []).append([(size,) * rest, 1])
                left = 0
            else:
                filling, n = open_bins[room].pop()
                used = min(n, left)
                if n > used:
                    open_bins[room].append([filling, n - used])
                open_bins.setdefault(room - size, []).append([(*filling, size), used])
                left -= used
    return [(f, n) for bins in open_bins.values() for f, n in bins]


def sums_from(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """For each place in ``sizes``, the sums up to ``room`` that pieces of it and the later sizes can make, as bits."""
    out, sums, mask = [1] * (len(sizes) + 1), 1, (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        left, k = min(counts[sizes[i]], room // sizes[i]), 1
        while left:  # by multiples of 1, 2, 4, ...
            take = min(k, left)
            sums |= sums << (sizes[i] * take) & mask
            left, k = left - take, k * 2
        out[i] = sums
    return out


def fillings(counts: list[int], room: int) -> Iterator[Filling]:
    """All undominated fillings of ``room`` by available pieces, larger sums first and among equal sums larger pieces first.

    One piece dominates every filling that is no larger, so sums end there. A filling in which a free piece could take the place of two, being
    at least as large as both and no larger than they and the waste, is dominated by that exchange: the two fit wherever the one would be.
    """
    sizes = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s]]
    if not sizes:
        yield ()
        return
    single, free = sizes[0], counts.copy()
    if single < room:
        sums = sums_from(sizes, counts, room)
        available = sum(1 << s for s in sizes)
        for total in range(room, single, -1):
            if sums[0] >> total & 1:
                yield from completions(sizes, sums, free, available, 0, total, room - total, [])
    yield (single,)


def completions(sizes: list[int], sums: list[int], free: list[int], available: int, start: int, rest: int, waste: int, chosen: list[int]) -> Iterator[Filling]:
    """Undominated ways to add pieces of just ``rest`` to those chosen, of sizes from ``start`` on. ``free`` counts what is left beside them."""
    if not rest:
        yield tuple(chosen)
        return
    if not sums[start] >> rest & 1:
        return
    for i in range(start, len(sizes)):
        size = sizes[i]
        if size > rest or not free[size] or not sums[i] >> (rest - size) & 1:
            continue
        free[size] -= 1
        dominated = False
        for other in chosen:
            swaps = available >> (size + other) & ((2 << waste) - 1)
            while swaps and not dominated:
                dominated = free[size + other + (swaps & -swaps).bit_length() - 1] > 0
                swaps &= swaps - 1
        if not dominated:
            chosen.append(size)
            yield from completions(sizes, sums, free, available, i, rest - size, waste, chosen)
            chosen.pop()
        free[size] += 1


def bin_completion(counts: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Packs ``counts[size]`` pieces of each size into few bins: fillings and how many bins have each.

    Depth-first branch and bound around the largest size left, over all undominated fillings, each first as often as its pieces allow and
    then once. Best-fit decreasing gives the first incumbent; a branch whose waste leaves no better total is cut; the search ends at the
    lower bound, when nothing is left to try, or after ``nodes`` fillings. A better incumbent replaces the former.
    """
    total = sum(size * n for size, n in enumerate(counts))
    best = best_fit_decreasing(counts, capacity)
    bins, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    left, used, wasted = counts.copy(), 0, 0
    path: list[tuple[Filling, int, Iterator]] = []
    largest = capacity

    def options() -> Iterator[tuple[Filling, int]]:
        own, around = left.copy(), largest
        own[around] -= 1
        for more in fillings(own, capacity - around):
            filling = (around, *more)
            most = min(left[size] // filling.count(size) for size in set(filling))
            yield filling, most
            if most > 1:
                yield filling, 1

    choice = None
    while bins > bound:
        if choice is None:
            while largest and not left[largest]:
                largest -= 1
            if not largest:  # all placed
                if used < bins:
                    bins, best = used, [(f, n) for f, n, _ in path]
                choice = iter(())
            else:
                choice = options()
        option = next(choice, None)
        if nodes <= 0 or option is None and not path:
            break
        if option is None:
            filling, times, choice = path.pop()
            for size in filling:
                left[size] += times
            used, wasted, largest = used - times, wasted - times * (capacity - sum(filling)), filling[0]
            continue
        nodes -= 1
        filling, times = option
        waste = times * (capacity - sum(filling))
        if wasted + waste + total > (bins - 1) * capacity:
            continue
        for size in filling:
            left[size] -= times
        used, wasted = used + times, wasted + waste
        path.append((filling, times, choice))
        choice = None
    return best


def runs_of(packing: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, sequence of the first, offset): which ranks of each length go where."""
    cursor: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in packing:
        offset = 0
        for size in filling:
            rank = cursor.get(size, 0)
            rows.append((size, rank, rank + times, sequence, offset))
            cursor[size] = rank + times
            offset += size
        sequence += times
    return rows


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but perhaps the first."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each tokenised document with END_ID after it: doc_id, piece, start, length, ids_crc32.

    Null and empty texts are END_ID alone; very long ones are encoded whole and only then cut; repeated rows and null ids have pieces of their own; an
    empty table has none; further columns are ignored.
    """
    name = path.rsplit("/", 1)[-1]
    docs.sparkSession.sparkContext.addFile(path)
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def make():
        import tiktoken

        words = Vocabulary(SparkFiles.get(name))
        ranks = {t: i for i, t in enumerate(words.tokens) if i not in words.special.values()}
        coder = tiktoken.Encoding(name, pat_str=WORDS, mergeable_ranks=ranks, special_tokens=words.special)

        def ids_of(text: str) -> np.ndarray:
            ids = coder.encode(text, allowed_special="all") if any(s in text for s in words.special) else coder.encode_ordinary(text)
            return np.array([*ids, END_ID], "<u4")

        def work(batch):
            out: dict[str, list] = {k: [] for k in types}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text)
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    for k, v in zip(types, (doc_id, piece, start, length, zlib.crc32(ids[start : start + length])), strict=True):
                        out[k].append(v)
            return batch_of(types, out)

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), body()), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; no row goes, equal rows are different pieces, an empty table stays empty.

    Other columns may have any name and hold nulls, but for sequence_id and offset, which are added.

    Pieces are ranked within their length by part (a slice of the rows, written first) and place in it: a window over each part and
    length, and a running sum of the parts' counts, so a very common length is no hot group. The driver holds the histogram and
    the runs of ranks; both are bounded by the capacity (some thousands of rows), not by the corpus, so the runs are broadcast.
    """
    spark = pieces.sparkSession
    parts = written(pieces.select(F.struct(*pieces.columns).alias("piece"), F.col("length").cast("long").alias("length"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "pieces")
    sizes = written(parts.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = [0] * (capacity + 1)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    runs = spark.createDataFrame(runs_of(bin_completion(histogram, capacity, nodes)), "size long, low long, high long, sequence long, offset long")
    before = sizes.select("part", "length", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = parts.withColumn("place", F.row_number().over(W.partitionBy("part", "length").orderBy("row")) - 1)
    ranked = ranked.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("piece.*", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    One row a piece. Null and empty texts are one piece, the end id alone. Repeated rows are packed each; a null doc_id is carried; an
    empty table gives an empty result; further columns are ignored.
    """
    return pack(token_pieces(docs, path, capacity), capacity)
