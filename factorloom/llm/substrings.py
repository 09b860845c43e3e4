"""Removal of long byte strings that an earlier document has, by hash-compared suffix sorting.

Windows of ``LENGTH`` bytes are what may repeat. Each window has an anchor, the least hash of its ``GRAM``-byte strings; windows in a row with one
anchor are a run, and a run's bytes are hashed as a whole from the text's prefix hashes. Runs are dealt by anchor:

* a run whose whole string an earlier document has is covered;
* a run whose anchor other documents have, but not its whole string, may share some of its windows. Only such runs go to the suffix sort: in each
  block of documents their windows are sorted by merging, comparing suffixes by their longest common extension (binary search over
  prefix hashes), equal neighbours are verified byte by byte, and each class's least doc_id is then found over all blocks, as runs are.

Strings of different blocks are equal when their hashes are: 64 bits of the string and at least 32 of its anchor. Only windows of one block are
compared byte by byte. The prefix hashes are modulo 2^64; strings made to collide there need over a thousand bytes, and spans have under 300.

Equal runs and windows of one block are reduced to one before anything is shuffled, so a passage that very many documents share is no
hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, body, dropped, map_batches, slices, written
from .lexicon import gather_runs
from .neardup import mixed

LENGTH, GRAM = 50, 26
#: Bytes of text whose runs one group of the anchor join holds, and parts in which a group is judged.
GROUP_BYTES, PARTS = 24 << 20, 8
#: Bytes of texts whose runs are packed at once, or of windows that one suffix sort takes, and bytes of a window when it is shuffled: the windows are compared in as many passes as keep these under the texts' own bytes.
BLOCK_BYTES, WINDOW_BYTES = 4 << 20, 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SYMBOLS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: A null doc_id comes before all others.
LEAST_ID = np.iinfo(np.int64).min


class Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        while len(cls.up) < n:
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(BASE, len(cls.up), 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(INVERSE, len(cls.down), 1 << 64))])


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, modulo 2^64, of bytes that are first spread over 64 bits."""
    Powers.reach(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(SYMBOLS[raw] * Powers.up[: len(raw)], out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, equal for equal strings wherever they stand."""
    return (prefix[ends] - prefix[starts]) * Powers.down[starts]


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def runs_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, string hash, first window, windows) of each run of a text's windows; none for a text under LENGTH bytes."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    prefix = prefix_hashes(raw)
    grams = mixed((prefix[GRAM:] - prefix[: n + 1 - GRAM]) * Powers.down[: n + 1 - GRAM])
    least = least_in_windows(grams, LENGTH - GRAM + 1)
    low = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    # A text of one repeated string has very long runs; they are cut, by place, so that a run stays short.
    count = np.diff(np.append(low, len(least)))
    if count.max() > 200:
        parts = -(-count // 200)
        first = np.repeat(low, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * 200
        count = np.diff(np.append(first, len(least)))
        low = first
    string = mixed(spans(prefix, low, low + count - 1 + LENGTH) + count.astype(np.uint64))
    return mixed(least[low]), string, low, count


# ---- packed runs of a block, by group -----------------------------------------------------------

RUN = np.dtype([("anchor", "<u4"), ("string", "<u4"), ("more", "<u4"), ("low", "<u2"), ("count", "u1")])
UNIT = np.dtype([("row", "<i8"), ("doc", "<i8"), ("base", "<u4"), ("runs", "<u4")])
FLAG = np.dtype([("row", "<i8"), ("low", "<i8"), ("count", "<i8")])


def pack_block(rows: np.ndarray, docs: np.ndarray, found: list, groups: int) -> tuple[dict[int, bytes], np.ndarray]:
    """Runs of a block by group, equal ones of later documents left out, and those as flags (row, low, count): they are covered."""
    sizes = [len(f[0]) for f in found]
    unit = np.repeat(np.arange(len(rows)), sizes)
    anchor, string, low, count = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
    group = (anchor % np.uint64(groups)).astype(np.int64)
    short = (anchor >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((docs[unit], string, anchor))
    a, s, d = anchor[order], string[order], docs[unit[order]]
    new = np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])) if len(a) else np.zeros(0, bool)
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else d
    covered = np.zeros(len(unit), bool)
    covered[order] = d > least
    gone = np.flatnonzero(covered)
    gone = gone[np.lexsort((low[gone], unit[gone]))]
    first, lows, counts = united(unit[gone], low[gone], count[gone])
    flags = np.zeros(len(first), FLAG)
    flags["row"], flags["low"], flags["count"] = rows[unit[gone[first]]], lows, counts
    kept = np.flatnonzero(~covered)
    kept = kept[np.lexsort((low[kept], unit[kept], group[kept]))]
    packed = {}
    cuts = np.flatnonzero(np.append(True, group[kept][1:] != group[kept][:-1])) if len(kept) else []
    for begin, end in pairwise([*cuts, len(kept)]):
        at = kept[begin:end]
        runs = np.zeros(len(at), RUN)
        runs["anchor"], runs["string"], runs["more"] = short[at], string[at] & np.uint64(0xFFFFFFFF), string[at] >> np.uint64(32)
        base = low[at] & ~0xFFFF
        runs["low"], runs["count"] = low[at] - base, count[at]
        first = np.flatnonzero(np.append(True, (unit[at][1:] != unit[at][:-1]) | (base[1:] != base[:-1])))
        units = np.zeros(len(first), UNIT)
        units["row"], units["doc"], units["base"] = rows[unit[at[first]]], docs[unit[at[first]]], base[first]
        units["runs"] = np.diff(np.append(first, len(at)))
        units["doc"] = np.diff(units["doc"], prepend=0)
        packed[int(group[at[0]])] = len(units).to_bytes(4, "little") + planes(units) + planes(runs)
    return packed, flags


def united(unit: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [low, low + count), sorted by unit and low, with those of one unit that touch made one: (place of its first, low, count)."""
    if not len(low):
        return np.zeros(0, np.int64), low, count
    # Units are set apart by more than any end, so one running maximum serves all.
    apart = np.append(0, np.cumsum(unit[1:] != unit[:-1])) * (int((low + count).max()) + 1)
    ends = np.maximum.accumulate(low + count + apart)
    first = np.flatnonzero(np.append(True, (low + apart)[1:] > ends[:-1]))
    return first, low[first], ends[np.append(first[1:], len(low)) - 1] - (low + apart)[first]


def planes(table: np.ndarray) -> bytes:
    """The fields of a table one after the other, each by its first bytes, its second bytes and so on: bytes that are mostly zero compress away."""
    return b"".join(np.ascontiguousarray(table[c]).view(np.uint8).reshape(len(table), -1).T.tobytes() for c in table.dtype.names)


def from_planes(blob: pa.Buffer, kind: np.dtype, n: int, at: int) -> np.ndarray:
    table = np.empty(n, kind)
    for c in kind.names:
        size = kind[c].itemsize
        table[c] = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind[c])[:, 0]
        at += n * size
    return table


def unpack(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    units = from_planes(blob, UNIT, n, 4)
    units["doc"] = np.cumsum(units["doc"])
    return units, from_planes(blob, RUN, int(units["runs"].sum()), 4 + n * UNIT.itemsize)


def as_lists(flags: np.ndarray) -> dict[str, list]:
    """Flags sorted by row, as (row, lows, counts)."""
    flags = flags[np.argsort(flags["row"], kind="stable")]
    cuts = np.flatnonzero(np.append(True, flags["row"][1:] != flags["row"][:-1])) if len(flags) else np.zeros(0, np.int64)
    spread = lambda name: pa.ListArray.from_arrays(pa.array(np.append(cuts, len(flags)).astype(np.int32)), pa.array(np.ascontiguousarray(flags[name])))
    return {"row": flags["row"][cuts], "low": spread("low"), "count": spread("count")}


FLAG_TYPES = {"row": pa.int64(), "compare": pa.bool_(), "low": pa.list_(pa.int64()), "count": pa.list_(pa.int64())}
FLAG_SCHEMA = "row long, compare boolean, low array<long>, count array<long>"


def flag_batch(flags: np.ndarray, compare: bool) -> pa.RecordBatch:
    lists = as_lists(flags)
    return batch_of(FLAG_TYPES, {"row": lists["row"], "compare": [compare] * len(lists["row"]), "low": lists["low"], "count": lists["count"]})


def resolve_group(table: pa.Table) -> pa.Table:
    """The flags of one group of anchors: covered runs, and runs whose windows are to be compared. Anchors are judged in ``PARTS`` parts, one after the other."""
    out, units, runs = [], [], []
    for scalar, passed in zip(table["blob"], table["passed"].to_pylist(), strict=True):
        blob = scalar.as_buffer()
        if passed:
            out.append(flag_batch(np.frombuffer(blob, FLAG), False))
        else:
            for found, one in zip((units, runs), unpack(blob), strict=True):
                found.append(one)
    if units:
        units, runs = np.concatenate(units), np.concatenate(runs)
        unit = np.repeat(np.arange(len(units), dtype=np.int32), units["runs"])
        for part in range(PARTS):
            own = np.flatnonzero(runs["anchor"] % PARTS == part)
            for chosen, kind in zip(judge(runs[own], units["doc"][unit[own]]), (False, True), strict=True):
                at = own[chosen]
                flags = np.zeros(len(at), FLAG)
                flags["row"], flags["count"] = units["row"][unit[at]], runs["count"][at]
                flags["low"] = units["base"][unit[at]].astype(np.int64) + runs["low"][at]
                out.append(flag_batch(flags, kind))
    return pa.Table.from_batches(out, pa.schema(list(FLAG_TYPES.items())))


def judge(runs: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs that are covered, and of those whose windows are to be compared; all runs of an anchor must be there."""
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = runs["anchor"]
    whole = runs["string"].astype(np.uint64) | runs["more"].astype(np.uint64) << np.uint64(32)
    order = np.lexsort((doc, whole, key))
    k, w, d = key[order], whole[order], doc[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, w[1:] != w[:-1])
    starts = np.flatnonzero(new)
    covered = d > d[starts][np.cumsum(new) - 1]
    key_starts, key_of = np.flatnonzero(new_key), np.cumsum(new_key) - 1
    strings = np.bincount(key_of[starts], minlength=len(key_starts))
    shared = (strings > 1) & (np.minimum.reduceat(d, key_starts) < np.maximum.reduceat(d, key_starts))
    return order[covered], order[~covered & shared[key_of]]


# ---- suffix sort of the windows to compare --------------------------------------------------------


class SuffixSorter:
    """Sorts windows of a text by merging; suffixes are compared by their longest common extension."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.prefix = raw, prefix_hashes(raw)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of windows a and b, at most LENGTH, by binary search over prefix hashes."""
        common = np.full(len(a), LENGTH)
        unequal = np.flatnonzero(spans(self.prefix, a, a + LENGTH) != spans(self.prefix, b, b + LENGTH))
        a, b = a[unequal], b[unequal]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH - 1)
        for _ in range((LENGTH - 1).bit_length()):
            half = (low + high + 1) // 2
            same = spans(self.prefix, a, a + half) == spans(self.prefix, b, b + half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        common[unequal] = low
        return common

    def precedes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether window a is less than window b."""
        common = self.extension(a, b)
        inside = common < LENGTH
        at = np.where(inside, common, 0)
        return inside & (self.raw[a + at] < self.raw[b + at])

    def sort(self, windows: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of the windows within their segments (ascending numbers): merges of blocks of 1, 2, 4, ...; each window finds its place in the other block by binary search."""
        order = np.arange(len(windows))
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(segment)))
        start, stop, size = np.repeat(first, sizes), np.repeat(first + sizes, sizes), np.repeat(sizes, sizes)
        inside = np.arange(len(segment)) - start
        block = 1
        while block < sizes.max(initial=1):
            live = np.flatnonzero(size > block)  # of segments that are not yet sorted
            side = inside[live] // block % 2
            mine = start[live] + inside[live] // block * block
            other = np.where(side == 0, np.minimum(mine + block, stop[live]), mine - block)
            end = np.where(side == 0, np.minimum(other + block, stop[live]), mine)
            low, high = other.copy(), end.copy()
            active = np.flatnonzero(low < high)
            while len(active):
                half = (low[active] + high[active]) // 2
                own, there = windows[order[live[active]]], windows[order[half]]
                # On equality the left block comes first.
                left = side[active] == 0
                before = self.precedes(np.where(left, there, own), np.where(left, own, there))
                after = before == left
                low[active], high[active] = np.where(after, half + 1, low[active]), np.where(after, high[active], half)
                active = active[low[active] < high[active]]
            place = np.where(side == 0, live, live - block) + (low - other)
            moved = order.copy()
            moved[place] = order[live]
            order = moved
            block *= 2
        return order

    def classes(self, windows: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """A number for each window, equal for equal windows; equality of neighbours in suffix order is verified on the bytes."""
        order = self.sort(windows, segment)
        a, b = windows[order[:-1]], windows[order[1:]]
        same = (segment[order[:-1]] == segment[order[1:]]) & (self.extension(a, b) == LENGTH)
        at = np.flatnonzero(same)
        for begin in range(0, len(at), 1 << 16):
            part = at[begin : begin + (1 << 16)]
            reach = np.arange(LENGTH)
            same[part] = (self.raw[a[part][:, None] + reach] == self.raw[b[part][:, None] + reach]).all(axis=1)
        number = np.empty(len(windows), np.int64)
        number[order] = np.cumsum(np.append(True, ~same))[: len(order)] if len(order) else []
        return number


def window_names(raw: np.ndarray, windows: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Two independent 64-bit hashes of the bytes of each window, taken word by word."""
    out = np.zeros((len(windows), 2), np.uint64)
    for begin in range(0, len(windows), chunk):
        part = windows[begin : begin + chunk]
        words = np.zeros((len(part), -(-LENGTH // 8) * 8), np.uint8)
        words[:, :LENGTH] = raw[part[:, None] + np.arange(LENGTH)]
        for word in words.view(np.uint64).T:
            for lane, odd in enumerate((BASE, INVERSE)):
                out[begin : begin + chunk, lane] = mixed((out[begin : begin + chunk, lane] ^ word) * np.uint64(odd) + np.uint64(lane + 1))
    return out


def in_blocks(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose windows to compare, and their bytes, are about BLOCK_BYTES, so that a suffix sort has bounded memory."""
    counts = table.column("count")
    ends = np.append(0, np.cumsum(counts.values.to_numpy() + (LENGTH - 1)))
    offsets = counts.offsets.to_numpy()
    block = np.cumsum(2 * (ends[offsets[1:]] - ends[offsets[:-1]])) // BLOCK_BYTES
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    for begin, end in pairwise([*cuts.tolist(), table.num_rows]):
        yield table.slice(begin, end - begin)


def window_runs(table: pa.RecordBatch, passes: int = 1, own: int = 0) -> tuple[np.ndarray, np.ndarray, list]:
    """A block's windows to compare, as runs of one window for :func:`pack_block`: the (row, doc) units and their runs.

    Windows are sorted as suffixes; one class is one string. Its name is a hash of its 50 bytes, taken once a class. Of several passes
    each takes the windows whose hash falls to it, so equal ones always meet.
    """
    rows, docs = (table.column(c).to_numpy() for c in ("row", "doc"))
    texts, ranges, base = [], [], 0
    for unit, (packed, lows, counts) in enumerate(zip(*(table.column(c) for c in ("packed", "low", "count")), strict=True)):
        low, count = (np.asarray(c.values) for c in (lows, counts))
        order = np.argsort(low, kind="stable")
        _, low, count = united(np.zeros(len(low), np.int64), low[order], count[order])
        sizes = count + (LENGTH - 1)
        texts.append(np.frombuffer(zstandard.decompress(packed.as_py()), np.uint8)[gather_runs(low, sizes)])
        ranges.append((base + np.cumsum(sizes) - sizes, count, low, np.full(len(low), unit)))
        base += len(texts[-1])
    raw = np.concatenate(texts)
    begin, count, low, unit = (np.concatenate(c) for c in zip(*ranges, strict=True))
    windows, place, unit = gather_runs(begin, count), gather_runs(low, count), np.repeat(unit, count)
    sorter = SuffixSorter(raw)
    if passes > 1:
        mine = np.flatnonzero(mixed(spans(sorter.prefix, windows, windows + LENGTH)) % np.uint64(passes) == np.uint64(own))
        windows, place, unit = windows[mine], place[mine], unit[mine]
    # Windows are dealt to segments by the hash of their first bytes, so merges stay short.
    head = spans(sorter.prefix, windows, windows + 16)
    order = np.argsort(head, kind="stable")
    segment = np.cumsum(np.append(True, head[order][1:] != head[order][:-1]))[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = sorter.classes(windows[order], segment)
    classes, first, number = np.unique(number, return_index=True, return_inverse=True)
    names = window_names(raw, windows[first])[number]
    cuts = np.searchsorted(unit, np.arange(len(rows) + 1))
    ones = np.ones(len(windows), np.int64)
    return rows, docs, [(names[i:j, 0], names[i:j, 1], place[i:j], ones[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


# ---- the whole ----------------------------------------------------------------------------------


def packed_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, packed): a hash that names the row's id and text, and the compressed text."""
    types = {"row": pa.int64(), "doc_id": pa.int64(), "packed": pa.binary()}

    def make():
        packer = zstandard.ZstdCompressor(1)
        return lambda batch: batch_of(types, {"row": batch.column(0), "doc_id": batch.column(1), "packed": [packer.compress(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]})

    return map_batches(named(docs), make, "row long, doc_id long, packed binary")


def named(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), body()).alias("row"), F.col("doc_id").cast("long"), body().alias("text"))


def covered_starts(docs: DataFrame) -> DataFrame:
    """(row, low, count) lists of windows that an earlier document has: ``count`` windows from ``low`` on."""
    volume = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = int(max(1, -(-volume // GROUP_BYTES)))

    def runs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
        ids = np.array([LEAST_ID if i is None else i for i in part.column(1).to_pylist()], np.int64)
        return part.column(0).to_numpy(), ids, [runs_of(np.frombuffer(t, np.uint8)) for t in part.column(2).cast(pa.binary()).to_pylist()]

    # Shuffled files of a step go at its end, so that no two steps' files are on disk together.
    flags = written(resolved(named(docs), runs, groups, partial(slices, most=BLOCK_BYTES)), "run-flags", free=True)
    wanted = flags.where("compare").groupBy("row").agg(F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("count")).alias("count"))
    texts = packed_texts(docs).withColumn("doc", F.coalesce("doc_id", F.lit(LEAST_ID)))
    block = texts.hint("merge").join(wanted, "row").select("row", "doc", "packed", "low", "count")
    windows = flags.where("compare").agg(F.sum(F.aggregate("count", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).first()["n"] or 0
    passes = max(1, -(-windows * WINDOW_BYTES // max(1, volume)))
    if passes > 1:
        block = written(block, "run-texts", free=True)
    every = flags
    for own in range(passes):
        found = resolved(block, partial(window_runs, passes=passes, own=own), groups, lambda batch: (b for part in slices(batch) for b in in_blocks(part)))
        every = every.union(written(found, "window-flags", free=True).where("not compare"))
    if passes > 1:
        dropped(block)
    return every.where("not compare").select("row", "low", "count")


def resolved(table: DataFrame, runs, groups: int, parts) -> DataFrame:
    """The flags of all runs that ``runs`` finds in the table's blocks, which ``parts`` makes of a batch: they are dealt by anchor, group by group."""
    def blocks(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for part in parts(batch):
                packed, flags = pack_block(*runs(part), groups)
                names, blobs = list(packed), list(packed.values())
                spread = np.array_split(flags, -(-len(flags) // 200_000)) if len(flags) else []
                names += [int(f["low"][0] + len(flags)) % groups for f in spread]  # passed on by any group
                yield batch_of({"group": pa.int32(), "passed": pa.bool_(), "blob": pa.binary()}, {"group": names, "passed": [False] * len(blobs) + [True] * len(spread), "blob": blobs + [f.tobytes() for f in spread]})

    return table.mapInArrow(blocks, "group int, passed boolean, blob binary").groupBy("group").applyInArrow(resolve_group, FLAG_SCHEMA)


def spans_to_remove(n: int, lows: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Maximal spans [start, end) of bytes that the given windows cover."""
    out: list[tuple[int, int]] = []
    for low, count in sorted(zip(lows, counts, strict=True)):
        end = min(n, low + count - 1 + LENGTH)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((low, end))
    return out


def with_spans(docs: DataFrame, work, types: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Maps ``work(doc_id, raw, spans)`` over every row."""
    covered = covered_starts(docs).groupBy("row").agg(F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("count")).alias("count"))
    joined = packed_texts(docs).hint("merge").join(covered, "row", "left").select("doc_id", "packed", "low", "count")

    def make():
        def each(batch):
            out: dict[str, list] = {k: [] for k in types}
            for doc_id, packed, low, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = zstandard.decompress(packed)
                for k, v in zip(types, work(doc_id, raw, spans_to_remove(len(raw), low or [], count or [])), strict=True):
                    out[k].append(v)
            return batch_of(types, out)

        return each

    return map_batches(joined, make, schema)


def rest_of(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in removed:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every byte removed that a LENGTH-byte string covers which also starts in a document of smaller doc_id.

    Overlaps count; strings are judged on the input and never cross documents. Null texts count as empty; a null doc_id is less than
    any other; rows with one doc_id never remove each other's strings; an empty table gives an empty result; further columns are
    ignored. Bytes of characters that are cut in two become replacement characters here.
    """
    types = {"doc_id": pa.int64(), "text": pa.string()}
    return with_spans(docs, lambda doc_id, raw, removed: (doc_id, rest_of(raw, removed).decode("utf-8", "replace")), types, "doc_id long, text string")


def repeat_report(docs: DataFrame) -> DataFrame:
    """What :func:`without_repeats` removes: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    def work(doc_id, raw, removed):
        return doc_id, len(raw), sum(b - a for a, b in removed), len(removed), hashlib.sha256(rest_of(raw, removed)).hexdigest()

    return with_spans(docs, work, types, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
