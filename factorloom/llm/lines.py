"""Line dedup by an exact set-similarity join.

A line's set is its distinct words. Words are ordered by rarity (those outside a bounded table of frequent words first), and two sets
of enough similarity share a word among their first few. So each set is dealt out by the words of that prefix; length,
positional and bitmap filters thin the pairs that meet, and the rest are verified on the full sets. Lines with equal sets are one class throughout,
named by a 64-bit hash of the set.

Texts are split into words once: each block of texts is written as its distinct sets, numbers into the block's vocabulary, which the passes that follow read.
A set that may be similar to many earlier ones by one word first meets the likeliest few of them, and the sets of a word of very many rows meet the earliest
few, which settles most lines of very many near copies. Those still open then meet all the others, block by block of the word's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, dropped, map_batches, slices, written
from .lexicon import gather_runs
from .neardup import confirmed, mixed
from .substrings import LEAST_ID, named, packed_texts, prefix_hashes, spans

PERCENT = 80
#: Frequent words that are ranked. Any order of words keeps the join exact.
RANKED = 1 << 16
#: Bytes of text whose prefixes one group of the join holds.
GROUP_BYTES = 16 << 20
#: Earlier sets that may be similar, by one word, beyond which a set meets the PIVOTS likeliest first; and rows of a word beyond which all meet the earliest PIVOTS first, and
#: of a block of such a word.
COMMON, PIVOTS, BLOCK = 16, 3, 4096
#: Sets whose names and bitmaps are broadcast to thin the pairs and to find their words in the blocks of sets (44 MB); of more, all sets are joined by name instead.
BROADCAST = 1 << 20
#: Places of the larger bitmap that pairs are compared by before their sets are.
SIGN = 256
#: A row of a prefix: the word, the line's set and its size, the word's place among its words, a bit for each of its words in two bitmaps, and
#: the document and place where its block has it first.
PREFIX = np.dtype([("word", "<u4"), ("line", "<i8"), ("size", "<u4"), ("place", "<u4"), ("bits", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("at", "<u4")])


def words_of(line: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case."""
    return line.lower().split()


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of all words at once, from the prefix hashes of their bytes."""
    long = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()) if words.offset or not len(words) else words.buffers()[2], np.uint8, int(long.sum()))
    ends = np.cumsum(long)
    return mixed(spans(prefix_hashes(raw), ends - long, ends) + long.astype(np.uint64))


def word_ranks(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words, ascending, and their ranks from 1 on, rarer first, from counts (h, n)."""
    top = counts.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(RANKED).toArrow()
    hashes = np.array(top["h"].to_numpy()).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


class LineSets:
    """The lines of a block of texts: each distinct line once, as its distinct words' numbers in the block's vocabulary."""

    def __init__(self, texts: pa.Array):
        lines = pc.split_pattern(texts.cast(pa.string()), "\n")
        #: How many lines each text has, and which distinct line each is.
        self.lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        coded = lines.flatten().dictionary_encode()
        self.of_line = coded.indices.to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pc.ascii_lower(coded.dictionary))
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        kinds = words.flatten().dictionary_encode()
        #: Hashes of the vocabulary, and which of its words is empty: it stands beside white space at a line's end.
        self.hashes, empty = word_hashes(kinds.dictionary), pc.equal(kinds.dictionary, "").to_numpy(zero_copy_only=False)
        codes, owner = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        if empty.any():
            real = ~empty[codes]
            codes, owner = codes[real], owner[real]
        times = np.bincount(self.of_line, minlength=len(sizes))
        #: How often each word comes in the block's texts.
        self.often = np.bincount(codes, times[owner], len(self.hashes)).astype(np.int64)
        both = np.sort(owner << 32 | codes)
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        self.codes, self.size = both & 0xFFFFFFFF, np.bincount(both >> 32, minlength=len(sizes))
        self.start = np.cumsum(self.size) - self.size
        total = np.append(np.zeros(1, np.uint64), np.cumsum(mixed(self.hashes)[self.codes], dtype=np.uint64))
        #: A number for each distinct line's set, 0 for an empty one.
        self.id = np.where(self.size > 0, mixed(total[self.start + self.size] - total[self.start] + self.size.astype(np.uint64)) | np.uint64(1), np.uint64(0)).view(np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words that come more than once in the block's texts, and how often."""
        several = np.flatnonzero(self.often > 1)
        return self.hashes[several].view(np.int64), self.often[several]

    def sets(self, docs: np.ndarray) -> Sets:
        """Each set of the block that has words, once, with the first place of it: the texts' numbers are ``docs``."""
        doc_of, line_of = np.repeat(docs, self.lines), gather_runs(np.zeros(len(self.lines), np.int64), self.lines)
        by_place = np.lexsort((line_of, doc_of))
        ids, first = np.unique(self.id[self.of_line[by_place]], return_index=True)
        first = by_place[first][ids != 0]
        own = self.of_line[first]
        size = self.size[own]
        return Sets(self.id[own], size, doc_of[first], line_of[first], self.hashes, self.codes[gather_runs(self.start[own], size)])


class Sets:
    """Sets of words, each once: name, size, first place (doc, at), and words as numbers (codes, set by set) into a vocabulary of hashes."""

    TYPES = {"id": "<i8", "size": "<u4", "doc": "<i8", "at": "<u4", "hashes": "<u8", "codes": "<u4"}

    def __init__(self, ids, size, doc, at, hashes, codes):
        self.id, self.size, self.doc, self.at, self.hashes, self.codes = ids, size.astype(np.int64), doc, at, hashes, codes.astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def packed(self) -> bytes:
        """All columns, byte by byte of their numbers, compressed."""
        columns = [getattr(self, name).astype(kind) for name, kind in self.TYPES.items()]
        head = np.array([len(self.id), len(self.hashes), len(self.codes)], "<u8").tobytes()
        return head + zstandard.compress(b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns), 1)

    @classmethod
    def unpacked(cls, blob: bytes) -> Sets:
        sets, words, codes = np.frombuffer(blob, "<u8", 3).tolist()
        raw, at, columns = zstandard.decompress(blob[24:]), 0, []
        for name, kind in cls.TYPES.items():
            n, width = {"hashes": words, "codes": codes}.get(name, sets), np.dtype(kind).itemsize
            columns.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).ravel())
            at += n * width
        return cls(*columns)

    def chosen(self, own: np.ndarray) -> Sets:
        return Sets(self.id[own], self.size[own], self.doc[own], self.at[own], self.hashes, self.codes[gather_runs(self.start[own], self.size[own])])

    def among(self, names: np.ndarray) -> Sets:
        """The sets whose names are among these, which are in order."""
        at = np.minimum(np.searchsorted(names, self.id), max(len(names) - 1, 0))
        return self.chosen(np.flatnonzero(names[at] == self.id) if len(names) else np.zeros(0, np.int64))

    def bitmaps(self, numbers: int, shift: int) -> np.ndarray:
        """64 places a number for each set: whether an odd number of its words falls on a place. Two sets differ in at least as many words as their bitmaps do in bits."""
        place, out = (self.hashes >> np.uint64(shift)) % np.uint64(64 * numbers), np.zeros((len(self.id), numbers), np.uint64)
        for k in range(numbers if len(self.id) else 0):
            bit = np.where(place // np.uint64(64) == k, np.uint64(1) << place % np.uint64(64), np.uint64(0))
            out[:, k] = np.bitwise_xor.reduceat(bit[self.codes], self.start)
        return out

    def prefixes(self, ranks: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix rows of each set, and the full hashes of their words, in order of rarity."""
        known, rank = ranks
        at = np.minimum(np.searchsorted(known, self.hashes), max(len(known) - 1, 0))
        rarity = np.where(known[at] == self.hashes, rank[at], 0) if len(known) else np.zeros(len(self.hashes), np.int64)
        order = np.lexsort((self.hashes, rarity))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        both = np.sort(np.repeat(np.arange(len(self.id)) << 32, self.size) | place[self.codes])
        long = prefix_sizes(self.size, percent)
        words = self.hashes[order[both[gather_runs(self.start, long)] & 0xFFFFFFFF]]
        rows = np.zeros(len(words), PREFIX)
        rows["word"], rows["place"] = (words >> np.uint64(32)).astype(np.uint32), gather_runs(np.zeros(len(long), np.int64), long)
        bits = self.bitmaps(2, 7)
        for name, values in (("line", self.id), ("size", self.size), ("bits", bits[:, 0]), ("more", bits[:, 1]), ("doc", self.doc), ("at", self.at)):
            rows[name] = np.repeat(values, long)
        return rows, words


def prefix_sizes(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of a set's rarest words any set of enough similarity shares one of."""
    return np.where(size > 0, size - -(-size * percent // 100) + 1, 0)


def packed_rows(rows: np.ndarray) -> bytes:
    """Prefix rows column by column, compressed."""
    return zstandard.compress(b"".join(rows[c].tobytes() for c in PREFIX.names), 1)


def rows_of(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    rows, at = np.zeros(len(raw) // PREFIX.itemsize, PREFIX), 0
    for name in PREFIX.names:
        rows[name] = np.frombuffer(raw, PREFIX[name], len(rows), at)
        at += len(rows) * PREFIX[name].itemsize
    return rows


#: The columns that pairs are compared by.
COMPARED = tuple(c for c in PREFIX.names if c != "word")


def may_be_similar(a, b, percent: int) -> np.ndarray:
    """Whether rows with a word in common pass the length, positional and bitmap filters and b's set comes first in some block before a's."""
    size_a, size_b, place_a, place_b = (x[c].astype(np.int64) for c in ("size", "place") for x in (a, b))
    least = -(-(size_a + size_b) * percent // (100 + percent))
    # The shared word may be any of the common ones: at most those before it in both and those after it.
    most = np.minimum(place_a, place_b) + np.minimum(size_a - place_a, size_b - place_b)
    fit = (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (most >= least) & (apart(a, b) <= size_a + size_b - 2 * least)
    return fit & (a["line"] != b["line"]) & ((b["doc"] < a["doc"]) | (b["doc"] == a["doc"]) & (b["at"] < a["at"]))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the bitmaps of rows differ. Two sets differ in at least as many words."""
    return np.bitwise_count(a["bits"] ^ b["bits"]).astype(np.int64) + np.bitwise_count(a["more"] ^ b["more"])


def meetings(a: np.ndarray, b: np.ndarray, percent: int, chunk: int = 1 << 18):
    """(later, earlier) rows: of each row of a all rows of b, sorted by word and size, that have its word and may be similar; in chunks, a row of a in one of them."""
    key = b["word"].astype(np.int64) << 31 | b["size"]
    word, size = a["word"].astype(np.int64) << 31, a["size"].astype(np.int64)
    low = np.searchsorted(key, word | -(-size * percent // 100))
    long = np.searchsorted(key, word | np.minimum(size * 100 // percent, (1 << 31) - 1), "right") - low
    total, begin = np.cumsum(long), 0
    own_a, own_b = ({c: np.ascontiguousarray(x[c]) for c in COMPARED} for x in (a, b))
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + chunk, "right")))
        one, two = np.repeat(np.arange(begin, end), long[begin:end]), gather_runs(low[begin:end], long[begin:end])
        before = own_b["doc"][two] <= own_a["doc"][one]
        one, two = one[before], two[before]
        good = may_be_similar({c: own_a[c][one] for c in COMPARED}, {c: own_b[c][two] for c in COMPARED}, percent)
        yield one[good], two[good]
        begin = end


def likeliest(rows: np.ndarray, later: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier) rows without those of a later row of more than COMMON, but for its PIVOTS likeliest; and such later rows."""
    first = np.flatnonzero(np.append(True, later[1:] != later[:-1])[: len(later)])
    many = np.diff(np.append(first, len(later)))
    crowded = np.repeat(many > COMMON, many)
    order = np.lexsort((apart(rows[later], rows[earlier]), later))  # later rows are in order already
    keep = np.sort(order[~crowded | (gather_runs(np.zeros(len(many), np.int64), many) < PIVOTS)])
    return later[keep], earlier[keep], later[first[many > COMMON]]


def distinct_pairs(found: Iterable[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)


FOUND = {"later": pa.int64(), "earlier": pa.int64(), "word": pa.int64(), "block": pa.int32(), "blob": pa.binary(), "open": pa.list_(pa.int64())}
FOUND_SCHEMA = "later long, earlier long, word long, block int, blob binary, open array<long>"


def rows_of_shared_words(blobs: pa.ChunkedArray) -> np.ndarray:
    """The prefix rows of words that have several; the other words, which are most, bring nothing together."""
    parts = [rows_of(b.as_buffer()) for b in blobs]
    words = np.sort(np.concatenate([np.zeros(0, np.uint32), *(part["word"] for part in parts)]))
    shared = np.unique(words[1:][words[1:] == words[:-1]])
    for i, part in enumerate(parts):
        at = np.minimum(np.searchsorted(shared, part["word"]), max(len(shared) - 1, 0))
        parts[i] = part[shared[at] == part["word"]] if len(shared) else part[:0]
    return np.concatenate([np.zeros(0, PREFIX), *parts])


def candidates(table: pa.Table, percent: int) -> pa.Table:
    """Of one group of words: pairs (later, earlier) of sets; and where a set has met only some of the earlier ones of a word, that word's rows in blocks, each with its open sets."""
    rows = rows_of_shared_words(table["blob"])
    rows = rows[np.lexsort((rows["line"], rows["word"].astype(np.int64) << 31 | rows["size"]))]
    if len(rows):  # a set once a word, with its first place
        new = np.append(True, (rows["line"][1:] != rows["line"][:-1]) | (rows["word"][1:] != rows["word"][:-1]))
        several = np.flatnonzero(~new | np.append(~new[1:], False))
        rows[several] = rows[several[np.lexsort((rows["at"][several], rows["doc"][several], np.cumsum(new)[several]))]]
        rows = rows[new]
    first = np.flatnonzero(np.append(True, rows["word"][1:] != rows["word"][:-1])) if len(rows) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(rows)))
    hot = np.repeat(many > BLOCK, many)
    found, few, crowded = [], np.flatnonzero(~hot), np.zeros(len(rows), bool)
    own = rows[few]
    for later, earlier in meetings(own, own, percent):
        later, earlier, more = likeliest(own, later, earlier)
        crowded[few[more]] = True
        found.append(np.stack([own["line"][later], own["line"][earlier]], axis=1))
    group, blocks = table["group"][0].as_py(), []
    busy = (many > BLOCK) | np.logical_or.reduceat(crowded, first) if len(rows) else np.zeros(0, bool)
    for begin, n in zip(first[busy].tolist(), many[busy].tolist(), strict=True):
        if n > BLOCK:
            own = rows[begin : begin + n]
            for pivot in np.lexsort((own["at"], own["doc"]))[:PIVOTS]:
                good = may_be_similar(own, np.broadcast_to(own[pivot], n), percent)
                found.append(np.stack([own["line"][good], np.full(int(good.sum()), own["line"][pivot])], axis=1))
            crowded[begin : begin + n] = True
        if crowded[begin : begin + n].any():
            for k in range(begin, begin + n, BLOCK):
                part = slice(k, min(k + BLOCK, begin + n))
                blocks.append((group << 32 | int(rows["word"][k]), (k - begin) // BLOCK, packed_rows(rows[part]), rows["line"][part][crowded[part]]))
    pairs = distinct_pairs(found)
    columns = [*(np.array(pairs[:, i]) for i in range(2)), *([b[i] for b in blocks] for i in range(4))]
    return pa.table({
        name: pa.concat_arrays([pa.array(values, kind), pa.nulls(len(blocks), kind)] if i < 2 else [pa.nulls(len(pairs), kind), pa.array(values, kind)])
        for i, ((name, kind), values) in enumerate(zip(FOUND.items(), columns, strict=True))})


def open_candidates(blocks: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """(later, earlier), once, of all pairs of a common word whose later set is open and not settled: each block with such sets meets each block of its word."""
    still = blocks.select("word", "block", F.explode("open").alias("line")).hint("merge").join(settled, F.col("line") == F.col("later"), "left_anti")
    waiting = written(still.groupBy("word", "block").agg(F.collect_list("line").alias("open")), "line-open")
    mine = waiting.hint("merge").join(blocks.select("word", "block", "blob"), ["word", "block"]).select("word", "open", F.col("blob").alias("own"))
    types = {"later": pa.int64(), "earlier": pa.int64()}

    def work(batch):
        found = []
        for lines, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = rows_of(one), rows_of(two)
            a = a[np.isin(a["line"], lines)]
            found += [np.stack([a["line"][later], b["line"][earlier]], axis=1) for later, earlier in meetings(a, b, percent)]
        pairs = distinct_pairs(found)
        return batch_of(types, {"later": pairs[:, 0].copy(), "earlier": pairs[:, 1].copy()})

    both = mine.hint("merge").join(blocks.select("word", "blob"), "word").select("open", "own", "blob")
    return map_batches(both, lambda: work, "later long, earlier long").distinct()


def late_sets(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(row, doc, lines): each text's sets in order; and (later), once, of all sets to which a similar one comes first."""
    types = {"row": pa.int64(), "doc": pa.int64(), "lines": pa.list_(pa.int64()), "sets": pa.binary(), "volume": pa.int64(), "h": pa.int64(), "n": pa.int64()}

    def sets_of(batch):
        """Three kinds of rows: a text's lines, a block's sets, a word's count."""
        block, docs = LineSets(batch.column(2)), pc.fill_null(batch.column(1), LEAST_ID)
        ends, (h, n) = np.append(0, np.cumsum(block.lines)).astype(np.int32), block.counts()
        kinds = [
            {"row": batch.column(0), "doc": docs, "lines": pa.ListArray.from_arrays(pa.array(ends), pa.array(block.id[block.of_line]))},
            {"sets": pa.array([block.sets(docs.to_numpy(zero_copy_only=False)).packed()]), "volume": pa.array([batch.column(2).nbytes])}, {"h": pa.array(h), "n": pa.array(n)}]
        many = [batch.num_rows, 1, len(h)]
        return batch_of(types, {c: pa.concat_arrays([own[c].cast(t) if c in own else pa.nulls(k, t) for own, k in zip(kinds, many, strict=True)]) for c, t in types.items()})

    mapped = written(map_batches(named(docs), lambda: sets_of, "row long, doc long, lines array<long>, sets binary, volume long, h long, n long", 8 << 20), "line-sets")
    lines, blocks = mapped.where("row is not null").select("row", "doc", "lines"), mapped.where("sets is not null").select("sets")
    ranks = word_ranks(mapped.where("h is not null").select("h", "n"))
    groups = int(max(1, -(-(mapped.agg(F.sum("volume").alias("n")).first()["n"] or 0) // GROUP_BYTES)))

    def prefixes_of(batch):
        group_of, blobs = [], []
        for blob in batch.column(0).to_pylist():
            rows, words = Sets.unpacked(blob).prefixes(ranks, percent)
            group = (words % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            cuts = [*np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist(), len(rows)] if len(rows) else [0]
            group_of += group[cuts[:-1]].tolist()
            blobs += [packed_rows(rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return batch_of({"group": pa.int32(), "blob": pa.binary()}, {"group": group_of, "blob": blobs})

    dealt = map_batches(blocks, lambda: prefixes_of, "group int, blob binary").groupBy("group")
    found = written(dealt.applyInArrow(lambda t: candidates(t, percent), FOUND_SCHEMA), "line-candidates")
    pairs, common = found.where("later is not null").select("later", "earlier"), found.where("blob is not null").select("word", "block", "blob", "open")
    settled = written(confirmed_late(blocks, pairs, percent), "line-settled")
    rest = written(open_candidates(common, settled, percent), "line-rest")
    late = written(settled.union(confirmed_late(blocks, rest, percent)).distinct(), "line-late")
    dropped(found, settled, rest)
    return lines, late


def confirmed_late(blocks: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(later), once, of the written pairs (later, earlier) that their full sets, from the blocks of sets, confirm.

    Where the sets asked for are few enough, their bitmaps are broadcast. Each later set is verified against its likeliest earlier one first, and
    against the others only if that is not similar: the copies of a line need one verification each.
    """
    wanted = written(asked(pairs), "line-wanted")
    if wanted.count() > BROADCAST:
        pairs = pairs.distinct().withColumn("apart", F.lit(0))
    else:
        pairs = thinned(pairs.distinct(), bitmaps_of_sets(blocks, names_of(wanted)), percent)
    pairs = written(pairs, "line-pairs")
    best = written(pairs.groupBy("later").agg(F.min_by("earlier", F.struct("apart", "earlier")).alias("earlier")), "line-best")
    settled = written(verified(blocks, best, percent), "line-verified")
    rest = pairs.select("later", "earlier").hint("merge").join(best.select(F.col("later").alias("l"), F.col("earlier").alias("e")), (F.col("later") == F.col("l")) & (F.col("earlier") == F.col("e")), "left_anti")
    rest = written(rest.hint("merge").join(settled, "later", "left_anti"), "line-others")
    return settled.union(verified(blocks, rest, percent))


def asked(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("later").alias("node")).union(pairs.select("earlier")).distinct()


def names_of(wanted: DataFrame) -> np.ndarray:
    """The names (node), at most BROADCAST of them, in order."""
    return np.sort(wanted.toArrow()["node"].to_numpy())


def verified(blocks: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(later), once, of the written pairs (later, earlier) whose full sets are similar."""
    wanted = written(asked(pairs), "line-asked")
    sets = words_of_sets(blocks).hint("merge").join(wanted, "node", "left_semi") if wanted.count() > BROADCAST else words_of_sets(blocks, names_of(wanted))
    return confirmed(pairs.toDF("a", "b"), sets.dropDuplicates(["node"]), percent).select(F.col("a").alias("later")).distinct()


def thinned(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps differ in no more places than similar sets of their sizes may, and in how many (apart). At most BROADCAST sets have a bitmap (node, size, bits)."""
    table = signs.dropDuplicates(["node"]).orderBy("node").toArrow()
    raw = b"".join(table["bits"].to_pylist())
    known = pairs.sparkSession.sparkContext.broadcast((table["node"].to_numpy(), table["size"].to_numpy(), np.frombuffer(raw, np.uint64).reshape(-1, SIGN // 64)))

    def work(batch):
        node, size, bits = known.value
        a, b = (np.searchsorted(node, batch.column(i).to_numpy(zero_copy_only=False)) for i in range(2))
        least = -(-(size[a] + size[b]) * percent // (100 + percent))
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int32)
        near = pa.array(apart <= size[a] + size[b] - 2 * least)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(apart)], names=["later", "earlier", "apart"]).filter(near)

    return map_batches(pairs.select("later", "earlier"), lambda: work, "later long, earlier long, apart int")


def bitmaps_of_sets(blocks: DataFrame, names: np.ndarray) -> DataFrame:
    """(node, size, bits) of the sets asked for, at most BROADCAST of them, in each block that has them."""
    types, known = {"node": pa.int64(), "size": pa.int64(), "bits": pa.binary()}, blocks.sparkSession.sparkContext.broadcast(names)

    def work(batch):
        found = [Sets.unpacked(blob).among(known.value) for blob in batch.column(0).to_pylist()]
        bits = [row.tobytes() for own in found for row in own.bitmaps(SIGN // 64, 20)]
        return batch_of(types, {"node": np.concatenate([own.id for own in found]), "size": np.concatenate([own.size for own in found]), "bits": bits})

    return map_batches(blocks, lambda: work, "node long, size long, bits binary")


def words_of_sets(blocks: DataFrame, names: np.ndarray | None = None) -> DataFrame:
    """(node, word hashes) of the sets of each block: those asked for, at most BROADCAST of them, or all."""
    known = None if names is None else blocks.sparkSession.sparkContext.broadcast(names)

    def work(batch):
        found = [Sets.unpacked(blob) for blob in batch.column(0).to_pylist()]
        found = found if known is None else [own.among(known.value) for own in found]
        ends = np.append(0, np.cumsum(np.concatenate([own.size for own in found]))).astype(np.int32)
        words = np.concatenate([own.hashes[own.codes] for own in found]).view(np.int64)
        return batch_of({"node": pa.int64(), "shingles": pa.list_(pa.int64())}, {"node": np.concatenate([own.id for own in found]), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(words))})

    return map_batches(blocks, lambda: work, "node long, shingles array<long>")


def late_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(row, gone): numbers of the lines of each text that an earlier line, of the same or a similar set, removes."""
    lines, late = late_sets(docs, percent)
    places = lines.select("row", "doc", F.posexplode("lines").alias("line", "node")).where("node <> 0")
    at = F.struct("doc", "line")
    firsts = places.groupBy("node").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    judged = firsts.hint("merge").join(late.withColumn("late", F.lit(True)), firsts["node"] == late["later"], "left")
    # Only sets that come twice, or late, decide anything.
    judged = written(judged.where("n > 1 or late").select("node", "first", F.coalesce("late", F.lit(False)).alias("late")), "line-classes")
    gone = places.hint("merge").join(judged, "node").where(F.col("late") | (F.col("first") < at))
    return gone.groupBy("row").agg(F.collect_list("line").alias("gone"))


def with_lines(docs: DataFrame, work, types: dict[str, pa.DataType], schema: str, percent: int) -> DataFrame:
    joined = packed_texts(docs).hint("merge").join(late_lines(docs, percent), "row", "left").select("doc_id", "packed", "gone")

    def make():
        def each(batch):
            out: dict[str, list] = {k: [] for k in types}
            for doc_id, packed, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, v in zip(types, work(doc_id, zstandard.decompress(packed), gone or []), strict=True):
                    out[k].append(v)
            return batch_of(types, out)

        return each

    return map_batches(joined, make, schema)


def kept_text(raw: bytes, gone: list[int]) -> bytes:
    drop = set(gone)
    return b"\n".join(line for i, line in enumerate(raw.split(b"\n")) if i not in drop)


def without_late_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) without lines whose word set has at least ``percent`` similarity with that of an earlier line.

    Lines are ordered by doc_id (null first) and place, over all documents, and judged on the input. Lines without words stay. Null
    texts count as empty. Rows with one doc_id: lines at the same place don't precede each other. An empty table gives an empty
    result; further columns are ignored.
    """
    return with_lines(docs, lambda doc_id, raw, gone: (doc_id, kept_text(raw, gone).decode("utf-8", "replace")), {"doc_id": pa.int64(), "text": pa.string()}, "doc_id long, text string", percent)


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What :func:`without_late_lines` does to each document: doc_id, n_lines, n_removed, kept_sha256."""
    types = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}

    def work(doc_id, raw, gone):
        return doc_id, raw.count(b"\n") + 1, len(gone), hashlib.sha256(kept_text(raw, gone)).hexdigest()

    return with_lines(docs, work, types, "doc_id long, n_lines long, n_removed long, kept_sha256 string", percent)
