"""Token ids as files of Simple-8b words.

A word of 64 bits holds a selector of 4 bits and a payload of 60: so many ids of so many bits each. An id that no width takes is an
escape, which points into a list of whole integers; a run of zeros is one word. Ids are cut into blocks that are coded on
their own, and a segment says at which word each block starts, so any block is decoded without those before it, all its words at once.

A file is a Parquet file of segments (part, segment, first, doc_ids, lengths, data): whole documents in ascending order of doc_id, about
at most ``SEGMENT`` ids together if they are two or more; parts follow each other in the same order. Spark commits the files, so a task that is lost or run twice leaves none of its own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, body, delete_path, partitions_for, scratch_path, slices, written
from .lexicon import gather_runs

# Fixed values of the format: how many payloads of how many bits selectors 1 to 14 stand for. Selector 0 is an escape, 15 a run of zeros.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in COUNTS)
ESCAPE, ZEROS = 0, 15
BLOCK, SEGMENT = 1024, 1 << 16
#: Pieces of words that a Python worker remembers the ids of from one batch to the next.
REMEMBERED = 400_000
U = np.uint64


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if not len(ids) or ids.max() < 1 << 53:
        return np.frexp(ids.astype(float))[1].astype(np.uint8)  # a double holds them
    bits = np.zeros(len(ids), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        over = ids >= U(1) << U(shift)
        bits += (shift * over).astype(np.uint8)
        ids = np.where(over, ids >> U(shift), ids)
    return bits + (ids > 0)


def walked(step: np.ndarray, block: int) -> np.ndarray:
    """The places that words start at, when each block is gone through from its start by the steps at its places, which end with the block; all blocks go side by side."""
    n = len(step)
    at, ends = np.arange(0, n, block), np.minimum(np.arange(0, n, block) + block, n)
    chosen = np.zeros(n, bool)
    while len(at):
        chosen[at] = True
        at = at + step[at]
        inside = at < ends
        if not inside.all():
            at, ends = at[inside], ends[inside]
    return np.flatnonzero(chosen)


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids (unsigned, of up to 64 bits) as bytes: a head of five integers, the first word of each block, words, escapes."""
    ids = np.ascontiguousarray(ids, U)
    n, bits = len(ids), bit_lengths(ids)
    room = np.minimum(block - np.arange(n) % block, n - np.arange(n))  # ids to the end of the block
    best = np.zeros(n, np.int64)
    for selector in range(len(COUNTS), 0, -1):  # the more ids the better, so the last that fits
        count, width = COUNTS[selector - 1], WIDTHS[selector - 1]
        over = np.zeros(n + 1, np.int32)
        np.cumsum(bits > width, out=over[1:])
        if count <= n:
            best[: n - count + 1][(over[count:] == over[: n + 1 - count]) & (room[: n - count + 1] >= count)] = selector
    step = np.array([1, *COUNTS])[best]
    zero = bits == 0
    change = np.flatnonzero(np.concatenate([[True], (zero[1:] != zero[:-1]) | (np.arange(1, n) % block == 0), [True]])) if n else np.zeros(1, np.int64)
    starts, runs = change[:-1], np.diff(change)
    long = zero[starts] & (runs > COUNTS[0]) if n else np.zeros(0, bool)
    for start, run in zip(starts[long].tolist(), runs[long].tolist(), strict=True):  # from each place in a run its rest is one word
        best[start : start + run], step[start : start + run] = ZEROS, run - np.arange(run)
    places = walked(step, block)
    chosen = best[places]
    words = chosen.astype(U) << U(60)
    for selector in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == selector)
        if selector == ZEROS:
            words[own] |= step[places[own]].astype(U)
        elif selector == ESCAPE:
            words[own] |= np.arange(len(own)).astype(U)
        else:
            for k in range(COUNTS[selector - 1]):
                words[own] |= ids[places[own] + k] << U(k * WIDTHS[selector - 1])
    escapes = ids[places[chosen == ESCAPE]]
    firsts = np.arange(0, n, block)
    word_at = np.searchsorted(places, firsts)
    head = np.array([n, block, len(firsts), len(words), len(escapes)], "<u8")
    return b"".join(a.astype("<u8").tobytes() for a in (head, word_at, words, escapes))


class Packed:
    """Packed ids, read from bytes without a copy."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, "<u8")
        self.n, self.block, blocks, words, escapes = (int(x) for x in raw[:5])
        self.word_at = raw[5 : 5 + blocks].astype(np.int64)
        self.words = raw[5 + blocks : 5 + blocks + words]
        self.escapes = raw[5 + blocks + words : 5 + blocks + words + escapes]

    def blocks(self, low: int, high: int) -> np.ndarray:
        """Ids of blocks ``low`` to ``high``, end exclusive; all words are decoded side by side."""
        ends = np.append(self.word_at, len(self.words))
        words = self.words[ends[low] : ends[high]]
        selectors = (words >> U(60)).astype(np.int64)
        payload = words & U((1 << 60) - 1)
        counts = np.array([1, *COUNTS, 0])[selectors]
        counts[selectors == ZEROS] = payload[selectors == ZEROS].astype(np.int64)
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), U)
        for selector in np.unique(selectors).tolist():
            own = np.flatnonzero(selectors == selector)
            if selector == ESCAPE:
                out[at[own]] = self.escapes[payload[own].astype(np.int64)]
            elif selector != ZEROS:
                width = WIDTHS[selector - 1]
                for k in range(COUNTS[selector - 1]):
                    out[at[own] + k] = payload[own] >> U(k * width) & U((1 << width) - 1)
        return out

    def all(self) -> np.ndarray:
        return self.blocks(0, len(self.word_at))

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end``, from the blocks that hold them alone."""
        if start >= end:
            return np.zeros(0, U)
        low, high = start // self.block, (end - 1) // self.block + 1
        return self.blocks(low, high)[start - low * self.block : end - low * self.block]


def strings(values: pa.Array) -> list[str]:
    """As to_pylist of an array without nulls, by numpy, which is faster."""
    return values.to_numpy(zero_copy_only=False).tolist()


def expanded(lists: pa.ListArray, values: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists' members in turn, and how many each list has; ``values`` gives those of the distinct members."""
    coded = lists.flatten().dictionary_encode()
    ids, sizes = values(coded.dictionary)
    own = coded.indices.to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes[own])])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return ids[gather_runs((np.cumsum(sizes) - sizes)[own], sizes[own])], np.diff(before[ends], prepend=0)


class WordEncoder:
    """Encodes texts by a tokenizers file: distinct words between ASCII white space, and the distinct pieces of those.

    Only for tokenizers that drop white space, whose ids of a text are those of its words in turn. Where the file's steps are those that
    ``split_rule`` knows, words of Latin letters are cut by its pattern, and each piece goes to its model once and is remembered; any other word
    is a piece that goes through all steps of the library.
    """

    #: Printable characters before U+0180 that NFC keeps and whose lower case is one character.
    letters = "!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task a core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.of_whole("a\n b") != self.of_whole("a") + self.of_whole("b") or any(t.split() != [t] for t in special):
            raise ValueError("this tokenizer does not drop white space")
        self.special, self.latin = "|".join(map(re.escape, special)), f"^[{self.letters}]+$"
        self.rule, as_letters = self.split_rule(), ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        printable = [c for c in map(chr, range(0x180)) if re.match(f"[{self.letters}]", c)]
        self.byte_letters = {b: x for c in printable for b, x in zip(c.encode(), as_letters(c)[0][0], strict=True)} | {10: "\n"}
        #: Only quoted endings come before runs of letters, so a word of letters alone is one piece.
        self.letters_are_one = bool(re.match(r"(?:'[a-z]+\|)*\[?\\p\{L\}\]?\+(?:\||$)", self.rule or ""))
        self.pieces: dict[str, bytes] = {}

    def split_rule(self) -> str | None:
        """The file's pattern, if its matches are the pieces, bytes are then written as letters, and before that Latin letters only change case."""
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        first, *rest = steps.get("pretokenizers") or [{"type": None}]
        every = "".join(c for c in map(chr, range(0x180)) if re.match(f"[{self.letters}]", c))
        keeps = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
        level = [r["type"] == "ByteLevel" and not r["add_prefix_space"] and not r["use_regex"] for r in rest] == [True]
        if keeps and level and self.tokenizer.normalizer and self.tokenizer.normalizer.normalize_str(every) == pc.utf8_lower(every).as_py():
            return first["pattern"]["Regex"]
        return None

    def of_whole(self, text: str) -> bytes:
        """Ids as integers of 32 bits, by all steps of the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def plain(self, words: pa.Array) -> pa.Array:
        """Which words are of Latin letters and printable, without a special token."""
        found = pc.match_substring_regex(words, self.latin)
        return pc.and_not(found, pc.match_substring_regex(words, self.special)) if self.special else found

    def learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces. Those that are plain go to the model, with their bytes as letters, others through all steps of the library."""
        plain = strings(self.plain(pa.array(pieces, pa.string()))) if self.rule else [False] * len(pieces)
        letters = iter("\n".join(p for p, own in zip(pieces, plain, strict=True) if own).encode().decode("latin-1").translate(self.byte_letters).split("\n"))
        tokens = self.tokenizer.model.tokenize
        for piece, own in zip(pieces, plain, strict=True):
            self.pieces[piece] = array("I", [t.id for t in tokens(next(letters))]).tobytes() if own else self.of_whole(piece)

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = strings(pieces)
        self.learn([p for p in own if p not in self.pieces])
        found = list(map(self.pieces.__getitem__, own))
        if len(self.pieces) > REMEMBERED:
            self.pieces = {p: self.pieces[p] for p in own[:REMEMBERED]}
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def cut(self, words: pa.Array) -> pa.Array:
        """Plain words in lower case, a space after each piece."""
        low = pc.utf8_lower(words)
        if not self.letters_are_one:
            return pc.replace_substring_regex(low, f"({self.rule})", r"\1 ")
        several = pc.invert(pc.match_substring_regex(low, r"^\p{L}+$"))
        return pc.replace_with_mask(low, several, pc.replace_substring_regex(low.filter(several), f"({self.rule})", r"\1 "))

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.rule:
            words = pc.if_else(self.plain(words), self.cut(words), words)
        return expanded(pc.ascii_split_whitespace(words), self.of_pieces)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and how many each has."""
        return expanded(pc.ascii_split_whitespace(texts), self.of_words)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One a Python worker, for all its tasks."""
    return WordEncoder(path)


SEGMENTS = {"part": pa.int32(), "segment": pa.int32(), "first": pa.int64(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "data": pa.binary()}
SEGMENTS_DDL = "part int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, segment: int = SEGMENT) -> None:
    """Writes the ids of all texts, each with ``end_id`` after it, as files in ascending order of doc_id.

    Every row is a document, repeated ones too. Nulls come first; rows of one doc_id (or none) follow by a hash of the text, so that ranges can split
    them. Null and empty texts are the end alone; a long text is a segment of its own; an empty table leaves files without a
    segment; further columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long"), body().alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    dealt = own.repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterable[pa.RecordBatch]):
        encode, part, number, first = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for piece in slices(batch):
                ids, sizes = encode(piece.column(1))
                ids, ends = np.insert(ids, np.cumsum(sizes), end_id), np.cumsum(sizes + 1)
                row = start = 0
                while row < len(ends):
                    above = max(int(np.searchsorted(ends, start + segment, "right")), row + 1)
                    stop = int(ends[above - 1])
                    yield batch_of(SEGMENTS, {
                        "part": [part], "segment": [number], "first": [first], "n_ids": [stop - start], "doc_ids": [piece.column(0)[row:above].to_pylist()],
                        "lengths": [(sizes[row:above] + 1).tolist()], "data": [pack(ids[start:stop])]})
                    number, first, row, start = number + 1, first + stop - start, above, stop

    dealt.mapInArrow(run, SEGMENTS_DDL).write.parquet(path)


def map_documents(spark: SparkSession, path: str, types: dict[str, pa.DataType], schema: str, work: Callable[[list[np.ndarray]], dict]) -> DataFrame:
    """``work(ids)`` of each document's ids, beside doc_id, start (ids of all documents before it) and n_tokens, from the files.

    What is added up first are the parts' sizes, one number a file.
    """
    stored = spark.read.schema(SEGMENTS_DDL).parquet(path)
    sizes = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("n")).collect()}
    begins, total = {}, 0
    for part in sorted(sizes):
        begins[part], total = total, total + sizes[part]
    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), **types}

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, doc_ids, lengths, data = (batch.column(c)[row].as_py() for c in range(5))
                ids, sizes = Packed(data).all(), np.array(lengths, np.int64)
                ends = np.cumsum(sizes)
                yield batch_of(types, {"doc_id": doc_ids, "start": (begins[part] + first + ends - sizes).tolist(), "n_tokens": lengths, **work([ids[e - n : e] for e, n in zip(ends.tolist(), lengths, strict=True)])})

    return stored.select("part", "first", "doc_ids", "lengths", "data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of files that :func:`write_tokens` wrote: doc_id, start, n_tokens, ids (with the end)."""
    return map_documents(spark, path, {"ids": pa.list_(pa.int64())}, "ids array<long>", lambda found: {"ids": [x.astype(np.int64) for x in found]})


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes all texts' ids, reads the files back and returns doc_id, start, n_tokens, ids_crc32; the files go when they are read."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    crc = lambda found: {"ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in found]}
    report = written(map_documents(spark, path, {"ids_crc32": pa.int64()}, "ids_crc32 long", crc), "token-report")
    delete_path(spark, path)
    return report
