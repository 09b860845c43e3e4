"""Byte-level BPE encoding and decoding with a lexicon of the corpus's frequent words.

One pass counts words (each task keeps a bounded summary), the most frequent are compiled with their ids into a minimal
acyclic transducer, and the encoding pass looks up each distinct word of a batch in it. Words it lacks are merged exactly.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import os
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, body, map_batches, slices
from .lexicon import compile_words, gather_runs, map_arrays, places_of, save_arrays

#: Words in the lexicon, their most bytes, and how many a counting task keeps.
LEXICON, LONGEST, SUMMARY = 1 << 17, 48, 300_000
#: Words of more bytes than this are merged one by one with a heap, the others together.
LONG_WORD = 256

# The splitting pattern of byte-level BPE, and its form for texts without rare numerals and separators.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_WORDS = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


#: Characters that ``re`` may class otherwise than the full pattern: separators it counts as white space, Latin-1 numerals, and all beyond extended Latin.
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


@lru_cache
def full_pattern():
    import regex

    return regex.compile(WORDS)


def split_words(text: str) -> list[str]:
    """The text's words; all of the text is in one."""
    return (full_pattern() if ODD.search(text) else PLAIN_WORDS).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The vocabulary's character for each byte: printable Latin-1 as itself, others from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Token bytes, merges by rank and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*self.vocab.values(), *self.special.values()], default=-1) + 1)
        for token, i in self.vocab.items():
            self.tokens[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = self.vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)

    def arrays(self) -> dict[str, np.ndarray]:
        """For :func:`save_arrays`: pairs sorted by key with rank and result, bytes' ids, token bytes."""
        keys = self.merges[:, 0] << 32 | self.merges[:, 1]
        order = np.argsort(keys, kind="stable")
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        return {"pair": keys[order], "rank": order, "made": self.merges[order, 2], "of_byte": self.of_byte, "token_bytes": np.frombuffer(b"".join(self.tokens), np.uint8), "token_at": np.concatenate([[0], np.cumsum(lengths)])}


NONE = np.iinfo(np.int64).max


def find_pairs(tables: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (NONE if it isn't one) and place of each pair among the merges."""
    keys = left << 32 | right
    at = np.minimum(np.searchsorted(tables["pair"], keys), len(tables["pair"]) - 1)
    return np.where(tables["pair"][at] == keys, tables["rank"][at], NONE), at


def merge_long(tables: dict[str, np.ndarray], word: bytes) -> np.ndarray:
    """Ids of one long word: a heap of pairs by (rank, place) over a linked list."""
    ids = tables["of_byte"][np.frombuffer(word, np.uint8)]
    rank, at = find_pairs(tables, ids[:-1], ids[1:])
    heap = [(r, i, m) for i, (r, m) in enumerate(zip(rank.tolist(), tables["made"][at].tolist(), strict=True)) if r != NONE]
    heapq.heapify(heap)
    ids, n = ids.tolist(), len(word)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    stamp = dict(((i, r), True) for r, i, _ in heap)

    @lru_cache(1 << 16)
    def pair(a: int, b: int):
        r, p = find_pairs(tables, np.array([a]), np.array([b]))
        return int(r[0]), int(tables["made"][p[0]])

    def renew(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            r, m = pair(ids[i], ids[after[i]])
            if r != NONE:
                stamp[i, r] = True
                heapq.heappush(heap, (r, i, m))

    while heap:
        r, i, m = heapq.heappop(heap)
        if ids[i] < 0 or after[i] < 0 or pair(ids[i], ids[after[i]]) != (r, m):
            continue
        j = after[i]
        ids[i], ids[j], after[i] = m, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        renew(before[i])
        renew(i)
    return np.array([x for x in ids if x >= 0], np.int64)


def merge_words(tables: dict[str, np.ndarray], words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact BPE of many non-empty words at once: ids, word after word, and how many each has.

    In each round every word merges all places of its pair of lowest rank, left to right; a pair made by a merge always ranks
    after it, so this gives what merging one place at a time gives.
    """
    counts, done = np.zeros(len(words), np.int64), []
    for i, word in enumerate(words):
        if len(word) > LONG_WORD:
            done.append((np.array([i]), merge_long(tables, word)))
            counts[i] = len(done[-1][1])
    short = [i for i, word in enumerate(words) if len(word) <= LONG_WORD]
    lengths = np.array([len(words[i]) for i in short], np.int64)
    ids = tables["of_byte"][np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
    owner = np.repeat(np.array(short, np.int64), lengths)
    rank, place = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
    stale = np.ones(len(ids), bool)
    while len(ids):
        last = np.append(owner[1:] != owner[:-1], True)
        look = np.flatnonzero(stale & ~last)
        rank[last] = NONE
        rank[look], place[look] = find_pairs(tables, ids[look], ids[look + 1])
        starts = np.flatnonzero(np.append(True, last[:-1]))
        sizes = np.diff(np.append(starts, len(ids)))
        best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        over = best == NONE
        if over.any():
            counts[owner[starts]] = np.where(over[starts], sizes, counts[owner[starts]])
            done.append((owner[starts][over[starts]], ids[over]))
            ids, owner, rank, place, best, last = ids[~over], owner[~over], rank[~over], place[~over], best[~over], last[~over]
            if not len(ids):
                break
        hit = rank == best
        # In a run of overlapping places of one pair, every second one merges.
        index = np.arange(len(ids))
        run = np.maximum.accumulate(np.where(~hit, index, -1))
        hit &= (index - run) % 2 == 1
        at = np.flatnonzero(hit)
        ids[at] = tables["made"][place[at]]
        stale = np.zeros(len(ids), bool)
        stale[at] = True
        stale[np.maximum(at - 1, 0)] = True
        kept = np.ones(len(ids), bool)
        kept[at + 1] = False
        ids, owner, rank, place, stale = ids[kept], owner[kept], rank[kept], place[kept], stale[kept]
    owners = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in done)])
    flat = np.concatenate([np.zeros(0, np.int64), *(x for _, x in done)])
    own = counts[owners]
    at = np.zeros(len(words), np.int64)
    at[owners] = np.cumsum(own) - own
    return flat[gather_runs(at, counts)], counts


def count_words(docs: DataFrame, column: str = "text") -> DataFrame:
    """Word counts over all texts as (word, n). A task that meets more than ``SUMMARY`` kinds of words keeps the most frequent half, so its counts of rare words are lower bounds; no id depends on them."""

    def run(batches: Iterable[pa.RecordBatch]):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    counts.update(split_words(text))
                if len(counts) > SUMMARY:
                    counts = Counter(dict(counts.most_common(SUMMARY // 2)))
        top = [(w, n) for w, n in counts.most_common(LEXICON) if n > 1] or list(counts.items())
        yield batch_of({"word": pa.string(), "n": pa.int64()}, {"word": [w for w, _ in top], "n": [n for _, n in top]})

    return docs.select(body(column)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[bytes]:
    """At most ``most`` frequent words, in byte order."""
    counted = count_words(docs).where(F.octet_length("word") <= LONGEST)
    top = counted.orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    return sorted({w.encode() for w in top.column(0).to_pylist()} - {b""})


def ship_lexicon(spark: SparkSession, path: str, words: Sequence[bytes]) -> str:
    """Compiles the words with their ids and hands the file to all executors; returns its name there."""
    tables = Vocabulary(path).arrays()
    ids, counts = merge_words(tables, words)
    auto = compile_words(words)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp()  # the driver's own; executors get the file from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    local = os.path.join(folder, name)
    save_arrays(local, tables | auto | {"word_ids": ids, "word_at": np.concatenate([[0], np.cumsum(counts)])})
    spark.sparkContext.addFile(local)
    return name


class Slots(dict):
    """A word's number, by order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes and decodes batches of texts with a mapped lexicon."""

    def __init__(self, path: str, special: dict[str, int]):
        self.t = map_arrays(path)
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: flat ids, starts and counts."""
        place = places_of(self.t, words)
        unseen = np.flatnonzero(place < 0)
        merged, sizes = merge_words(self.t, [words[i] for i in unseen.tolist()])
        counts = self.t["word_at"][place + 1] - self.t["word_at"][np.maximum(place, 0)]
        counts[unseen] = sizes
        starts = self.t["word_at"][np.maximum(place, 0)].copy()
        starts[unseen] = len(self.t["word_ids"]) + np.cumsum(sizes) - sizes
        return np.concatenate([self.t["word_ids"], merged]), starts, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        slots, codes, extra = Slots(), [], {}
        for text in texts:
            if self.cut and self.cut.search(text):
                words = []
                for i, part in enumerate(self.cut.split(text)):
                    if i % 2:
                        words.append(mark := ("special", part))
                        extra[mark] = self.special[part]
                    else:
                        words += split_words(part)
            else:
                words = split_words(text)
            codes.append(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)))
        ids, starts, counts = self.word_ids([w.encode() if isinstance(w, str) else b"" for w in slots])
        for mark, i in extra.items():
            starts[slots[mark]], counts[slots[mark]] = len(ids), 1
            ids = np.append(ids, i)
        out = []
        for own in codes:
            out.append(ids[gather_runs(starts[own], counts[own])].astype("<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        at = self.t["token_at"]
        return self.t["token_bytes"][gather_runs(at[ids], at[ids.astype(np.int64) + 1] - at[ids])].tobytes().decode("utf-8", "replace")


def with_encoder(docs: DataFrame, path: str, work: Callable, types: dict[str, pa.DataType], schema: str, words: Sequence[bytes] | None = None) -> DataFrame:
    """Maps ``work(encoder, batch)`` over (doc_id, text), null texts as empty."""
    name = ship_lexicon(docs.sparkSession, path, frequent_words(docs) if words is None else words)
    special = Vocabulary(path).special

    def make():
        encoder = Encoder(SparkFiles.get(name), special)
        return lambda batch: batch_of(types, work(encoder, batch))

    return map_batches(docs.select(F.col("doc_id").cast("long"), body()), make, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of each whole text: doc_id, ids array<long>.

    ``path`` is a byte-level BPE tokenizer file. One row a row; null or empty texts have no ids; special tokens in a text count
    as such; a null doc_id is carried; an empty table gives an empty result; further columns are ignored.
    """
    work = lambda encoder, batch: {"doc_id": batch.column(0), "ids": encoder.encode(batch.column(1).to_pylist())}
    return with_encoder(docs, path, work, {"doc_id": pa.int64(), "ids": pa.list_(pa.int64())}, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of (doc_id, ids): doc_id, text; null ids give a null text, bytes that are not UTF-8 a replacement character."""
    tokens = Vocabulary(path).tokens

    def make():
        def work(batch):
            texts = [None if ids is None else b"".join(tokens[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            return batch_of({"doc_id": pa.int64(), "text": pa.string()}, {"doc_id": batch.column(0), "text": texts})

        return work

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), make, "doc_id long, text string")


def round_trip_report(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256."""
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def work(encoder, batch):
        ids = encoder.encode(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "n_tokens": [len(x) for x in ids], "ids_sha256": [sha(x.tobytes()) for x in ids], "decoded_sha256": [sha(encoder.decode(x).encode()) for x in ids]}

    types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return with_encoder(docs, path, work, types, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
