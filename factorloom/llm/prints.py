"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for two prime moduli, the polynomial hash of each of its prefixes. The hash of any span follows
from two entries, so spans are compared without reading them and the longest common extension of two places is found by binary
search. A fingerprint samples the span hashes: it holds the length, the whole text's hash and the smallest hashes of all its spans of
``SPAN`` code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, body, partitions_for

MODULI, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Code points of a sampled span, hashes in a fingerprint, and bits of each.
SPAN, SAMPLE, BITS = 12, 48, 40


class Powers:
    """Powers of each base and of its inverse, as far as they have been asked for."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in MODULI]
        self.down = [np.ones(1, np.uint64) for _ in MODULI]

    def reach(self, n: int) -> None:
        for tables, bases in ((self.up, BASES), (self.down, [pow(b, -1, p) for b, p in zip(BASES, MODULI, strict=True)])):
            for i, (base, p) in enumerate(zip(bases, MODULI, strict=True)):
                while len(tables[i]) < n:
                    tables[i] = np.concatenate([tables[i], tables[i] * np.uint64(pow(base, len(tables[i]), p)) % np.uint64(p)])


POWERS = Powers()


class PrefixHashes:
    """The prefix arrays of a sequence of code points (or bytes)."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        POWERS.reach(self.n + 1)
        self.prefix = []
        for up, p in zip(POWERS.up, MODULI, strict=True):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * up[: self.n] % np.uint64(p)
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % np.uint64(p)]))

    def spans(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """62-bit hashes of the spans [start, end), the same for equal spans wherever they stand."""
        both = []
        for h, down, p in zip(self.prefix, POWERS.down, MODULI, strict=True):
            q = np.uint64(p)
            first = down[: self.n + 1][starts]
            both.append((h[ends] + q - h[starts]) % q * first % q)
        return both[0] << np.uint64(31) | both[1]

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def extension(self, at: int, other: PrefixHashes, there: int) -> int:
        """Length of the longest common extension of a place here and one in ``other``, by binary search."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            half = (low + high + 1) // 2
            if self.span(at, at + half) == other.span(there, there + half):
                low = half
            else:
                high = half - 1
        return low

    def sample(self) -> np.ndarray:
        """The smallest mixed hashes of the spans of SPAN code points (of the whole text, if it is shorter)."""
        if not self.n:
            return np.zeros(0, np.uint64)
        width = min(SPAN, self.n)
        mixed = self.spans(slice(0, self.n - width + 1), slice(width, self.n + 1))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(27))) >> np.uint64(64 - BITS)
        many = 4 * SAMPLE
        while many < len(mixed):  # the smallest distinct ones; repeats may call for more
            least = np.unique(np.partition(mixed, many)[:many])
            if len(least) >= SAMPLE:
                return least[:SAMPLE]
            many *= 4
        return np.unique(mixed)[:SAMPLE]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(hashes: PrefixHashes) -> str:
    """``length-hash-sample`` in hex; equal texts have equal fingerprints."""
    digits = BITS // 4
    return f"{hashes.n:x}-{hashes.span(0, hashes.n):016x}-" + "".join(f"{x:0{digits}x}" for x in hashes.sample().tolist())


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the share of spans that two texts have in common (twice the common over the sum), estimated from their fingerprints."""
    if a == b:
        return 1.0
    digits = BITS // 4
    one, two = ({s[i : i + digits] for i in range(0, len(s), digits)} for s in (a.rsplit("-", 1)[1], b.rsplit("-", 1)[1]))
    least = sorted(one | two)[:SAMPLE]
    if not least:
        return 1.0
    same = sum(x in one and x in two for x in least) / len(least)
    return 2 * same / (1 + same)


TYPES = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "common_prefix": pa.int64()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts: doc_id, n_chars, fingerprint. One row a row; null counts as empty; further columns are ignored."""
    types = {k: TYPES[k] for k in ("doc_id", "n_chars", "fingerprint")}

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            hashes = [(h.n, fingerprint(h)) for h in (PrefixHashes(code_points(t)) for t in batch.column(1).to_pylist())]
            yield batch_of(types, {"doc_id": batch.column(0), "n_chars": [n for n, _ in hashes], "fingerprint": [f for _, f in hashes]})

    return docs.select(F.col("doc_id").cast("long"), body()).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order_with_next(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """(doc_id, text) dealt into ranges of doc_id and sorted there as (part, tail, doc_id, text).

    Each range starts at a doc_id that exists, taken from approximate percentiles (as many as ranges). Rows with a range's
    first doc_id also follow the range before it, marked ``tail``, the first range's the last: so each row's successor is the next in its
    range, and the texts are shuffled once.
    """
    count = partitions_for(docs)
    parts = count * per_partition
    own = docs.select(F.col("doc_id").cast("long"), body().alias("text"))
    probabilities = [i / parts for i in range(1, parts)]
    row = own.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", probabilities, 40 * parts).alias("at"), F.bool_or(F.col("doc_id").isNull()).alias("nulls")).first()
    firsts = np.array(sorted({row["low"], *row["at"]}) if row["low"] is not None else [], np.int64)
    nulls, last = bool(row["nulls"]), max(len(firsts) - 1, 0)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        values = ids.where(known, 0).astype("int64").to_numpy() if known.all() or len(firsts) else np.zeros(len(ids), np.int64)
        at = np.searchsorted(firsts, values, "right") - 1
        leads = np.where(known, (at >= 0) & (firsts[np.maximum(at, 0)] == values if len(firsts) else False) & ~((at == 0) & nulls), nulls)
        return pd.Series(np.where(known, np.maximum(at, 0), 0) * 2 + leads)  # the range, and whether the row leads it

    dealt = own.withColumn("_at", range_of("doc_id")).withColumn("part", F.shiftright("_at", 1))
    before = F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1)
    here = F.struct(F.col("part"), F.lit(0).alias("tail"))
    places = F.when(F.col("_at") % 2 == 1, F.array(here, F.struct(before.cast("int").alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(here))
    dealt = dealt.select("doc_id", "text", F.explode(places).alias("place")).select("place.part", "place.tail", "doc_id", "text")
    return dealt.repartition(count, "part").sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, the text with its last half replaced by the start of the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and common_prefix: the longest common
    extension of the text and its edit from their starts. One row a row. Documents follow by doc_id, nulls first, repeated
    ids by text; after the last comes the first. Null counts as empty; equal (also empty) texts have likeness 1; an empty table
    gives an empty result; further columns are ignored.
    """
    def run(batches: Iterable[pa.RecordBatch]):
        out: dict[str, list] = {k: [] for k in TYPES}
        waiting = None  # the row whose successor has not come yet

        def finish(row, after) -> None:
            (doc_id, text, hashes, own), (_, following, _, other) = row, after
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            changed = PrefixHashes(code_points(edited))
            new = fingerprint(changed)
            values = (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, new, likeness(own, new), likeness(own, other), hashes.extension(0, changed, 0))
            for k, v in zip(TYPES, values, strict=True):
                out[k].append(v)

        for batch in batches:
            for part, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tail and (waiting is None or waiting[0] != part):
                    continue  # a further row with the same first doc_id
                hashes = PrefixHashes(code_points(text))
                row = (doc_id, text, hashes, fingerprint(hashes))
                if waiting is not None and waiting[0] == part:
                    finish(waiting[1], row)
                waiting = None if tail else (part, row)
                if len(out["doc_id"]) >= 1000:
                    yield batch_of(TYPES, out)
                    out = {k: [] for k in TYPES}
        yield batch_of(TYPES, out)

    return in_order_with_next(docs).mapInArrow(run, SCHEMA)
