"""Secret scans: an Aho-Corasick prefilter, regular expressions anchored at its hits, checksums of what they match.

The scan works on the bytes of a text read as Latin-1 (one character a byte). All patterns are ASCII, so
matches are the same as on code points; offsets are turned into code points at the end.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, body, map_batches

#: Kinds in the order in which spans that start together are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "forge_token", "package_token", "extended_key")

# The patterns and least lengths of the base kinds, and the formats of tokens that embed a checksum.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
FORGE = re.compile(r"gh[opusr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
PACKAGE = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
EXTENDED = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

#: Hex runs have no keyword of their own; every run of 16 or more holds a hit of all four-digit hex strings.
HEX_GRAM = 4


def crc_suffix_holds(token: str) -> bool:
    """The last six base-62 digits are the CRC-32 of the 30 characters before them."""
    payload, digits = token[4:-6], token[-6:]
    value = 0
    for c in digits:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(payload.encode())


def base58_check_holds(key: str) -> bool:
    """The last four bytes are the head of the double SHA-256 of the others."""
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big").rjust(82, b"\0")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        found.add_word(word, (0, len(word)))
    found.add_word("akia", (1, 4))
    for gram in itertools.product("0123456789abcdef", repeat=HEX_GRAM):
        found.add_word("".join(gram), (2, HEX_GRAM))
    for word in ("gho_", "ghp_", "ghu_", "ghs_", "ghr_"):
        found.add_word(word, (3, 4))
    found.add_word("npm_", (4, 4))
    found.add_word("xprv", (5, 4))
    found.make_automaton()
    return found


def accepted(kind: int, match: re.Match) -> bool:
    if kind == 0:
        return len(match[2]) >= LEAST_ASSIGN
    if kind == 1:
        return len(match[0]) >= LEAST_ACCESS
    if kind == 2:
        return len(match[0]) >= LEAST_HEX
    return base58_check_holds(match[0]) if kind == 5 else crc_suffix_holds(match[0])


PATTERNS = (ASSIGN, ACCESS, HEX, FORGE, PACKAGE, EXTENDED)


def scanner() -> Callable[[bytes], list[tuple[int, int, int]]]:
    """A function from a text's bytes to its accepted (start, kind, end), in bytes, sorted."""
    hits = automaton()

    def scan(raw: bytes) -> list[tuple[int, int, int]]:
        text, spans, over = raw.decode("latin-1"), [], [0] * len(PATTERNS)
        for last, (kind, length) in hits.iter(raw.lower().decode("latin-1")):
            start = last + 1 - length
            # Leftmost, not overlapping, by kind: a hit inside an earlier match of its kind, kept or not, starts none.
            if start >= over[kind] and (match := PATTERNS[kind].match(text, start)):
                over[kind] = match.end()
                if accepted(kind, match):
                    spans.append((start, kind, match.end()))
        return sorted(spans)

    return scan


def to_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or raw.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Every secret of every whole text: doc_id, spans array<struct<kind, start, end>>, in code points, end exclusive.

    One row a row, whatever repeats; null or empty text gives an empty array; a null doc_id is carried; an empty table
    gives an empty result; further columns are ignored. Spans are ordered by start, then kind. Rows are
    independent, so very common secrets and sources need no shuffle at all.
    """
    types = {"doc_id": pa.int64(), "spans": pa.list_(SPAN)}

    def make():
        scan = scanner()

        def work(batch):
            out = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in to_code_points(text, scan(text))])
            return batch_of(types, {"doc_id": batch.column(0), "spans": out})

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), body()), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret's span replaced by ``<kind>``, and n_chars to match; no row goes.

    Overlapping spans are replaced as one, named for the first. Null and empty texts, null ids, repeated rows, empty tables and further
    columns of any name stay as they were. A very long text is scanned whole, as any other.
    """
    def make():
        scan = scanner()

        def clean(raw: bytes) -> str:
            out, at = [], 0
            for a, k, b in scan(raw):
                if a >= at:
                    out += [raw[at:a], b"<", KINDS[k].encode(), b">"]
                at = max(at, b)
            return b"".join([*out, raw[at:]]).decode()

        def work(batch):
            where = batch.schema.get_field_index("text")
            texts = [None if t is None else clean(t) for t in batch.column(where).cast(pa.binary()).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == where else c for i, c in enumerate(batch.columns)]
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return work

    redacted = map_batches(docs, make, docs.schema)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of :func:`find_secrets`: counts by base kind, base_sha256 and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    only = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return find_secrets(docs).select(
        "doc_id", *(F.size(only(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(said(only(*KINDS[:3])), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
