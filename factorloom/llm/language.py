"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rolled) by its place; a text's vector bundles (adds) the vectors of its n-grams, and a language's
prototype bundles the unit vectors of its training texts. Texts go to the language with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches

DIMENSIONS, GRAM = 1024, 3
#: Languages are a closed set of labels: more than this many are taken for a wrong column and raise.
MOST_LANGUAGES = 10_000
#: Bound on the training texts of each language, taken by the order of a hash of doc_id; they are about so many.
TRAINING_TEXTS = 3000
UNKNOWN = "und"


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random vector of a code point (0: a word's edge), the same on every machine."""
    return np.random.default_rng([7, code]).integers(0, 2, dimensions).astype(np.int8) * 2 - 1


def letters_of(text: str, is_letter: np.ndarray) -> np.ndarray:
    """Lower-case code points, each run of others as one 0, edges too; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    own = is_letter[codes]
    if not own.any():
        return codes[:0]
    edged = np.zeros(len(codes) + 2, np.uint32)
    edged[1:-1] = np.where(own, codes, 0)
    return edged[np.append(True, (edged[1:] != 0) | (edged[:-1] != 0))]  # of non-letters in a row, the first


class Bundler:
    """Texts to bundled n-gram vectors. Letters and n-grams get numbers as a task meets them; n-gram vectors are made once and kept while they are few.

    A text of more than ``most_letters`` letters goes by packed code points instead; the vectors of its n-grams are the same, but not kept.
    """

    def __init__(self, dimensions: int = DIMENSIONS, most_kept: int = 50_000, most_letters: int = 160):
        self.dimensions, self.most_kept, self.most_letters = dimensions, most_kept, most_letters
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.known: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.slot = np.full(0x110000, -1, np.int16)  # a code point's number
        self.letters = np.zeros((0, self.dimensions), np.int8)
        self.gram = np.full(self.most_letters**GRAM, -1, np.int32)  # an n-gram's number, by its letters' numbers
        self.vectors = np.zeros((1024, self.dimensions), np.int8)
        self.grams = 0

    def vectors_of(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of distinct code points; those met before are kept while they are few."""
        if len(self.known) > 20_000:
            self.known.clear()
        for c in codes.tolist():
            if c not in self.known:
                self.known[c] = letter_vector(c, self.dimensions)
        return np.array([self.known[c] for c in codes.tolist()], np.int8)

    def learn_letters(self, codes: np.ndarray) -> None:
        fresh = np.unique(codes[self.slot[codes] < 0])
        if len(self.letters) + len(fresh) > self.most_letters:
            self.forget()
            fresh = np.unique(codes)
        self.slot[fresh] = np.arange(len(self.letters), len(self.letters) + len(fresh))
        self.letters = np.vstack([self.letters, self.vectors_of(fresh)])

    def learn_grams(self, packed: np.ndarray) -> None:
        fresh = np.unique(packed[self.gram[packed] < 0])
        if self.grams + len(fresh) > self.most_kept:
            self.gram[:] = -1
            self.grams, fresh = 0, np.unique(packed)
        made = np.ones((len(fresh), self.dimensions), np.int8)
        for place in range(GRAM):
            made *= np.roll(self.letters[fresh // self.most_letters**place % self.most_letters], place, axis=1)
        while self.grams + len(fresh) > len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[self.grams : self.grams + len(fresh)] = made
        self.gram[fresh] = np.arange(self.grams, self.grams + len(fresh))
        self.grams += len(fresh)

    def packed_total(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The sum for a text of any number of letters (kinds: all of them, in order)."""
        packed = codes[: 1 - GRAM].astype(np.uint64)
        for place in range(1, GRAM):
            packed = packed << np.uint64(21) | codes[place : len(codes) - GRAM + 1 + place]
        grams, counts = np.unique(packed, return_counts=True)
        weights, letters = np.sqrt(counts).astype(np.float32), self.vectors_of(kinds)
        total = np.zeros(self.dimensions, np.float32)
        for start in range(0, len(grams), 2048):
            part = grams[start : start + 2048]
            made = np.ones((len(part), self.dimensions), np.int8)
            for place in range(GRAM):
                own = np.searchsorted(kinds, part >> np.uint64(21 * place) & np.uint64(0x1FFFFF))
                made *= np.roll(letters[own], place, axis=1)
            total += weights[start : start + 2048] @ made.astype(np.float32)
        return total

    def numbered_total(self, codes: np.ndarray) -> np.ndarray:
        """The sum for a text of at most ``most_letters`` letters."""
        if (self.slot[codes] < 0).any():
            self.learn_letters(codes)
        slots = self.slot[codes].astype(np.int64)
        packed = slots[: 1 - GRAM].copy()
        for place in range(1, GRAM):
            packed = packed * self.most_letters + slots[place : len(slots) - GRAM + 1 + place]
        if (self.gram[packed] < 0).any():
            self.learn_grams(packed)
        counts = np.bincount(self.gram[packed])
        own = np.flatnonzero(counts)
        weights = np.sqrt(counts[own]).astype(np.float32)
        total = np.zeros(self.dimensions, np.float32)
        for start in range(0, len(own), 2048):
            total += weights[start : start + 2048] @ self.vectors[own[start : start + 2048]].astype(np.float32)
        return total

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None if it has no letter. n-grams weigh as the root of their counts."""
        codes = letters_of(text, self.is_letter) if text else ()
        if len(codes) < GRAM:
            return None
        kinds = np.unique(codes)
        total = self.packed_total(codes, kinds) if len(kinds) > self.most_letters else self.numbered_total(codes)
        return total / max(float(np.linalg.norm(total)), 1e-12)


def train(docs: DataFrame, training_texts: int = TRAINING_TEXTS) -> dict[str, np.ndarray]:
    """Prototypes of each language in ``docs`` (text, lang): rows with a null text or lang, or no letter, teach nothing.

    Each task adds up its own texts by language; languages are a closed set, so a prototype is all that reaches the driver.
    """
    usable = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, training_texts / n)))))
    sample = usable.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("text", "lang")
    types = {"lang": pa.string(), "total": pa.list_(pa.float64())}

    def make():
        bundler = Bundler()

        def work(batch):
            totals: dict[str, np.ndarray] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (vector := bundler.bundle(text)) is not None:
                    totals[lang] = totals.get(lang, 0) + vector.astype(np.float64)
            return batch_of(types, {"lang": list(totals), "total": [v.tolist() for v in totals.values()]})

        return work

    parts = map_batches(sample, make, "lang string, total array<double>")
    summed = parts.select("lang", F.posexplode("total")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    prototypes: dict[str, np.ndarray] = {}
    for row in summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).collect():
        prototypes[row["lang"]] = np.array([p["x"] for p in row["v"]])
    return prototypes


def profile_matrix(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes."""
    names = sorted(prototypes)
    rows = np.array([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-12) for k in names], np.float32).reshape(len(names), DIMENSIONS)
    return names, rows


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The language of each whole text: doc_id, lang_pred, score (the cosine, at least 0).

    One row a row; null, empty or letterless texts, or no prototypes, give ``und`` with score 0; ties go to the first language
    by name; a null doc_id is carried; further columns are ignored.
    """
    names, rows = profile_matrix(prototypes)
    types = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64()}

    def make() -> Callable:
        bundler = Bundler()

        def work(batch):
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                vector = bundler.bundle(text) if names else None
                cosines = None if vector is None else rows @ vector
                best = None if cosines is None else int(np.argmax(cosines))
                langs.append(UNKNOWN if best is None else names[best])
                scores.append(0.0 if best is None else float(min(1.0, max(0.0, cosines[best]))))
            return batch_of(types, {"doc_id": batch.column(0), "lang_pred": langs, "score": scores})

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")


#: Rows of this remainder of crc32(doc_id as text) are held out from training.
FOLDS, HELD_OUT = 5, 0


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """Trains on the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score. A null doc_id is not held out."""
    prototypes = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
