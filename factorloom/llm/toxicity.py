"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) is the logistic function of threshold k less a score; the score's weights are shared by all thresholds, which
are ordered. Features are the distinct words of a text and their first letters, so inflected forms share weight.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, body, map_batches, slices, written

#: Bounds of training: labelled texts of each class (those least in a hash of doc_id), features, the least significance of a feature and the least
#: texts it is in. They bound the model, not the texts that are graded.
CLASS_TEXTS, FEATURES, LEAST_Z, LEAST_TEXTS = 6000, 20_000, 4.0, 5
GRADES = 3
PREFIXES = (4, 5, 6)
#: Parts of the sample that grade each other's toxic texts, and rounds of those fits, which only have to order texts.
FOLDS, FOLD_ROUNDS = 2, 200
#: A prefix's value in a text is how many of its words have it, up to this: what a feature is, in training and in grading alike.
MOST_COUNTED = 6
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: Iterable[str]) -> Counter:
    """Each word, and each prefix with how many distinct words have it."""
    found: Counter = Counter()
    for w in words:
        found[w] += 1
        for n in PREFIXES:
            if len(w) > n:
                found[w[:n] + "*"] += 1
    return found


@dataclass
class OrdinalModel:
    """Weights of words and prefixes, and ascending thresholds; a larger score means a higher grade."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_cumulative_link(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, features: int, grades: int, ridge: float = 3e-5, rounds: int = 500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean negative log-likelihood, from sparse rows. Thresholds are a first one and positive gaps, so they stay in order."""
    n = len(grade)
    share = np.clip([(grade <= k).mean() for k in range(grades - 1)], 0.01, 0.99)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(grades - 1) * 1e-3)
    parameters = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, rounds + 1):
        gaps = np.exp(parameters[features + 1 :])
        theta = parameters[features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(doc, value * parameters[feature], n)
        edges = np.concatenate([np.full((n, 1), 0.0), sigmoid(theta[None, :] - score[:, None]), np.full((n, 1), 1.0)], axis=1)
        rows = np.arange(n)
        low, high = edges[rows, grade], edges[rows, grade + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p  # slopes of log p in the upper and lower threshold
        d_score = (d_high - d_low) / n
        d_theta = np.array([(d_low[grade == k + 1].sum() - d_high[grade == k].sum()) / n for k in range(grades - 1)])
        after = np.cumsum(d_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(feature, value * d_score[doc], features) + ridge * parameters[:features], [after[0]], after[1:] * gaps])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        parameters -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(parameters[features + 1 :])
    return parameters[:features], parameters[features] + np.concatenate([[0.0], np.cumsum(gaps)])


def cross_fitted(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, toxic: np.ndarray, fold: np.ndarray, features: int) -> np.ndarray:
    """A score of each text by a two-class fit on the texts of the other folds alone, so its own label and words taught nothing of it; 0 where those lack a class."""
    scores = np.zeros(len(toxic))
    for f in range(FOLDS):
        others = fold != f
        if len(set(toxic[others].tolist())) < 2:
            continue
        at, taught, own = np.cumsum(others) - 1, others[doc], ~others[doc]
        weights, _ = fit_cumulative_link(at[doc[taught]], feature[taught], value[taught], toxic[others], features, 2, rounds=FOLD_ROUNDS)
        scores[~others] = np.bincount(doc[own], value[own] * weights[feature[own]], len(toxic))[~others]
    return scores


def severity_grades(scores: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic; of a fold's toxic ones 2 for those that score over their median, else 1. Scores of folds are never compared, as they have models of their own."""
    grade = (toxic > 0).astype(int)
    for f in range(FOLDS):
        own = (toxic > 0) & (fold == f)
        if own.any():
            grade[own & (scores > np.median(scores[own]))] = 2
    return grade


def labelled_sample(docs: DataFrame, labels: DataFrame, class_texts: int = CLASS_TEXTS) -> DataFrame:
    """(text, toxic) of at most ``class_texts`` labelled texts of each class. The ids of the sample, so bounded, are broadcast."""
    usable = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    one = lambda k: usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_texts)
    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).join(F.broadcast(one(0).union(one(1))), "doc_id").select("text", "toxic")


def telling_features(sample: DataFrame, most: int = FEATURES, least_z: float = LEAST_Z) -> dict[str, float]:
    """Features whose frequency differs between the classes beyond chance, with their z (positive: toxic)."""
    def run(batches: Iterable[pa.RecordBatch]):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    counts[toxic].update(features_of(words_of(text)).keys())
        names = [f for f in counts[0].keys() | counts[1].keys()]
        yield batch_of({"feature": pa.string(), "clean": pa.int64(), "toxic": pa.int64()}, {"feature": names, "clean": [counts[0][f] for f in names], "toxic": [counts[1][f] for f in names]})

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return {}
    counted = sample.mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic") + 1) / (clean + toxic + 2)
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(share * (1 - share) * (1 / clean + 1 / toxic))
    top = counted.where(f"clean + toxic >= {LEAST_TEXTS}").select("feature", z.alias("z")).where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "feature").limit(most)
    return {r["feature"]: r["z"] for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> OrdinalModel | None:
    """Fits severity grades 0 (not toxic), 1 and 2 from labels (doc_id, toxic).

    Labels name two classes only. The third grade is how toxic a text looks to a model that has not seen it: the sample is dealt into folds by
    text (equal texts share one), each is scored by a two-class fit on the others, and its toxic texts over the median score are grade 2. So grade 2 against 1 carries what
    labels of other texts say; the choice of features alone sees all folds. None if a class has no text: nothing is then toxic. Repeated labels
    count each; null ids or labels teach nothing.
    """
    sample = written(labelled_sample(docs, labels), "toxicity-sample")
    telling = telling_features(sample)
    if not telling:
        return None
    names = {f: i for i, f in enumerate(telling)}
    types = {"toxic": pa.int32(), "fold": pa.int32(), "features": pa.list_(pa.int32()), "counts": pa.list_(pa.int32())}

    def make():
        def work(batch):
            out: dict[str, list] = {k: [] for k in types}
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {names[f]: n for f, n in features_of(words_of(text)).items() if f in names}
                for k, v in zip(types, (toxic, zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS, list(own), list(own.values())), strict=True):
                    out[k].append(v)
            return batch_of(types, out)

        return work

    rows = map_batches(sample, make, "toxic int, fold int, features array<int>, counts array<int>").toArrow()
    toxic, fold = rows["toxic"].to_numpy(), rows["fold"].to_numpy()
    lists = rows["features"].combine_chunks()
    doc = np.repeat(np.arange(len(toxic)), lists.value_lengths().to_numpy(zero_copy_only=False))
    feature, value = lists.flatten().to_numpy(), np.minimum(rows["counts"].combine_chunks().flatten().to_numpy(), MOST_COUNTED).astype(float)
    grade = severity_grades(cross_fitted(doc, feature, value, toxic, fold, len(names)), toxic, fold)
    weights, thresholds = fit_cumulative_link(doc, feature, value, grade, len(names), GRADES)
    return OrdinalModel({f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-6}, thresholds)


TYPES = {"doc_id": pa.int64(), "p_toxic": pa.float64(), "expected_severity": pa.float64(), "grade": pa.int32()}
SCHEMA = "doc_id long, p_toxic double, expected_severity double, grade int"


def grader(model: OrdinalModel | None):
    """A function from texts to P(grade > k) for each k, in rows. A prefix counts at most MOST_COUNTED words, as in training."""
    def grade(texts: list[str | None]) -> np.ndarray:
        if model is None:
            return np.zeros((len(texts), GRADES - 1))
        scores, weights, known = np.zeros(len(texts)), model.weights, {}
        for i, text in enumerate(texts):
            heads: Counter = Counter()
            score = 0.0
            for w in words_of(text or ""):
                own = known.get(w)
                if own is None:
                    own = known[w] = tuple(f for f in (w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)) if f in weights)
                for f in own:
                    heads[f] += 1
                    if heads[f] <= MOST_COUNTED:
                        score += weights[f]
            scores[i] = score
        return model.above(scores)

    return grade


def grade_toxicity(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """Severity of each whole text: doc_id, p_toxic = P(grade > 0), expected_severity (0 to 2), grade (the likeliest).

    One row a row; null and empty texts score as texts without any telling word; a null doc_id is carried; further columns are ignored.
    """
    def make():
        grade = grader(model)

        def work(batch):
            above = grade(batch.column(1).to_pylist())
            chance = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            return batch_of(TYPES, {"doc_id": batch.column(0), "p_toxic": above[:, 0], "expected_severity": above.sum(axis=1), "grade": chance.argmax(axis=1).astype(np.int32)})

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, SCHEMA)


def without_toxic(docs: DataFrame, model: OrdinalModel | None, most: float = 0.5) -> DataFrame:
    """``docs`` without those whose P(grade > 0) exceeds ``most``; all columns, of any name, and clean rows stay as they were.

    Repeated rows share a grade; null and empty texts have no telling word and stay unless such texts are toxic; an empty table stays empty.
    """
    def make():
        grade = grader(model)

        def work(batch):
            keep = grade(batch.column(batch.schema.get_field_index("text")).to_pylist())[:, 0] <= most
            return batch.filter(pa.array(keep))

        return work

    return map_batches(docs, make, docs.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """Fits on the labels and grades all documents: :func:`grade_toxicity` and toxic, whether p_toxic exceeds ``most``."""
    return grade_toxicity(docs, fit(docs, labels)).withColumn("toxic", F.col("p_toxic") > most)
