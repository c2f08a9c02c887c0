"""Toxicity: a word classifier with counterfactual regularisation.

A logistic model over the presence of words and of word beginnings is fitted on a bounded sample of labelled
documents. Those whose class frequencies differ significantly (by the likelihood ratio) are features. For every sampled document that names a group, the document with that term swapped for each other term of
its family is the counterfactual: its features are taken anew, and the squared change of the score's logit over all
features that differ is penalised, so naming a group moves the score as little as the data allow.

Null and empty texts get the score of a document without any known word. Labels that are null are not
learned from; repeated labels of a document count as often as they stand there. Ids that are null count as held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import chosen, cut, held_out

#: Bound of the fitting sample in documents, least documents of a feature, significance in standard errors, L2
#: strength, counterfactual strength. The features are some of the sample's words, so the sample bounds them too.
SAMPLE, LEAST, SIGNIFICANT, RIDGE, COUNTERFACTUAL = 8000, 8, 5.0, 0.05, 10.0
#: Lengths of word beginnings that are features: insults are often built from a common stem.
STARTS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")

# Identity terms by family; swaps stay inside a family.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["old", "young", "elderly", "disabled", "deaf", "blind"],
]


FAMILY = {w: family for family in IDENTITY for w in family}


def beginnings(word: str) -> list[str]:
    return [f"^{word[:k]}" for k in STARTS if len(word) > k]


def features(text: str | None, known: frozenset | None = None) -> set[str]:
    """Words, word beginnings (marked ^) and beginnings that two or three different words share (marked ^^, ^^^); only known ones if given."""
    return _of_words(set(_WORD.findall((text or "").lower())), known)


def _of_words(found: set[str], known: frozenset | None = None) -> set[str]:
    starts = Counter(p for w in found for p in beginnings(w))
    out = found.union("^" * i + p for p, n in starts.items() for i in range(min(n, 3)) if known is None or p in known or f"^{p}" in known or f"^^{p}" in known)
    return out if known is None else out & known


def swaps(text: str | None, known: frozenset) -> list[tuple[set[str], set[str]]]:
    """(features lost, features gained) for each term of the text swapped for each other one of its family."""
    found = set(_WORD.findall((text or "").lower()))
    out = []
    for term in sorted(found & FAMILY.keys()):
        for other in FAMILY[term]:
            if other != term:
                # only features of words that share a beginning with either can differ
                touched = {*beginnings(term), *beginnings(other)}
                near = {w for w in found if w in (term, other) or touched.intersection(beginnings(w))}
                old, new = _of_words(near, known), _of_words((near - {term}) | {other}, known)
                out.append((old - new, new - old))
    return out


class Model:
    """Weights by feature, and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, frozenset(weights)

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[w] for w in features(text, self.known))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Sparse:
    """Rows of (place, value) pairs; products with a vector from both sides."""

    def __init__(self, rows: list[list[tuple[int, float]]], width: int):
        self.shape = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([k for r in rows for k, _ in r], np.int64)
        self.value = np.array([v for r in rows for _, v in r], float)

    def dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * x[self.col], self.shape[0])

    def back(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * y[self.row], self.shape[1])


def _solve(product, right: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Conjugate gradients with a diagonal scaling, for a positive matrix given by its product."""
    x, left = np.zeros_like(right), right.copy()
    z = left / scale
    way, size = z.copy(), left @ z
    for _ in range(4 * len(right)):
        if size <= 1e-20 * max(1e-30, right @ (right / scale)):
            break
        y = product(way)
        step = size / (way @ y)
        x += step * way
        left -= step * y
        z = left / scale
        size, before = left @ z, size
        way = z + size / before * way
    return x


def fit(bags: list[list[int]], labels: list[int], keep: list[str], changes: list[tuple[list[int], list[int], float]]) -> Model:
    """Newton steps on the penalised likelihood; bags hold places in keep.

    changes holds (places lost, places gained, times) of the swaps. No row or a single class gives a constant score.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0 if not len(y) else (5.0 if y[0] else -5.0))
    size = len(keep) + 1
    x = Sparse([[(k, 1.0) for k in bag] + [(size - 1, 1.0)] for bag in bags], size)
    swap = Sparse([[(k, -1.0) for k in lost] + [(k, 1.0) for k in gained] for lost, gained, _ in changes], size)
    strength = COUNTERFACTUAL * np.array([n for *_, n in changes], float)
    ridge = np.append(np.full(size - 1, RIDGE), 1e-6)
    beta = np.zeros(size)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x.dot(beta), -30, 30)))
        slope = x.back(y - p) - ridge * beta - swap.back(strength * swap.dot(beta))
        weight = p * (1 - p)
        curve = lambda v: x.back(weight * x.dot(v)) + ridge * v + swap.back(strength * swap.dot(v))  # noqa: B023, E731
        diagonal = x.back(weight) + ridge + np.bincount(swap.col, strength[swap.row], size)
        step = _solve(curve, slope, diagonal)
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    return Model({w: float(beta[i]) for i, w in enumerate(keep)}, float(beta[-1]))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words_col(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(features(t.as_py())) for t in texts], pa.list_(pa.string()))


def _places_col(keep: list[str]):
    at, known = {w: i for i, w in enumerate(keep)}, frozenset(keep)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(at[w] for w in features(t.as_py(), known)) for t in texts], pa.list_(pa.int32()))

    return places


def _swaps_col(keep: list[str]):
    at, known = {w: i for i, w in enumerate(keep)}, frozenset(keep)
    kind = T.StructType().add("lost", T.ArrayType(T.IntegerType())).add("gained", T.ArrayType(T.IntegerType()))

    @F.arrow_udf(T.ArrayType(kind))
    def changes(texts: pa.Array) -> pa.Array:
        row = lambda t: [{"lost": sorted(at[w] for w in a), "gained": sorted(at[w] for w in b)} for a, b in swaps(t, known) if a or b]
        return pa.array([row(t.as_py()) for t in texts], pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))])))

    return changes


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on about SAMPLE labelled documents at most, chosen by a hash of the id at the rate that gives that many.

    Words are counted by class in Spark, and swaps by the features that they change; the driver gets the significant
    words, each sampled document's places among them, and the distinct changes.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(~held_out(F.col("doc_id")))
    known = labels.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    own = chosen(F.col("doc_id"), SAMPLE / max(1, known.count()))
    sample = cut(d.where(own).join(known.where(own), "doc_id").select("doc_id", "text", "toxic"))
    n1, n = (int(v or 0) for v in sample.agg(F.sum("toxic"), F.count("*")).first())
    counts = sample.select("toxic", F.explode(_words_col("text")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("n") >= LEAST)
    # both classes' documents with and without the word, each against its expected number
    a, c = F.col("a"), F.col("n")
    cells = [(a, n1 * c / n), (c - a, (n - n1) * c / n), (n1 - a, n1 * (n - c) / n), (n - n1 - c + a, (n - n1) * (n - c) / n)] if n else []
    likelihood = sum((F.when(seen > 0, seen * F.log(seen / usual)).otherwise(0.0) for seen, usual in cells), F.lit(0.0))
    best = counts.where(2 * likelihood >= SIGNIFICANT**2).select("word").collect()
    keep = sorted(r.word for r in best)
    rows = sample.select("doc_id", "toxic", _places_col(keep)("text").alias("places")).orderBy("doc_id", "toxic").collect()
    swapped = sample.select(F.explode(_swaps_col(keep)("text")).alias("s")).groupBy("s.lost", "s.gained").agg(F.count("*").alias("n")).orderBy("lost", "gained").collect()
    return fit([r.places for r in rows], [r.toxic for r in rows], keep, [(r.lost, r.gained, r.n) for r in swapped])


def scorer(model: Model):
    """A column function text -> score; the model is a few thousand words at most."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = scorer(train(docs, labels, id_col, text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
