"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models. Each later model also gets the earlier categories'
probabilities; in training these are out-of-fold predictions, so a later model learns from probabilities as wrong as
those it will meet.

The models see which of a few hundred features a text has: words without their punctuation, prefixes of words, and runs
of symbols. Features are chosen by how far their share of documents differs between the classes. The fit takes a sample
of labelled rows, at most `most_rows` of each class of the last category by hash of the doc_id; that bound is a
parameter. The scoring takes all rows and whole texts.

A null or empty text has no features. Rows with a null label don't train. Without labelled rows of both classes a
category's probability is its share among them, or 0 without any, so nothing is rejected for it. A row for each row,
repeated ones too; an empty table gives none. drop_toxic gives back all columns, score_chain only doc_id and its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, save
from .words import Memo, slices

_EDGE = re.compile(r"[\W_]+")
_RUN = re.compile(r"([^\w\s])\1+")


def features_of(word: str) -> list[str]:
    """Features of a lower-cased word: itself, its prefixes of 4 to 6 letters, and the kinds of its symbol runs."""
    core = _EDGE.sub("", word)
    out = [f"w:{core}"] if core else []
    out += [f"{k}:{core[:k]}" for k in (4, 5, 6) if len(core) >= k]
    return out + [f"r:{m[1]}" for m in _RUN.finditer(word)]


@dataclass
class Chain:
    """A fitted chain: features by name, and each category's weights (over features, then earlier categories) and bias."""

    categories: list[str]
    features: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)

    def probabilities(self, has: np.ndarray) -> list[float]:
        """has: the numbers of the features that a text has."""
        n, found = len(self.features), []
        for w, b in zip(self.weights, self.biases, strict=True):
            z = b + w[has].sum() + (w[n:] @ np.array(found) if found else 0.0)
            found.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return found


def _fit(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 on all weights but the bias, by accelerated gradient steps in 32 bits."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(x.shape[1]), -40.0 if share == 0 else 40.0
    a = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y = y.astype(np.float32)
    l2 = np.full(a.shape[1], penalty, np.float32)
    l2[-1] = 1e-3
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = a.T @ (a @ v)
        size = float(np.linalg.norm(v))
        v /= size
    rate = 1 / (0.25 * size * 1.05 + penalty)
    w, ahead, t = np.zeros_like(v), np.zeros_like(v), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -40, 40)))
        slope = a.T @ (p - y) + l2 * ahead
        new = ahead - rate * slope
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / after * (new - w)
        done = float(np.abs(new - w).max()) < 1e-5
        w, t = new, after
        if done:
            break
    return w[:-1].astype(np.float64), float(w[-1])


def _count_features(categories: list[str], most: int = 200_000):
    """Per task: documents that have a feature, and of them those of each category."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}

        def out():
            names = list(counts)
            table = np.array([counts[k] for k in names]).reshape(len(names), len(categories) + 1)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(table[:, j].astype(np.int64)) for j in range(table.shape[1])]], names=["feature", "n", *categories])

        memo = Memo(features_of)
        for batch in (part for whole in batches for part in slices(whole)):
            labels = np.array([batch.column(c).to_pylist() for c in categories], np.int64).T.reshape(batch.num_rows, len(categories))
            for text, label in zip(batch.column("text").to_pylist(), labels, strict=True):
                memo.trim()
                row = np.concatenate([[1], label])
                for name in set().union(*map(memo.__getitem__, set((text or "").lower().split()))):
                    if name in counts:
                        counts[name] += row
                    else:
                        counts[name] = row.copy()
                if len(counts) > most:
                    yield out()
        yield out()

    return run


def _has(features: dict[str, int], text: str | None, memo: Memo) -> np.ndarray:
    memo.trim()
    found = [x for x in map(memo.__getitem__, set((text or "").lower().split())) if x]
    return np.array(sorted(set().union(*found)), np.int64) if found else np.empty(0, np.int64)


def _memo(features: dict[str, int]) -> Memo:
    return Memo(lambda word: tuple(features[f] for f in features_of(word) if f in features))


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: list[str], most_rows: int = 4000, per_category: int = 350, least_docs: int = 3, folds: int = 4, penalty: float = 0.3
) -> Chain:
    """docs: doc_id, text. labels: doc_id and a 0/1 column for each category, in the chain's order."""
    last = categories[-1]
    sound = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).dropna().dropDuplicates(["doc_id"])
    picked = None
    for value in (0, 1):
        some = sound.where(F.col(last) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
        picked = some if picked is None else picked.unionAll(some)
    picked = docs.sparkSession.createDataFrame(picked.collect(), picked.schema)  # 2 * most_rows rows of numbers at most
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    counted = sample.select("text", *categories).mapInArrow(_count_features(categories), "feature string, n long, " + ", ".join(f"`{c}` long" for c in categories))
    counted = counted.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in categories]).where(F.col("n") >= least_docs)
    counted = save(counted, "features")  # each category reads it
    sums = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    chain = Chain(categories)
    for c in categories:
        total, ones = sums["n"] or 0, sums[c] or 0
        if not 0 < ones < total:
            continue
        share, rest = F.col(c) / ones, (F.col("n") - F.col(c)) / (total - ones)
        spread = F.sqrt(F.col("n") / total * (1 - F.col("n") / total) + 1e-9)
        for row in counted.orderBy(((share - rest) / spread).desc(), "feature").limit(per_category).select("feature").collect():
            chain.features.setdefault(row["feature"], len(chain.features))
    names = dict(chain.features)
    drop(counted)

    def present(batches):
        memo = _memo(names)
        for batch in (part for whole in batches for part in slices(whole)):
            has = [_has(names, x, memo) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.list_(pa.int64())), *[batch.column(c) for c in categories]], names=["has", *categories])

    rows = sample.select("doc_id", "text", *categories).orderBy("doc_id").drop("doc_id").mapInArrow(present, "has array<long>, " + ", ".join(f"`{c}` int" for c in categories)).collect()
    x = np.zeros((len(rows), len(names) + len(categories)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["has"]] = 1
    fold = np.arange(len(rows)) % folds
    for j, c in enumerate(categories):
        y = np.array([r[c] for r in rows], np.float64)
        width = len(names) + j
        w, b = _fit(x[:, :width], y, penalty)
        chain.weights.append(w)
        chain.biases.append(b)
        if j + 1 < len(categories):  # what later models train on
            for k in range(folds):
                w, b = _fit(x[fold != k, :width], y[fold != k], penalty)
                x[fold == k, width] = 1 / (1 + np.exp(-np.clip(x[fold == k, :width] @ w + b, -40, 40)))
    return chain


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> for each category, a row for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        memo = _memo(chain.features)
        for batch in (part for whole in batches for part in slices(whole)):
            found = [chain.probabilities(_has(chain.features, x, memo)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[j] for r in found], pa.float64()) for j in range(len(chain.categories))]], names=["doc_id", *[f"p_{c}" for c in chain.categories]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"`p_{c}` double" for c in chain.categories))


#: The chain's order: what is wrong with a text at all helps to tell what is toxic.
CATEGORIES = ["low_quality", "flagged", "toxic"]


def chain_labels(labels: DataFrame) -> DataFrame:
    """The chain's 0/1 columns from a table of doc_id, quality and toxic."""
    low, toxic = (F.col("quality") == 0), (F.col("toxic") == 1)
    return labels.select("doc_id", low.cast("int").alias("low_quality"), (low | toxic).cast("int").alias("flagged"), toxic.cast("int").alias("toxic"))


def judge_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, the probabilities, and toxic: the last category's probability reaches the threshold."""
    scored = score_chain(docs, chain)
    return scored.withColumn("toxic", F.col(f"p_{chain.categories[-1]}") >= threshold)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """docs, with all its columns, without the rows that judge_toxicity calls toxic."""

    def run(batches):
        memo = _memo(chain.features)
        for batch in (part for whole in batches for part in slices(whole)):
            keep = [chain.probabilities(_has(chain.features, x, memo))[-1] < threshold for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
