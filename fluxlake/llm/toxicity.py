"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: each logistic model sees which words and beginnings of
words of a vocabulary a text holds, and the log-odds of all earlier categories. While training, these come from
out-of-fold predictions (models that did not see the row), so later models learn from inputs as
uncertain as they will meet. The kinds of abuse come first, ``toxic`` as labelled is last. A row's
kind is its label joined with a word of the kind's list; the models are free to use any word.

The chain is fitted on at most SAMPLE labelled rows, about, chosen by a hash of the id outside the
held-out fold (a documented bound of the fit). The vocabulary is the FEATURES words with the
largest chi-square against the label, counted in Spark; the driver gets, per sampled row, the
positions of its vocabulary words. Every text is predicted from all its words.

Cases: null and empty texts hold no word and have a defined probability; labels that are null or
belong to no document are ignored; a category without both values in training has its share as
probability. Rows that repeat count each. Empty tables give empty results. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import remainder
from fluxlake.session import materialize

SAMPLE = 8000
FEATURES = 256
FOLDS = 4
HELD_OUT = 5
THRESHOLD = 0.5
RIDGE = 1.0
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")

# Words that tell the kinds of abuse apart.
KINDS = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "contempt": ("pathetic", "worthless"),
    "revulsion": ("scum", "trash", "disgusting"),
}
CATEGORIES = (*KINDS, "toxic")


def features_of(text: str | None) -> set[str]:
    """The words of a text, and the beginnings of longer ones, marked with a star."""
    words = {m.group() for m in WORD.finditer((text or "").lower())}
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in PREFIXES))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic model, by Newton steps; the intercept is free."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    share = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:  # never uphill
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(before, 1.0):
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain(NamedTuple):
    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def predict(self, present: np.ndarray) -> np.ndarray:
        """Probabilities of the categories, one column each."""
        x, out = present, []
        for w in self.weights:
            out.append(_probability(x, w))
            x = np.column_stack([x, _logit(out[-1])])
        return np.column_stack(out)

    def present(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary)))
        for i, text in enumerate(texts):
            out[i, [self.vocabulary[w] for w in features_of(text) & self.vocabulary.keys()]] = 1
        return out


def fit_chain(present: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category, later ones trained on out-of-fold log-odds of earlier ones."""
    x, weights = present, []
    for k in range(targets.shape[1]):
        y = targets[:, k]
        unseen = np.empty(len(y))
        for f in range(FOLDS):
            own = fold == f
            unseen[own] = _probability(x[own], logistic(x[~own], y[~own]))
        weights.append(logistic(x, y))
        x = np.column_stack([x, _logit(unseen)])
    return weights


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"],
                            "words": [sorted(features_of(t)) for t in batch["text"]]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Chain:
    known = labels.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id", HELD_OUT) != 0)).select(
        F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    drawn = known.filter(draw < min(1.0, sample / max(n, 1)))
    rows = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")
    held = materialize(rows.mapInPandas(_word_rows, "doc_id long, toxic int, words array<string>"), "toxic-words")
    total = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    a, b = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    counted = held.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(a.alias("a"), b.alias("b"))
    pos, neg = float(total["pos"]), float(total["n"] - total["pos"])
    apart = F.col("a") * (neg - F.col("b")) - F.col("b") * (pos - F.col("a"))
    seen = F.col("a") + F.col("b")
    chi = apart * apart / (seen * (total["n"] - seen) + 1)
    top = counted.orderBy(chi.desc(), "word").limit(features).select("word").collect()
    vocabulary = {r["word"]: i for i, r in enumerate(top)}
    # per sampled row its label and the vocabulary words that it holds
    chosen = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    listed = F.array(*[F.lit(w) for kind in KINDS.values() for w in kind])
    got = held.select("doc_id", "toxic", F.array_intersect("words", chosen).alias("own"),
                      F.array_intersect("words", listed).alias("kinds")).orderBy("doc_id").toPandas()
    present = np.zeros((len(got), len(vocabulary)))
    targets = np.zeros((len(got), len(CATEGORIES)))
    for i, row in enumerate(got.itertuples()):
        present[i, [vocabulary[w] for w in row.own]] = 1
        targets[i] = [row.toxic and any(w in row.kinds for w in kind) for kind in KINDS.values()] + [row.toxic]
    fold = (got["doc_id"].to_numpy(np.int64) * 2654435761 >> 16) % FOLDS
    return Chain(vocabulary, fit_chain(present, targets, fold))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, a probability per category, and the verdict."""
    chain = fit(docs, labels, sample)

    def predicted(texts: pd.Series) -> pd.DataFrame:
        values = texts.tolist()
        parts = [chain.predict(chain.present(values[i: i + 1000])) for i in range(0, len(values), 1000)]
        return pd.DataFrame(np.concatenate(parts) if parts else np.empty((0, len(CATEGORIES))), columns=list(CATEGORIES))

    guess = F.pandas_udf(predicted, ", ".join(f"{c} double" for c in CATEGORIES))
    return docs.select("doc_id", guess("text").alias("guess")).select(
        "doc_id", (remainder("doc_id", HELD_OUT) == 0).alias("held_out"),
        *[F.col(f"guess.{c}").alias(f"p_{c}") for c in CATEGORIES],
        (F.col("guess.toxic") >= threshold).alias("toxic"))
