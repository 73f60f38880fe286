"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

A document becomes logarithms and log-odds of counts over its whole text (bytes by class, words,
lines), computed for a batch of documents at once on the text buffer. Class means and covariances
come from sums of products over all labelled training rows, added up in Spark. Each covariance is
shrunk towards the pooled one and towards its diagonal mean; its Cholesky factor is inverted once and
cached with the model, so a score is a difference of Mahalanobis log densities plus the log prior,
through the logistic function.

Cases: null text is empty; an empty text has a defined statistic vector (all counts 0) and score. Labels
that are null or belong to no document are ignored, repeated labels count each. If a class has no
training row, every score is the share of label 1 (0.5 without rows). Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import remainder
from fluxlake.session import materialize

HELD_OUT = 5
THRESHOLD = 0.3
SHRINK_POOLED = 0.2
SHRINK_DIAGONAL = 0.05

# Byte classes; bytes of multi-byte characters count as letters.
OTHER, LOWER, UPPER, DIGIT, SPACE, LINE, STOP, SHOUT, SYMBOL, BAR, PUNCT = range(11)
N_CLASSES = 11


def _byte_classes() -> np.ndarray:
    out = np.full(256, PUNCT, np.uint8)
    for cls, chars in ((LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                       (DIGIT, b"0123456789"), (SPACE, b" \t\x0b\x0c\r"), (LINE, b"\n"), (STOP, b".,;:"),
                       (SHOUT, b"!?"), (SYMBOL, b"#*$%&<>@^~_=+\\{}[]"), (BAR, b"|")):
        out[list(chars)] = cls
    out[128:] = OTHER
    return out


CLASSES = _byte_classes()
PLACES = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64)
CHUNK = 1 << 19
FEATURES = ("length", "word_length", "upper", "digit", "stop", "shout", "symbol", "bar", "punct", "lines", "letters", "repeats")


def statistics(texts: pa.Array) -> np.ndarray:
    """Transformed statistics of every text of a string array, one row per text.

    Texts are taken together up to CHUNK bytes, so memory follows the longest text.
    """
    filled = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset: filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out, low = [np.empty((0, len(FEATURES)))], 0
    while low < len(filled):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        out.append(_statistics(raw[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]))
        low = high
    return np.concatenate(out)


def _statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    cls = CLASSES[raw]

    def per_text(flags: np.ndarray, at: np.ndarray = at) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[at[1:]] - total[at[:-1]]).astype(np.float64)

    counts = [per_text(cls == k) for k in range(N_CLASSES)]
    gap = (cls == SPACE) | (cls == LINE)
    starts = ~gap
    starts[1:] &= gap[:-1]
    firsts = at[:-1][at[1:] > at[:-1]]
    starts[firsts] = ~gap[firsts]
    words = per_text(starts)
    # a word that equals the one before it: compare sums of bytes, weighted by their place in the word
    begin = np.flatnonzero(starts)
    if len(begin):
        edges = np.concatenate(([0], begin, [len(raw)]))
        place = np.arange(len(raw)) - np.repeat(edges[:-1], np.diff(edges))
        weighted = np.where(gap, np.uint64(0), raw.astype(np.uint64) * PLACES[place % len(PLACES)])
        code = np.add.reduceat(weighted, begin)
        again = np.zeros(len(begin), bool)
        again[1:] = code[1:] == code[:-1]
        again[np.searchsorted(begin, at[:-1])[words > 0]] = False
        repeats = per_text(again, np.searchsorted(begin, at))
    else:
        repeats = np.zeros(len(words))
    size = (at[1:] - at[:-1]).astype(np.float64)
    filled_bytes = size - counts[SPACE] - counts[LINE]
    letters = counts[LOWER] + counts[UPPER] + counts[OTHER]

    def odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))

    return np.column_stack([
        np.log1p(words), np.log((filled_bytes + 1) / (words + 1)), odds(counts[UPPER], letters),
        odds(counts[DIGIT], filled_bytes), odds(counts[STOP], filled_bytes), odds(counts[SHOUT], filled_bytes),
        odds(counts[SYMBOL], filled_bytes), odds(counts[BAR], filled_bytes), odds(counts[PUNCT], filled_bytes),
        np.log((counts[LINE] + 1) / (words + 1)), odds(letters, filled_bytes), odds(repeats, words)])


class Discriminant(NamedTuple):
    """Per class 0 and 1: mean, inverse Cholesky factor, log density constant with the log prior."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.factors):
            return np.full(len(x), self.share)
        logs = [c - 0.5 * np.square((x - m) @ w.T).sum(axis=1)
                for m, w, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "stats"])


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _profile, "doc_id long, stats array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of a partition: rows, sums, and sums of products."""
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column("stats").flatten().to_numpy().reshape(-1, d)
        y = batch.column("quality").to_numpy()
        for k in (0, 1):
            part = x[y == k]
            sums[k] += np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).ravel()))
    at = np.tile(np.arange(sums.shape[1], dtype=np.int32), 2)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array([0, 1], np.int32), sums.shape[1])), pa.array(at), pa.array(sums.ravel())],
        names=["quality", "at", "value"])


def fit(stats: DataFrame, labels: DataFrame, shrink_pooled: float = SHRINK_POOLED,
        shrink_diagonal: float = SHRINK_DIAGONAL) -> Discriminant:
    """Class densities from all labelled rows outside the held-out fold."""
    known = labels.filter(F.col("quality").isin(0, 1) & (remainder("doc_id", HELD_OUT) != 0)).select(
        F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    rows = stats.join(known, F.col("doc_id") == F.col("label_id")).select("quality", "stats")
    # a fixed number of sums, whatever the input: two classes of 1 + d + d * d values
    added = rows.mapInArrow(_moments, "quality int, at int, value double").groupBy("quality", "at").agg(
        F.sum("value").alias("value")).collect()
    d = len(FEATURES)
    flat = np.zeros((2, 1 + d + d * d))
    for row in added:
        flat[row["quality"], row["at"]] = row["value"]
    n = flat[:, 0]
    if n.min() == 0:
        share = float(n[1] / n.sum()) if n.sum() else 0.5
        return Discriminant(np.empty((0, d)), np.empty((0, d, d)), np.empty(0), share)
    means = flat[:, 1: 1 + d] / n[:, None]
    scatter = flat[:, 1 + d:].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    factors, constants = [], []
    for k in (0, 1):
        cov = (1 - shrink_pooled) * scatter[k] / n[k] + shrink_pooled * pooled
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        chol = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(chol))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(chol)).sum())
    return Discriminant(means, np.stack(factors), np.array(constants), float(n[1] / n.sum()))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = materialize(profiles(docs), "statistics")
    model = fit(stats, labels)

    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows.to_list())) if len(rows) else [], dtype="float64")

    scored = stats.select("doc_id", F.pandas_udf(score, "double")("stats").alias("score"))
    return scored.select(
        "doc_id", (remainder("doc_id", HELD_OUT) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with the columns of ``docs``."""
    training = docs.filter(remainder("doc_id", HELD_OUT) != 0)
    model = fit(profiles(training), labels)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(model.score(statistics(texts)) >= threshold))

    return docs.mapInArrow(good, docs.schema)
