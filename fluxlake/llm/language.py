"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams (one to three characters; words lower-cased and padded
with one space) in order. A text's own list is compared with each language's profile by the
out-of-place distance: for each n-gram the difference of its ranks, or the list length where the
profile lacks it. The nearest language wins, equal distances by name; the score is one minus the
distance as a share of the largest possible.

Profiles are counted in Spark from at most SAMPLE training texts per language, about, chosen by a
hash of the id (a documented bound of the fit: n-gram ranks settle early). Every text is
predicted from all its characters. N-grams are counted as 64-bit codes in numpy, in chunks,
so memory does not grow with a text.

Cases: null texts and texts without a letter are ``und`` with score 0; without any training text all
are. Rows that repeat count each. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxlake.llm.common import remainder

LENGTH = 300
SAMPLE = 4000
FOLDS, HELD_OUT = 4, 2
CHUNK = 1 << 18
BITS = 21
ZERO = np.zeros(1, np.uint32)
UNDEFINED = "und"
# Marks of n = 2 and 3; without them " a" and "a" would share a code. Code points need 21 bits, so
# three fill 63: the mark of three is the sign.
TWO, THREE = np.int64(1 << 2 * BITS), np.int64(-(2**63))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one 0 for every stretch of other characters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate((ZERO, np.where(_letters()[points], points, ZERO), ZERO))
    return points[(points != 0) | np.append(True, points[:-1] != 0)]


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c, at = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams that stay within a padded word."""
    points = letters_of(text)
    codes, counts = [], []
    for low in range(0, len(points) - 1, CHUNK):
        # two more points, for the n-grams that begin in this chunk
        x = points[low: low + CHUNK + 2].astype(np.int64)
        own = min(CHUNK, len(points) - low)
        one, two = x[:own], ((x[:-1] << BITS) | x[1:])[:own]
        three = ((x[:-2] << 2 * BITS) | (x[1:-1] << BITS) | x[2:])[:own]
        parts = (one[one > 0], two[two > 0] | TWO, three[(x[1:-1] > 0)[:own]] | THREE)
        c, n = np.unique(np.concatenate(parts), return_counts=True)
        codes.append(c)
        counts.append(n)
    return _merged(codes, counts)


def ranked(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent codes, equal counts by code."""
    if len(codes) > length:  # all that can be among the first
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:length]


class Profiles(NamedTuple):
    languages: list[str]
    codes: np.ndarray   # all codes of any profile, sorted
    ranks: np.ndarray   # language x code, LENGTH where the profile lacks the code
    length: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNDEFINED, 0.0
        codes, counts = gram_counts(text)
        if not len(codes):
            return UNDEFINED, 0.0
        own = ranked(codes, counts, self.length)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        there = np.where(self.codes[at] == own, self.ranks[:, at], self.length)
        apart = np.where(there < self.length, np.abs(there - np.arange(len(own))), self.length).sum(axis=1)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (self.length * len(own)))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            held, chars = [], 0
            for k, text in enumerate(texts, 1):
                held.append(text)
                chars += len(text)
                if chars >= CHUNK or k == len(texts):
                    codes, counts = gram_counts("\n".join(held))
                    yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})
                    held, chars = [], 0


def fit(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE) -> Profiles:
    """Profiles from the training rows: lang and text present, outside the held-out fold."""
    known = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT)
    ).select("doc_id", "text", "lang")
    # the share of each language that leaves about ``sample`` texts, drawn by a hash of the id; one number
    # per language, as the profiles themselves are
    shares = {r["lang"]: min(1.0, sample / r["count"]) for r in known.groupBy("lang").count().collect()}
    if not shares:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64), length)
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    drawn = known.filter(draw < share)
    counts = drawn.select("lang", "text").mapInPandas(_counted, "lang string, code long, n long")
    summed = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = summed.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < length).toPandas()
    languages = sorted(rows["lang"].unique())
    codes = np.unique(rows["code"].to_numpy(np.int64))
    ranks = np.full((len(languages), len(codes)), length)
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        ranks[k, np.searchsorted(codes, own["code"].to_numpy(np.int64))] = own["rank"]
    return Profiles(languages, codes, ranks, length)


def languages(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    profiles = fit(docs, length, sample)

    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    guess = F.pandas_udf(predicted, "lang_pred string, score double")
    return docs.select("doc_id", guess("text").alias("guess")).select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "guess.lang_pred", "guess.score")
