import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fluxlake.llm import language, quality_model, toxicity
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def column(spark, name, *columns):
    return spark.read.parquet(f"{SF}/{name}.parquet").select(*columns)


def by_hand(text):
    """n-gram counts by string slices."""
    out = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        for n in (1, 2, 3):
            padded = f" {word} " if n > 1 else word
            for i in range(len(padded) - n + 1):
                gram = padded[i:i + n]
                # a three-letter stretch must have a letter in the middle, which padding guarantees
                out[gram] = out.get(gram, 0) + 1
    return out


def test_gram_counts_equal_string_slices(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "  ", "Ab ab. É", "日本語 と 한국어", "x1y", *("".join(rng.choice("abé .1\n") for _ in range(200)) for _ in range(20))]
    for chunk in (1 << 18, 16):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for text in texts:
            codes, counts = language.gram_counts(text)
            want = by_hand(text)
            # a space after a word and the one before the next are one character of the text
            assert sum(counts) == sum(n for g, n in want.items())
            assert len(codes) == len(want)
            assert sorted(counts.tolist()) == sorted(want.values())


def test_language_of_held_out_documents(spark):
    docs = column(spark, "documents", "doc_id", "text", "lang")
    got = {r.doc_id: r for r in language.languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(truth) and {i for i in got if got[i].held_out} == set(held)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_on_difficult_rows(spark):
    df = spark.createDataFrame(plain.messy_rows(), plain.DOCS)
    got = language.languages(df).collect()
    assert len(got) == len(plain.messy_rows())
    empty = [r for r in got if r.doc_id in (0, 1, 2)]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in empty)
    assert language.languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.languages(df.withColumn("lang", df["lang"].substr(9, 1)).filter("lang = 'x'")).collect()} == set()


def gram_code(gram):
    """The number that orders n-grams of equal counts: code points in 21 bits each, a space as 0, marked by length."""
    points = [0 if c == " " else ord(c) for c in gram]
    if len(points) == 1:
        return points[0]
    if len(points) == 2:
        return 1 << 42 | points[0] << 21 | points[1]
    return (points[0] << 42 | points[1] << 21 | points[2]) - 2**63


def plain_order(counts, length):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], gram_code(x[0])))][:length]


def plain_languages(rows, length):
    """(doc_id, held_out, lang_pred, score) by lists and slices."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    totals = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and fold(i) != 2:
            own = totals.setdefault(lang, {})
            for g, n in by_hand(text).items():
                own[g] = own.get(g, 0) + n
    profiles = {lang: plain_order(c, length) for lang, c in sorted(totals.items()) if c}
    out = []
    for i, text, _ in rows:
        own = plain_order(by_hand(text or ""), length)
        if not own or not profiles:
            out.append((i, fold(i) == 2, "und", 0.0))
            continue
        apart = {lang: sum(abs(p.index(g) - k) if g in p else length for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda x: (apart[x], x))
        out.append((i, fold(i) == 2, best, round(1 - apart[best] / (length * len(own)), 9)))
    return out


def language_rows():
    rng = random.Random(14)
    alphabets = {"aa": "abcde", "bb": "abcxyz", "cc": "éèàab", "dd": "дежз日本"}
    rows = []
    for i in range(160):
        lang = rng.choice(list(alphabets))
        words = ["".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))]
        rows.append((i, " ".join(words), lang if i % 9 else None))
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 .. 3", "cc"), (None, "abc abd", "aa"), (None, None, None), rows[4], rows[4]]
    return rows + [(r[0] + 1000 if r[0] is not None else None, r[1], None) for r in plain.messy_rows() if len(r[1] or "") < 10_000]


@pytest.mark.parametrize("length", [20, 300])
def test_ranks_profiles_and_distances_against_brute_force(spark, length):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language.languages(df, length=length).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_languages(rows, length)))


def test_discriminant_equals_dense_formula(spark):
    rng = np.random.default_rng(1)
    d = len(quality_model.FEATURES)
    x = rng.normal(size=(300, d)) * np.arange(1, d + 1)
    y = (np.arange(300) % 3 > 0).astype(int)
    x[y == 0] += 2
    stats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, stats array<double>").repartition(3)
    labels = spark.createDataFrame([*[(i, int(v), 0) for i, v in enumerate(y)], (7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(stats, labels, 0.2, 0.05)
    own = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)])
    pooled = sum(np.cov(x[own & (y == k)].T, bias=True) * (own & (y == k)).sum() for k in (0, 1)) / own.sum()
    logs = []
    for k in (0, 1):
        part = x[own & (y == k)]
        cov = 0.8 * np.cov(part.T, bias=True) + 0.2 * pooled
        cov = 0.95 * cov + 0.05 * np.trace(cov) / d * np.eye(d)
        gap = x - part.mean(axis=0)
        logs.append(np.log(len(part) / own.sum()) - 0.5 * np.linalg.slogdet(cov)[1]
                    - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-8)


def test_statistics_do_not_depend_on_the_batch(monkeypatch):
    texts = [r[1] for r in plain.messy_rows()]
    together = quality_model.statistics(pa.array(texts))
    monkeypatch.setattr(quality_model, "CHUNK", 50)
    assert np.allclose(together, quality_model.statistics(pa.array(texts)))
    assert np.allclose(together, np.concatenate([quality_model.statistics(pa.array([t], pa.string())) for t in texts]))
    one = quality_model.statistics(pa.array(["the the a a b\n"]))[0]
    assert np.isclose(one[0], np.log1p(5)) and np.isclose(one[-1], np.log(2.5 / 3.5))


def test_quality_of_held_out_documents(spark):
    docs, labels = column(spark, "documents", "doc_id", "text"), column(spark, "labels", "doc_id", "quality")
    got = {r.doc_id: r for r in quality_model.quality_scores(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert len(got) == docs.count() and np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert quality_model.keep_good(docs, labels).count() == sum(r.predicted for r in got.values())


def test_quality_on_difficult_rows(spark):
    df = spark.createDataFrame(plain.messy_rows(), plain.DOCS)
    for labels in ([], [(1, 1)], [(4, 1), (5, 0), (6, 1), (7, 0), (8, None), (None, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        got = quality_model.quality_scores(df, table).collect()
        assert len(got) == len(plain.messy_rows()) and all(0 <= r.score <= 1 for r in got)
        assert quality_model.keep_good(df, table).columns == df.columns
    assert quality_model.quality_scores(df.limit(0), table).count() == 0


def test_toxicity_of_held_out_documents(spark):
    docs, labels = column(spark, "documents", "doc_id", "text"), column(spark, "labels", "doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    clean = [got[i].toxic for i in truth if not truth[i]]
    foul = [got[i].toxic for i in truth if truth[i]]
    assert len(got) == docs.count() and np.mean(clean) < 0.01 and np.mean(foul) > 0.75
    assert all(0 <= r[f"p_{c}"] <= 1 for r in got.values() for c in toxicity.CATEGORIES)


def test_chain_feeds_earlier_categories_into_later_ones():
    rng = np.random.default_rng(2)
    x = (rng.random((600, 4)) < 0.4).astype(float)
    first = (x[:, 0] > 0).astype(float)
    last = ((x[:, 0] > 0) | (x[:, 1] > 0)).astype(float)
    weights = toxicity.fit_chain(x, np.column_stack([first, last]), np.arange(600) % toxicity.FOLDS)
    assert [len(w) for w in weights] == [5, 6]
    got = toxicity.Chain({}, weights).predict(x)
    assert np.mean((got > 0.5) == np.column_stack([first, last])) > 0.99


def test_toxicity_on_difficult_rows(spark):
    df = spark.createDataFrame(plain.messy_rows(), plain.DOCS)
    for labels in ([], [(1, 1)], [(4, 1), (5, 0), (6, 1), (7, 0), (8, None), (None, 1)]):
        got = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == len(plain.messy_rows())
    assert toxicity.toxicity(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


@pytest.mark.parametrize("ridge", [0.01, 1.0])
def test_logistic_converges_on_separable_rows(ridge):
    x = np.repeat([[0.0], [1.0]], 50, axis=0)
    w = toxicity.logistic(x, x[:, 0], ridge, steps=50)
    p = 1 / (1 + np.exp(-(x[:, 0] * w[0] + w[1])))
    assert np.all(np.isfinite(w)) and np.all((p > 0.5) == (x[:, 0] > 0))


def plain_words(text):
    words = {w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w}
    return words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}


def test_vocabulary_targets_and_chain_against_brute_force(spark):
    """Words, chi-square, targets and folds counted by hand; every probability follows from the same chain."""
    rng = random.Random(21)
    foul = [w for kind in toxicity.KINDS.values() for w in kind]
    texts = [" ".join(rng.choice(["plain", "words", "of", "Kindness", "über", "l'été", "x1y"]) for _ in range(rng.randrange(12))) for _ in range(240)]
    rows, labels = [], []
    for i, text in enumerate(texts):
        toxic = rng.random() < 0.3
        rows.append((i, f"{text} {rng.choice(foul).upper() if toxic and rng.random() < 0.8 else ''} {rng.choice(foul) if rng.random() < 0.05 else ''}"))
        if i % 7:
            labels.append((i, int(toxic)))
    rows += [(300, None), (301, ""), (302, "unlabelled idiot")]
    labels += [(300, 0), (999, 1), (5, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    texts = dict(rows)
    sample = [(i, t) for i, t in labels if t is not None and i in texts and zlib.crc32(str(i).encode()) % 5]
    words = {i: plain_words(texts[i]) for i, _ in sample}
    pos, n = sum(t for _, t in sample), len(sample)
    chi = {}
    for w in set().union(*words.values()):
        a = sum(t for i, t in sample if w in words[i])
        b = sum(1 - t for i, t in sample if w in words[i])
        chi[w] = (a * (n - pos - b) - b * (pos - a)) ** 2 / ((a + b) * (n - a - b) + 1)
    vocabulary = sorted(chi, key=lambda w: (-chi[w], w))[: toxicity.FEATURES]
    chain = toxicity.fit(docs, known)
    assert list(chain.vocabulary) == vocabulary
    sample.sort()
    present = np.array([[float(w in words[i]) for w in vocabulary] for i, _ in sample])
    targets = np.array([[float(t and bool(words[i] & set(kind))) for kind in toxicity.KINDS.values()] + [float(t)] for i, t in sample])
    fold = np.array([(i * 2654435761 >> 16) % toxicity.FOLDS for i, _ in sample])
    weights = toxicity.fit_chain(present, targets, fold)
    assert all(np.allclose(a, b) for a, b in zip(chain.weights, weights, strict=True))
    for r in toxicity.toxicity(docs, known).collect():
        x, z = np.array([float(w in plain_words(texts[r.doc_id])) for w in vocabulary]), []
        for w in weights:
            z.append(1 / (1 + math.exp(-(np.append(x, [math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4))) for p in z]) @ w[:-1] + w[-1]))))
        assert np.allclose([r[f"p_{c}"] for c in toxicity.CATEGORIES], z, atol=1e-9) and r.toxic == (z[-1] >= 0.5)
