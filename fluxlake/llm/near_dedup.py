"""Near-duplicate detection: MinHash banding, verification, connected components.

A document's set holds its distinct shingles of five words (A-Z lower-cased), as 64-bit hashes of the
words; equal sets (128-bit fingerprint of the sorted hashes) form a class, numbered once, and only
classes go on. Each class has 240 universal hash minima in 48 bands of 5: two
sets at similarity 0.75 meet in no band with probability 2.3e-6.

1. In every bucket each class is paired with the bucket's smallest class, so a bucket of m classes
   gives m - 1 pairs. Pairs whose sizes or minima (estimate, five standard errors of slack) exclude
   the threshold go; the others are confirmed by the intersection of the full sets.
2. Confirmed links are closed into components by alternating stars.
3. Buckets whose classes beside the smallest still lie in several components are compared in blocks of
   at most about 2,048 classes and a million shingles against blocks, inside a task, on the minima;
   pairs across components that pass are confirmed as in 1. Blocks in which very many pass are
   compared on the full sets instead, in a task again, and give a forest of links. Nothing is
   capped: a large bucket has more pairs of blocks, not a larger one, and no step gives out the
   pairs of a group. Components are closed again over all links.

Cases: fewer than five words make one shingle of the whole sequence; texts without words and null
texts have an empty set and no link. Documents are rows by id and text: other texts under one id, and
texts without id, are documents of their own. A component is named by its smallest doc_id (a missing
one is the largest, and reports null); of several texts under that id the one with the smallest digest
is ``kept``. Rows that repeat id and text share a result, and :func:`drop_near_copies` passes one of
them on; rows without words all pass. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import SPACES, whole_text
from fluxlake.llm.components import components
from fluxlake.session import materialize

SHINGLE = 5
PERCENT = 75
BANDS = 48
ROWS = 5
BLOCK = 2048
BLOCK_SHINGLES = 1_000_000
CROWDED = 4
SEED = 20240229
NO_ID = 2**63 - 1
# five standard errors of the estimate at the threshold
SLACK = 5 * (0.75 * 0.25 / (BANDS * ROWS)) ** 0.5


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(codes) < width:
        return np.array([xxhash.xxh64_intdigest(codes.tobytes())], np.uint64)
    multipliers = np.random.default_rng(SEED).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = codes[: len(codes) - width + 1] * multipliers[0]
    for i in range(1, width):
        mixed ^= mixed >> np.uint64(29)
        mixed += codes[i: len(codes) - width + 1 + i] * multipliers[i]
        mixed *= multipliers[0]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def universal_hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` multiply-add hashes on 32 bits."""
    rng = np.random.default_rng(SEED + 1)
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 2**32, n, dtype=np.uint32))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Smallest hash of the set under each function; memory does not grow with the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), chunk):
        hashed = np.multiply.outer(a, x[i: i + chunk])
        hashed += b[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return low


def _signatures(batches: Iterator[pd.DataFrame], bands: int, rows: int) -> Iterator[pd.DataFrame]:
    a, b = universal_hashes(bands * rows)
    for batch in batches:
        out = []
        for text in batch["text"]:
            shingles = shingle_set(text)
            if not len(shingles):
                out.append((0, None, None, None))
                continue
            low = minima(shingles, a, b)
            keys = [xxhash.xxh64_intdigest(low[i * rows: (i + 1) * rows].tobytes(), seed=i) - 2**63 for i in range(bands)]
            out.append((len(shingles), xxhash.xxh128_digest(shingles.tobytes()), keys, (low >> 16).astype(np.uint16).tobytes()))
        yield pd.DataFrame(out, columns=["n_shingles", "print", "bands", "low"]).assign(
            doc_id=batch["doc_id"].to_numpy(np.int64), sha=batch["sha"].to_numpy())[
                ["doc_id", "sha", "n_shingles", "print", "bands", "low"]]


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t).view(np.int64) for t in batch["text"]]})


def _agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of equal minima."""
    return pd.Series([np.mean(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16))
                      for x, y in zip(left, right, strict=True)], dtype="float64")


def _block_pairs(group: pd.DataFrame, least: float, percent: int) -> pd.DataFrame:
    """Pairs of two blocks of a bucket in different components whose minima allow the threshold.

    Where they outnumber the classes by more than CROWDED, one row names the blocks instead.
    """
    low = np.stack([np.frombuffer(x, np.uint16) for x in group["low"]])
    node, comp = group["node"].to_numpy(), group["comp"].to_numpy()
    n, at = group["n_shingles"].to_numpy(), group["block"].to_numpy()
    first, second = np.flatnonzero(at == at.min()), np.flatnonzero(at == at.max())
    u, v, found = [], [], 0
    for i in first:
        j = second[(comp[second] != comp[i]) & (100 * np.minimum(n[second], n[i]) >= percent * np.maximum(n[second], n[i]))]
        if at.min() == at.max():
            j = j[j > i]
        j = j[(low[j] == low[i]).mean(axis=1) >= least] if len(j) else j
        found += len(j)
        if found > CROWDED * len(group):
            u, v = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
            break
        u.append(np.full(len(j), node[i]))
        v.append(node[j])
    return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)}, dtype=np.int64).assign(
        crowded=found > CROWDED * len(group), **{c: group[c].iloc[0] for c in ("bucket", "b1", "b2")})


def _block_links(group: pd.DataFrame, percent: int, columns: int = 4096) -> pd.DataFrame:
    """A forest of confirmed links between the components in two blocks, from the full sets."""
    sets = [np.asarray(x) for x in group["shingles"]]
    size = np.array([len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, column[-1] + 1, columns):
        part = slice(*np.searchsorted(column, (low, low + columns)))
        there = np.zeros((len(sets), columns), np.float32)
        there[owner[part], column[part] - low] = 1
        both += there @ there.T
    comp, node = group["comp"].to_numpy(), group["node"].to_numpy()
    close = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
    links, root = [], {}
    for i, j in np.argwhere(close & (comp[:, None] != comp[None, :])):
        a, b = comp[i], comp[j]
        while a in root:
            a = root[a]
        while b in root:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((node[i], node[j]))
    return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("u_node"), F.col("shingles").alias("u_set"))
    right = sets.select(F.col("node").alias("v_node"), F.col("shingles").alias("v_set"))
    both = F.size(F.array_intersect("u_set", "v_set")).cast("long")
    return (pairs.join(left, F.col("u") == F.col("u_node")).join(right, F.col("v") == F.col("v_node"))
            .filter(100 * both >= percent * (F.size("u_set") + F.size("v_set") - both)).select("u", "v").distinct())


def _keyed(docs: DataFrame, id_name: str, sha_name: str) -> DataFrame:
    """``docs`` with the id, a missing one as the largest, and the digest of the text."""
    return docs.withColumns({
        id_name: F.coalesce("doc_id", F.lit(NO_ID)).cast("long"), sha_name: F.unhex(F.sha2(whole_text().cast("binary"), 256))})


def _placed(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id (NO_ID where missing), sha of the text, n_shingles, component_id, kept."""
    ids = _keyed(docs.select("doc_id", "text"), "doc_id", "sha")
    marks = materialize(ids.select("doc_id", "sha", "text").mapInPandas(
        partial(_signatures, bands=bands, rows=rows),
        "doc_id long, sha binary, n_shingles long, print binary, bands array<long>, low binary"), "minima")
    filled = marks.filter("n_shingles > 0")
    # the number is written, so it stays; the first document stands for the class
    classes = materialize(
        filled.groupBy("print").agg(F.min(F.struct("doc_id", "sha")).alias("first"))
        .select("print", F.col("first.doc_id").alias("first_id"), F.col("first.sha").alias("first_sha"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = classes.select("node", "first_id", "first_sha")
    first = (F.col("doc_id") == F.col("first_id")) & (F.col("sha") == F.col("first_sha"))
    # one row per class with its minima
    nodes = filled.join(heads, first).select("node", "n_shingles", "bands", "low").dropDuplicates(["node"])

    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = (banded.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("first"), F.count("*").alias("n"))
               .filter("n > 1").select(F.col("bucket").alias("key"), F.col("first.node").alias("pivot"),
                                       F.col("first.n_shingles").alias("pivot_n")))
    met = materialize(banded.join(buckets, F.col("bucket") == F.col("key")).drop("key"), "buckets")
    pairs = (met.filter("node != pivot")
             .filter(100 * F.least("n_shingles", "pivot_n") >= percent * F.greatest("n_shingles", "pivot_n"))
             .select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct())

    # full sets and minima of the classes that share a bucket, once for both rounds
    sharing = met.select("node").distinct()
    lows = materialize(nodes.join(sharing, "node", "left_semi").select("node", "n_shingles", "low"), "lows")
    texts = ids.join(heads.join(sharing, "node"), first).dropDuplicates(["doc_id", "sha"])
    sets = materialize(texts.select("node", "text").mapInPandas(_sets, "node long, shingles array<long>"), "sets")

    agreement = F.pandas_udf(_agreement, "double")
    least = percent / 100 - SLACK
    left = lows.select(F.col("node").alias("u_node"), F.col("low").alias("u_low"))
    right = lows.select(F.col("node").alias("v_node"), F.col("low").alias("v_low"))
    likely = (pairs.join(left, F.col("u") == F.col("u_node")).join(right, F.col("v") == F.col("v_node"))
              .filter(agreement("u_low", "v_low") >= least).select("u", "v").distinct())
    links = materialize(_confirmed(likely, sets, percent), "links")
    closed = components(links)

    # classes beside the pivot, which has met all of them, in buckets that hold several components
    beside = met.filter("node != pivot").select("bucket", "node", "n_shingles").distinct()
    known = beside.join(closed.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    known = known.select("bucket", "node", "n_shingles", F.coalesce("component", "node").alias("comp"))
    mixed = (known.groupBy("bucket").agg(F.min("comp").alias("low_comp"), F.max("comp").alias("high_comp"), F.count("*").alias("n_nodes"),
                                          F.sum("n_shingles").alias("size"))
             .filter("low_comp != high_comp").select(F.col("bucket").alias("key"), F.greatest(
                 F.ceil(F.col("n_nodes") / block), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("long").alias("n_blocks")))
    blocked = known.join(mixed, F.col("bucket") == F.col("key")).select(
        "bucket", "node", "comp", "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).alias("block"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    faced = blocked.withColumn("other", other).select(
        "bucket", "node", "comp", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    place = ["bucket", "b1", "b2"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _block_pairs(group, least, percent)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        return _block_links(group, percent)

    found = materialize(faced.join(lows, "node").groupBy(*place).applyInPandas(
        compare, "u long, v long, crowded boolean, bucket long, b1 long, b2 long"), "pairs")
    more = _confirmed(found.filter("NOT crowded").select("u", "v").distinct(), sets, percent)
    crowds = found.filter("crowded").select(*place).distinct()
    dense = faced.join(crowds, place, "left_semi").join(sets, "node").groupBy(*place).applyInPandas(link, "u long, v long")
    more = materialize(more.unionAll(dense.distinct()), "links")
    final = components(links.unionAll(more)) if not more.isEmpty() else closed

    named = classes.join(final.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").select(
        "print", "first_id", "first_sha", F.coalesce("component", "node").alias("comp"))
    lead = named.groupBy("comp").agg(F.min(F.struct("first_id", "first_sha")).alias("lead"))
    led = named.join(lead.withColumnRenamed("comp", "l_comp"), F.col("comp") == F.col("l_comp")).select(
        F.col("print").alias("l_print"), "lead")
    out = filled.join(led, F.col("print") == F.col("l_print")).select(
        "doc_id", "sha", "n_shingles", F.col("lead.first_id").alias("component_id"),
        ((F.col("doc_id") == F.col("lead.first_id")) & (F.col("sha") == F.col("lead.first_sha"))).alias("kept"))
    alone = marks.filter("n_shingles = 0").select(
        "doc_id", "sha", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionAll(alone)


def near_groups(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    back = {c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("doc_id", "component_id")}
    return _placed(docs, percent, bands, rows, block).select(back["doc_id"], "n_shingles", back["component_id"], "kept")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of every group of near copies, with the columns of ``docs``.

    Rows are matched by id and digest, since ids may repeat or be missing; rows without words have no near copies.
    """
    kept = _placed(docs).filter("kept AND n_shingles > 0").select(
        F.col("doc_id").alias("kept_id"), F.col("sha").alias("kept_sha")).distinct()
    worded = F.length(F.trim(whole_text(), F.lit(SPACES))) > 0
    # the columns of docs in one, so that no name of theirs meets one of these
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = _keyed(docs.filter(worded).select("doc_id", "text", row), "id", "sha").select("id", "sha", "row")
    stays = (F.col("id") == F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    # the join has dealt the rows by these columns already
    once = marked.join(kept, stays, "left_semi").dropDuplicates(["id", "sha"])
    return once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionAll(docs.filter(~worded))
