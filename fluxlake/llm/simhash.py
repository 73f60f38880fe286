"""SimHash near-duplicate detection by bit-sliced comparison.

A document's fingerprint has a bit where over half of its shingles' XXH64 have it; shingles count as often as they
occur. Documents whose fingerprints differ in few bits (``RADIUS``) are linked, and links are closed into
components.

1. Only distinct fingerprints are compared. They are dealt by every choice of ``KEYS_OF`` of ``BLOCKS`` blocks of
   bits: two fingerprints that differ in at most two bits agree on two of four blocks at least, so they meet under
   a key of 32 bits.
2. A group of more than ``GROUP`` fingerprints under a key is dealt again by further blocks of the bits outside its
   key (of ``RADIUS + 1`` blocks one must agree), until it fits. As fingerprints are distinct, a group with few bits
   left is small, so this ends after three rounds at most, with no cap and no pair of a group given out.
3. Inside a task groups are held as bit planes: a word of a plane has one bit of 64 fingerprints. A fingerprint is
   compared with 64 others at once: the planes' differences are added up in carry-save counters, and a block of
   64 is abandoned once all of its distances exceed the radius. A group gives out a forest of its links.
4. Components are closed by alternating stars over fingerprints and named by their smallest doc_id.

Cases: fewer words than a shingle make one shingle of the whole sequence; texts without words and null texts have
fingerprint zero, which is linked like any other; a missing id is never a component's name unless all ids of it are
missing (then null); rows that repeat share a result. An empty table gives an empty result. Columns
other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import whole_text
from fluxlake.llm.components import components
from fluxlake.session import materialize

SHINGLE = 3
HASH_SEED = 42
RADIUS = 2
BITS = 64
BLOCKS, KEYS_OF = 4, 2
GROUP = 1024
CHUNK = 1 << 15
ITEMS = 1 << 14
TASK_BLOCKS = 1 << 12
ALL = np.uint64(2**64 - 1)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit majority over the hashes of all word shingles, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(width, len(words)) - 1:].tolist()
    sums = np.zeros(BITS, np.int64)
    for low in range(0, n, CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], HASH_SEED)
                           for a, b in zip(begins[low: low + CHUNK], stops[low: low + CHUNK], strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (64 bits, as a signed number) of every document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Arrow's values, one text at a time
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # bytes.lower and bytes.split change and split at ASCII only
    return docs.select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(rows, f"doc_id {kind}, print long")


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row w has the 64 planes of 64 fingerprints, whose lanes are a word's bits."""
    n = -(-len(prints) // 64)
    padded = np.zeros(n * 64, "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 64, 8), axis=2, bitorder="little")
    turned = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(turned).reshape(n, 64 * 8).view("<u8")


def close_lanes(query: np.ndarray, sliced: np.ndarray, lanes: np.ndarray, radius: int, step: int = 4) -> np.ndarray:
    """For query i and the 64 fingerprints of block ``sliced[i]``: a word with a bit per lane within the radius.

    ``lanes`` has the lanes in use. Counters are kept in carry-save form, a word per binary digit.
    """
    out = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    digits = max(1, radius.bit_length())
    counters = [np.zeros(len(query), np.uint64) for _ in range(digits)]
    over = ~lanes
    limit = [bool(radius >> k & 1) for k in range(digits)]
    for plane in range(BITS):
        bit = (query[live] >> np.uint64(plane)) & np.uint64(1)
        carry = sliced[live, plane] ^ (np.uint64(0) - bit)
        for k in range(digits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        # a counter above the radius, digit by digit from the highest
        above, equal = np.zeros_like(over), np.full_like(over, ALL)
        for k in reversed(range(digits)):
            if limit[k]:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        over |= above
        if plane % step == step - 1:
            stay = over != ALL
            if not stay.all():
                live, over, counters = live[stay], over[stay], [c[stay] for c in counters]
            if not len(live):
                return out
    out[live] = ~over
    return out


def close_pairs(prints: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of fingerprints of one group within the radius; groups lie one after another."""
    ends = np.cumsum(sizes)
    blocks = -(-sizes // 64)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    begins = ends - sizes
    # fingerprints in their blocks, group by group
    group = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(prints)) - begins[group]
    places = first_block[group] * 64 + inside
    spread = np.zeros(first_block[-1] * 64, np.uint64)
    spread[places] = prints
    origin = np.full(len(spread), -1, np.int64)
    origin[places] = np.arange(len(prints))
    sliced = planes(spread)
    used = np.packbits((origin >= 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    # a fingerprint meets its own block and the later ones of its group
    own = first_block[group] + inside // 64
    meets = first_block[group + 1] - own
    starts = np.concatenate(([0], np.cumsum(meets)))
    low = 0
    while low < len(prints):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + ITEMS, "right")) - 1)
        i = np.repeat(np.arange(low, high), meets[low:high])
        block = np.repeat(own[low:high], meets[low:high]) + np.arange(len(i)) - np.repeat(starts[low:high] - starts[low], meets[low:high])
        close = close_lanes(prints[i], sliced[block], used[block], radius)
        some = np.flatnonzero(close)
        lane = np.unpackbits(close[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(lane)
        j = origin[block[some[at]] * 64 + bit]
        later = j > i[some[at]]
        yield i[some[at]][later], j[later]
        low = high


def _forest(prints: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[list, list]:
    """Positions of links that connect what is close in each group, at most one fewer than its fingerprints."""
    root = np.arange(len(prints))
    u, v = [], []
    for left, right in close_pairs(prints, sizes, radius):
        while (root[root] != root).any():
            root = root[root]
        joins = np.unique(np.column_stack([root[left], root[right], left, right])[root[left] != root[right]], axis=0)
        for a, b, i, j in joins.tolist():
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                u.append(i)
                v.append(j)
    return u, v


def _forests(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the groups of a batch, TASK_BLOCKS blocks of 64 fingerprints at a time."""
    for batch in batches:
        lists = batch.column("prints")
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        blocks = np.cumsum(-(-sizes // 64))
        low = 0
        while low < len(sizes):
            before = blocks[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(blocks, before + TASK_BLOCKS, "right")))
            prints = lists[low:high].flatten().to_numpy().view(np.uint64)
            links = [pa.array(prints[at].view(np.int64)) for at in _forest(prints, sizes[low:high], radius)]
            yield pa.RecordBatch.from_arrays(links, names=["u", "v"])
            low = high


def _blocks(bits: list[int], parts: int) -> list[int]:
    """The bits in ``parts`` runs of about equal length, as masks."""
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def masks(taken: int | None, radius: int = RADIUS, blocks: int = BLOCKS, keys_of: int = KEYS_OF) -> list[int]:
    """Bits that fingerprints within the radius agree on under at least one mask, given those ``taken`` already."""
    if taken is None:
        parts = _blocks(list(range(BITS)), blocks)
        return [reduce(int.__or__, chosen) for chosen in combinations(parts, keys_of)]
    free = [b for b in range(BITS) if not taken >> b & 1]
    return [taken | part for part in _blocks(free, radius + 1)]


def _dealt(prints: DataFrame, found: Column) -> DataFrame:
    """A row per fingerprint and mask: the key is the mask and the bits under it."""
    return prints.select("print", F.explode(found).alias("mask")).withColumn("key", F.col("print").bitwiseAND(F.col("mask")))


def _later_masks(levels: list[list[int]], radius: int) -> tuple[Column, list[list[int]]]:
    """By the mask that a fingerprint has been dealt by: the masks of the next round."""
    cases, new = None, []
    for mask in levels[-1]:
        finer = masks(mask, radius)
        new += finer
        value = F.array(*[F.lit(_signed(m)) for m in finer])
        cases = F.when(F.col("mask") == _signed(mask), value) if cases is None else cases.when(F.col("mask") == _signed(mask), value)
    return cases, [*levels, sorted(set(new))]


def close_links(prints: DataFrame, radius: int = RADIUS, group: int = GROUP, blocks: int = BLOCKS,
                keys_of: int = KEYS_OF) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within the radius; ``prints`` has them in ``print``."""
    if blocks - keys_of < radius:
        raise ValueError("with so few free blocks two fingerprints within the radius may agree on no key")
    if group < 2**radius:
        raise ValueError("a group must have room for the fingerprints that differ in as many bits as the radius")
    levels = [masks(None, radius, blocks, keys_of)]
    found = F.array(*[F.lit(_signed(m)) for m in levels[0]])
    links, rest = [], _dealt(prints, found)
    while True:
        met = rest.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1").select(
            F.col("mask").alias("g_mask"), F.col("key").alias("g_key"), "n")
        rows = materialize(rest.join(met, (F.col("mask") == F.col("g_mask")) & (F.col("key") == F.col("g_key"))).select(
            "print", "mask", "key", "n"), "dealt")
        # 2 ** free fingerprints at most differ in so many free bits, so such a group fits
        groups = rows.filter(F.col("n") <= group).groupBy("mask", "key").agg(F.collect_list("print").alias("prints"))
        links.append(materialize(groups.select("prints").mapInArrow(
            partial(_forests, radius=radius), "u long, v long"), "links"))
        large = rows.filter(F.col("n") > group)
        if large.isEmpty():
            break
        finer, levels = _later_masks(levels, radius)
        # different keys lead to the same finer one: a fingerprint goes there once
        rest = large.select("print", F.explode(finer).alias("mask")).withColumn(
            "key", F.col("print").bitwiseAND(F.col("mask"))).distinct()
    return reduce(DataFrame.unionAll, links)


def simhash_groups(docs: DataFrame, radius: int = RADIUS, group: int = GROUP, blocks: int = BLOCKS,
                   keys_of: int = KEYS_OF) -> DataFrame:
    """One row per document: doc_id, fingerprint (hexadecimal), component_id, kept."""
    marks = materialize(fingerprints(docs), "prints")
    # copies share a fingerprint: one row for each, with its smallest id
    classes = materialize(marks.groupBy("print").agg(F.min("doc_id").alias("low")), "classes")
    closed = components(close_links(classes.select("print"), radius, group, blocks, keys_of))
    placed = classes.join(closed, F.col("print") == F.col("node"), "left").select(
        F.col("print").alias("c_print"), "low", F.coalesce("component", "print").alias("comp"))
    names = placed.groupBy("comp").agg(F.min("low").alias("component_id")).withColumnRenamed("comp", "n_comp")
    named = placed.join(names, F.col("comp") == F.col("n_comp")).select("c_print", "component_id")
    return marks.join(named, F.col("print") == F.col("c_print")).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
