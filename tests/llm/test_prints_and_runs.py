"""SimHash, importance resampling and fill-in-middle against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from fluxlake.llm import fill_middle, importance, simhash
from tests.llm import plain

RUN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
PAIR = "doc_id long, text string"


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(plain.messy_rows(), plain.DOCS).repartition(3)


def sorted_rows(rows):
    return sorted(str(tuple(r)) for r in rows)


# SimHash

def plain_print(text):
    words = plain.WORD.findall((text or "").translate(plain.LOWER))
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_simhash(rows, radius=2):
    prints = [plain_print(t) for _, t in rows]
    low = list(range(len(set(prints))))
    of = sorted(set(prints))
    changed = True
    near = [[k for k, q in enumerate(of) if (p ^ q).bit_count() <= radius] for p in of]
    while changed:
        changed = False
        for k, ks in enumerate(near):
            best = min(low[j] for j in ks)
            if best < low[k]:
                low[k], changed = best, True
    comp = {p: low[k] for k, p in enumerate(of)}
    names = collections.defaultdict(list)
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            names[comp[p]].append(i)
    return [(i, f"{p:016x}", min(names[comp[p]], default=None)) for (i, _), p in zip(rows, prints, strict=True)]


def test_simhash_on_difficult_rows(messy):
    rows = [(r[0], r[1]) for r in plain.messy_rows()]
    got = simhash.simhash_groups(messy).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted_rows(got) == sorted_rows(plain_simhash(rows))


def edited(rng, n, size=400, edits=3):
    """Texts that differ in a few words out of many, so that their fingerprints are close."""
    words = plain.prose(rng, size).split(" ")
    for i in range(n):
        copy = list(words)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(size)] = f"e{rng.randrange(9)}"
        yield i, " ".join(copy)


@pytest.mark.parametrize("group", [16, 1024])
def test_simhash_of_edited_copies_whatever_the_group_size(spark, group):
    rng = random.Random(12)
    rows = list(edited(rng, 110)) + [(1000 + i, plain.prose(rng, 30)) for i in range(50)]
    rows += [(2000, None), (2001, ""), (None, rows[3][1])]
    want = plain_simhash(rows)
    assert len({w[1] for w in want[:110]}) > 16 and len({w[2] for w in want[:110]}) < 60
    df = spark.createDataFrame(rows, PAIR).repartition(3)
    got = simhash.simhash_groups(df, group=group).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted_rows(got) == sorted_rows(want)


def test_links_of_prints_that_fill_one_key(spark):
    """All fingerprints agree on 48 bits: every key of the first round is one large group."""
    rng = random.Random(4)
    low = rng.sample(range(1 << 16), 700)
    prints = [(0xABCDEF << 40 | x) - 2**63 for x in low]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in prints], "print long"), group=64).collect()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        assert ((u ^ v) & (2**64 - 1)).bit_count() <= 2
        root[find(u)] = find(v)
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if ((p ^ q) & (2**64 - 1)).bit_count() <= 2:
                assert find(p) == find(q)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_pairs(radius):
    rng = random.Random(radius)
    sizes = np.array([2, 1, 130, 64, 65, 5])
    prints = []
    for _ in range(sizes.sum()):
        x = (1 << 63 | 77) if rng.random() < 0.5 else 12345
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    want, begin = set(), 0
    for size in sizes.tolist():
        span = range(begin, begin + size)
        want |= {(i, j) for i in span for j in span if i < j and (prints[i] ^ prints[j]).bit_count() <= radius}
        begin += size
    got = [p for a, b in simhash.close_pairs(np.array(prints, np.uint64), sizes, radius) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_masks_leave_no_pair_out():
    rng = random.Random(1)
    first = simhash.masks(None)
    for _ in range(500):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(3)))
        under = [m for m in first if not m & differ]
        assert under
        assert all(any(not n & differ for n in simhash.masks(m)) for m in under)
    with pytest.raises(ValueError):
        simhash.close_links(None, group=2)
    with pytest.raises(ValueError):
        simhash.close_links(None, blocks=3, keys_of=2)


# importance resampling

def runs(text, longest):
    words = RUN_WORD.findall((text or "").translate(plain.LOWER))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resampled(rows, target, n, longest, least, percent):
    known = [runs(t, longest) for _, t in rows]
    s = collections.Counter(c % n for _, cs in known for c in cs)
    t = collections.Counter(c % n for x in target for c in runs(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n))))
    out = []
    for (i, _), (words, cs) in zip(rows, known, strict=True):
        weight = sum(gain(c % n) for c in cs) // len(cs) if cs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(cs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("n", "longest", "least", "percent"), [(10_000, 1, 20, 10), (97, 3, 1, 40), (70_000, 2, 0, 100), (5, 1, 20, 0)])
def test_resampling_on_difficult_rows(spark, messy, n, longest, least, percent):
    rows = [(r[0], r[1]) for r in plain.messy_rows()]
    target = [None, "", "One two three", rows[7][1]]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resampled(messy, wanted, n, longest, least, percent).collect()
    want = plain_resampled(rows, target, n, longest, least, percent)
    # equal rows share everything but the rank, which any of them may take
    assert sorted_rows(r[:4] for r in got) == sorted_rows(r[:4] for r in want)
    assert sorted_rows((r[3], r[4]) for r in got if r[4]) == sorted_rows((r[3], r[4]) for r in want if r[4])
    assert [r for r in got if r[4] == 1] == [r for r in want if r[4] == 1] or percent == 0


def test_resampling_ranks_ties_by_id(spark):
    rows = [(i % 700, "same words " * 15) for i in range(1400)]
    df = spark.createDataFrame(rows, PAIR).repartition(7)
    got = importance.resampled(df, df.select("text"), percent=50).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 701))
    assert [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)


def test_pieces_of_a_long_text_and_composed_sums():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB é.<日\n\x00Z1 ") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["x" * 500, " ", "", "y " * 400]
    for limit in (32, 1 << 18):
        words, features, buckets = importance.run_buckets([t.encode() for t in texts], 997, 3, limit)
        at = 0
        for t, n, m in zip(texts, words, features, strict=True):
            assert (n, [c % 997 for c in runs(t, 3)[1]]) == (runs(t, 3)[0], buckets[at: at + m].tolist())
            at += m


# fill-in-middle

def plain_fill(i, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    code = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(code[k: k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return i, len(tokens), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return i, len(tokens), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def fill_rows():
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in plain.messy_rows()]
    rows += [(100 + i, "".join(rng.choice("ab é<>PSM日\n𝒳Z1") for _ in range(rng.randrange(14)))) for i in range(600)]
    return rows + [(5000, "has <S> inside"), (5001, "<P"), (5002, "<M>"), (5003, "é"), (5004, "S>x<P")]


def test_fill_in_middle_and_back(spark):
    rows = fill_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAIR + ", output string, form int").repartition(3)
    made = fill_middle.fill_in_middle(df)
    assert sorted_rows(made.collect()) == sorted_rows(plain_fill(*r) for r in rows)
    back = fill_middle.restored(made.drop("doc_id", "n")).select("restored").collect()
    assert sorted(r[0] for r in back) == sorted(t or "" for _, t in rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = fill_middle.fill_digests(df).collect()
    assert sorted_rows(got) == sorted_rows((*plain_fill(*r)[:5], digest(plain_fill(*r)[5]), digest(r[1] or "")) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_seed_of_fill_in_middle(spark):
    df = spark.createDataFrame([(i, f"some text {i}") for i in range(200)], PAIR)
    assert {r.form for r in fill_middle.fill_in_middle(df, "2", fill_middle.Rates(100, 0)).collect()} == {"psm"}
    assert {r.form for r in fill_middle.fill_in_middle(df, "2", fill_middle.Rates(0, 0)).collect()} == {"plain"}


def test_rotation_in_place():
    for n in range(9):
        for left in range(n + 1):
            block = bytearray(range(n))
            fill_middle.rotate(memoryview(block), left)
            assert block == bytearray([*range(left, n), *range(left)])


def test_new_operators_on_empty_tables(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert simhash.simhash_groups(empty).count() == 0
    assert importance.resampled(empty, empty.select("text")).count() == 0
    assert fill_middle.fill_digests(empty).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], PAIR)
    assert importance.resampled(one, empty.select("text"), percent=100).first()["rank"] == 1
