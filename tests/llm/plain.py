"""Plain Python versions of the operators, and small difficult tables."""

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " \
       "part string, kept_id string, n string, row string, id string, sha string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice('abcdefgh')}" for _ in range(n))


def messy_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join([*words[:20], *(f"z{i}" for i in range(100))])
    long = prose(rng, 30_000, 10**6)
    texts = [None, "", " \n\t", "one", "One", " o n e ", "one two three", base, base, " " + base + " ", near, far,
             long, long + " end", long[:-1] + "\x85", base.upper(), "é" * 70, "é" * 69 + "è", "a\x0bb", "ab", "日本 語"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[3], (None, "no id", None, None, None), (None, None, None, None, None)]
    return [(*r, "x", "x", "x", "x", "x", "x") for r in rows]


def exact(rows):
    """{(doc_id, text): (keep_id, group_size, sha256)}."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(WORD.findall(t or ""))].append((-len(t or ""), i is None, i or 0, i))
    return {key: (min(g)[3], len(g), hashlib.sha256(key.encode()).hexdigest()) for key, g in groups.items()}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near(rows):
    """{doc_id: component_id} over unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}
