"""Token counts of a byte-level BPE tokenizer by rank-synchronous array merging.

Texts are cut at added tokens and then into pre-tokens. The distinct new pre-tokens of a batch are
held as one ragged array of symbols. In a round every sequence looks up the ranks of its adjacent
pairs, finds its lowest, and merges all its occurrences from the left, all sequences at once;
sequences without a known pair drop out. What is left of a pre-token is its number of tokens. Each
worker remembers the counts of short pre-tokens, up to a bound.

The tokenizer file is a parameter. Only what the file's kind needs is read: vocabulary, merges, added
tokens; other kinds are refused.

Cases: null text is empty and has no token. Rows that repeat count each. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
REMEMBERED = 400_000
REMEMBERED_CHARS = 64
# Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONE_SPACE, RUN = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")
# Marks a stretch without a space before it, and an added token; a cut stretch starts with neither.
FIRST, ADDED = " ", "  "
NO_RANK = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Merger:
    """Counts tokens of pre-tokens; holds the merge table as sorted pair keys."""

    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        bpe, cut = spec["model"], spec["pre_tokenizer"]
        known = (bpe["type"] == "BPE" and cut["type"] == "ByteLevel" and cut.get("use_regex", True)
                 and not cut["add_prefix_space"] and spec["normalizer"] is None
                 and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        if not known:
            raise ValueError("only byte-level BPE files without normalizer are supported")
        vocab = bpe["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.bytes = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.pattern = regex.compile(PATTERN)
        added = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.counts: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merged_lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Tokens left in each non-empty byte sequence."""
        length = np.array([len(t) for t in tokens], np.int64)
        out = length.copy()
        symbols = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), length)
        while len(symbols) > 1:
            rank = self._ranks(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NO_RANK
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            per_symbol = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            hit = (rank == per_symbol) & (rank < NO_RANK)
            # of a run of overlapping pairs, the first, third, ... merge
            index = np.arange(len(hit))
            opened = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - opened) % 2 == 0
            symbols[hit] = self.made[rank[hit]]
            stay = ~np.append(False, hit[:-1])
            symbols, owner = symbols[stay], owner[stay]
            alive = np.repeat(lowest < NO_RANK, np.bincount(owner, minlength=len(tokens))[owner[np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))]])
            done = owner[~alive]
            if len(done):
                out[np.unique(done)] = np.bincount(done, minlength=len(tokens))[np.unique(done)]
            symbols, owner = symbols[alive], owner[alive]
        if len(symbols):
            out[owner] = 1
        return out

    def _pieces(self, text: str) -> list[str]:
        """Stretches whose pre-tokens don't depend on their surroundings.

        A cut is a single space between two characters that aren't white space; the space belongs to the
        stretch after it. Added tokens stand alone.
        """
        out = []
        for at, chunk in enumerate(self.added.split(text) if self.added and self.added.search(text) else [text]):
            if at:
                out.append(ADDED)
            if chunk:
                words = LONE_SPACE.split(chunk) if RUN.search(chunk) or chunk[0] == " " or chunk[-1] == " " else chunk.split(" ")
                out.append(FIRST + words[0])
                out += words[1:]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts = [self._pieces(t) for t in texts]
        fresh = set().union(*parts) - self.pieces.keys()
        found = {p: self.pattern.findall(p[1:] if p[0] == FIRST else " " + p) for p in fresh if p != ADDED}
        new = list(set().union(*found.values()) - self.counts.keys())
        lengths = self.merged_lengths([p.encode("utf-8", "surrogatepass") for p in new]).tolist() if new else []
        tokens = self.counts
        tokens.update(zip(new, lengths, strict=True))
        pieces = self.pieces
        pieces.update((p, sum(map(tokens.__getitem__, f))) for p, f in found.items())
        pieces[ADDED] = 1
        out = [sum(map(pieces.__getitem__, p)) for p in parts]
        for known in (tokens, pieces):
            if len(known) > REMEMBERED:
                known.clear()
            for p in [p for p in (new if known is tokens else fresh) if len(p) > REMEMBERED_CHARS]:
                known.pop(p, None)
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    with open(path, encoding="utf-8") as file:
        return Merger(file.read())


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, group_chars: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` is a tokenizer file that every worker has installed.
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = merger(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            counts, low = [], 0
            while low < len(texts):  # groups of bounded length
                high, chars = low, 0
                while high < len(texts) and (high == low or chars + len(texts[high]) <= group_chars):
                    chars += len(texts[high])
                    high += 1
                counts += own.count(texts[low:high])
                low = high
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": counts})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInPandas(counted, "doc_id string, n_bytes long, n_tokens long").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))
