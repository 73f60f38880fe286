"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is read field by field; from it the backend gets its normaliser, the
space mark, byte fallback, and either unigram scores or, for BPE models, the merge list that the
scores imply. Texts are cut at spaces where no piece reaches across one, each worker
encodes a batch's new words in one multithreaded call and remembers short words, up to a bound.

One rule of SentencePiece BPE has no form as a merge list: pieces of spaces alone share one score, and
equal scores merge from the left. Runs of spaces are therefore merged by :func:`_space_pieces`. A run
gives its last space to the next word unless the word leaves it alone.

:func:`parity` compares ids and decoded texts with the SentencePiece library itself.

A run of spaces takes time in proportion to its length. Models with user-defined pieces are refused.

Cases: null text is empty and has no ids; the space mark in a text is a space, as in SentencePiece.
Rows that repeat count each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6  # piece types
UNIGRAM, BPE = 1, 2  # model types
REMEMBERED = 300_000
REMEMBERED_CHARS = 64
THREADS = 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, message[at: at + size]
        at += size


class Model:
    """Pieces and settings of a SentencePiece model file."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode("utf-8"), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.add_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or not normaliser.get(5, 1):
            raise ValueError("only unigram and BPE models with escaped spaces are supported")
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def backend(self):
        """The tokenizers object: model, normaliser and decoder."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            # control pieces keep their ids and match no text
            shown = [(f"{MARK}\0{i}" if kind == CONTROL else p, s) for i, (p, s, kind) in enumerate(self.pieces)]
            model = models.Unigram(shown, self.unknown, self.byte_fallback)
        else:
            normal = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
            merges = []
            for piece, i in normal.items():
                merges += [(-self.pieces[i][1], i, k, piece[:k], piece[k:]) for k in range(1, len(piece))
                           if piece[:k] in normal and piece[k:] in normal]
            merges.sort()
            model = models.BPE(
                vocab={p: i for i, (p, _, _) in enumerate(self.pieces)}, merges=[m[3:] for m in merges],
                unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        if self.charsmap:
            out.normalizer = normalizers.Precompiled(self.charsmap)
        out.decoder = decoders.Sequence([
            decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
            *([decoders.Strip(" ", 1, 0)] if self.add_prefix else [])])
        return out


@lru_cache(maxsize=4096)
def _space_pieces(n: int, lengths: frozenset[int]) -> tuple[int, ...]:
    """Lengths of the pieces of a run of ``n`` spaces: the leftmost mergeable pair merges first.

    What stands left of the single spaces never has a mergeable pair but at its end, so a stack does.
    """
    done: list[int] = []
    for _ in range(n):
        done.append(1)
        while len(done) > 1 and done[-2] + done[-1] in lengths:
            last = done.pop()
            done[-1] += last
    return tuple(done)


class Encoder:
    """Encodes and decodes lists of texts."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.model = Model(file.read())
        self.tokenizer = self.model.backend()
        across = re.compile(f"[^{MARK}]{MARK}")
        pieces = [p for p, _, kind in self.model.pieces if kind == NORMAL]
        self.cuts = self.model.kind == BPE and not any(map(across.search, pieces))
        ids = {p: i for i, (p, _, _) in enumerate(self.model.pieces)}
        self.mark = ids.get(MARK)
        self.cuts &= self.mark is not None
        self.spaces = {len(p): ids[p] for p in pieces if p and not p.strip(MARK)}
        self.words: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        """The text as the model sees it, spaces not yet marked."""
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return text.replace(MARK, " ")

    def _run(self, n: int) -> bytes:
        return np.array([self.spaces[k] for k in _space_pieces(n, frozenset(self.spaces))], np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.normalised(t) for t in texts]
        if not self.cuts:
            lead = MARK if self.model.add_prefix else ""
            got = self.tokenizer.encode_batch_fast(
                [lead + t.replace(" ", MARK) if t else "" for t in plain], add_special_tokens=False)
            return [np.array(e.ids, np.int32) for e in got]
        # every word but perhaps the first follows a space; an empty one stands between two spaces
        cut = [(t.split(" ") if self.model.add_prefix else (MARK + t).split(" ")) if t else [] for t in plain]
        fresh = list(set().union(*cut) - self.words.keys() - {""})
        known = self.words
        got = self.tokenizer.encode_batch_fast(
            [w[1:] if w[0] == MARK else MARK + w for w in fresh], add_special_tokens=False)
        known.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(fresh, got, strict=True))
        out = [np.frombuffer(self._joined(words), np.int32) for words in cut]
        if len(known) > REMEMBERED:
            known.clear()
        for word in fresh:
            if len(word) > REMEMBERED_CHARS:
                known.pop(word, None)
        return out

    def _joined(self, words: list[str]) -> bytes:
        known = self.words
        alone = np.int32(self.mark).tobytes()
        if "" not in words:
            return b"".join(map(known.__getitem__, words))
        parts, spaces = [], 0
        for word in words:
            if word in ("", MARK):
                spaces += word == ""
                continue
            ids = known[word]
            if spaces:
                # the word's own space joins the run where the word leaves it alone
                lone = word[0] != MARK and ids[:4] == alone
                parts.append(self._run(spaces + lone))
                ids = ids[4:] if lone else ids
                spaces = 0
            parts.append(ids)
        if spaces:
            parts.append(self._run(spaces))
        return b"".join(parts)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str, threads: int = THREADS) -> Encoder:
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    return Encoder(path)


def parity(texts: list[str], path: str) -> list[str]:
    """The texts on which ids or decoded text differ from the SentencePiece library's."""
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    own = encoder(path)
    ids = own.encode(texts)
    want = judge.encode(texts, num_threads=1)
    return [t for t, a, b, c in zip(texts, ids, want, own.decode(ids), strict=True)
            if a.tolist() != b or c != judge.decode(b)]


def _texts(column: pa.Array, rows: int = 200) -> Iterator[str]:
    for low in range(0, len(column), rows):
        yield from (t or "" for t in column.slice(low, rows).to_pylist())


def _groups(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def encoded(docs: DataFrame, path: str, group_chars: int = 1 << 18) -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, round_trip (decoding gives the normalised text).

    ``path`` is a model file that every worker has installed.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            low = 0
            # a slice of the batch at a time becomes Python strings
            for group in _groups(_texts(batch.column("text")), group_chars):
                ids = own.encode(group)
                back = own.decode(ids)
                want = [own.normalised(t) for t in group]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, len(group)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([a == b for a, b in zip(back, want, strict=True)], pa.bool_()),
                ], names=["doc_id", "ids", "n_tokens", "round_trip"])
                low += len(group)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")
