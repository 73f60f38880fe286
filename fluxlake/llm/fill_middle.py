"""Fill-in-middle transformation by in-place block rotation.

A text is cut twice at token borders (a run of letters A-Z a-z, or any other single character) into prefix,
middle and suffix. The text is copied once, with its three sentinels in natural order, into a bytearray, and
two neighbouring blocks of it are exchanged where they lie by reversing each and then both. In the form ``psm``
the middle and the suffix change places, in ``spm`` the suffix and all before it. :func:`restore` finds the
sentinels in an output, takes the rotation back with the same three reversals and deletes the sentinels.

Cuts and form follow from a digest of the id, so a rerun agrees. Token borders of all texts of a slice of a batch
are found at once on its bytes; a slice holds ``SLICE_BYTES`` or one text, so memory follows the longest text.

Cases: null text is empty, and an empty text is plain, as is one that contains a sentinel; a missing id counts as
empty text; rows that repeat give the same row. An empty table gives an empty result. Columns other than
``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import whole_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = "1"
TRANSFORMED_PERCENT = 90
SPM_PERCENT = 20
SLICE_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


class Rates(NamedTuple):
    """Percent of the texts that are transformed, and percent of these in the form ``spm``."""

    transformed: int = TRANSFORMED_PERCENT
    spm: int = SPM_PERCENT


def token_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted byte positions at which a token begins; text i covers ``raw[at[i]: at[i + 1]]``."""
    letter = _LETTER[raw]
    follows = np.zeros(len(raw), bool)
    follows[1:] = letter[1:] & letter[:-1]
    firsts = at[:-1]
    follows[firsts[firsts < at[1:]]] = False
    return np.flatnonzero(~(_CONTINUES[raw] | follows))


def rotate(block: memoryview, left: int) -> None:
    """Exchange the first ``left`` bytes of ``block`` with the rest, in place, by three reversals."""
    view = np.frombuffer(block, np.uint8)
    for part in (view[:left], view[left:], view):
        half = len(part) // 2
        head = part[:half].copy()
        part[:half] = part[::-1][:half]
        part[len(part) - half:] = head[::-1]


def transform(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The output of a text that is cut before the bytes ``first`` and ``second``."""
    if form == PLAIN:
        return bytearray(text)
    # psm: P prefix [M middle][S suffix]; spm: [P prefix M middle][S suffix]
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    begin = len(PREFIX) + first if form == PSM else 0
    last = second + len(PREFIX) + len(MIDDLE)
    with memoryview(out) as view:
        rotate(view[begin:], last - begin)
    return out


def restore(output: bytes, form: str) -> bytes:
    """The text from which :func:`transform` made ``output``."""
    if form == PLAIN:
        return bytes(output)
    out = bytearray(output)
    moved = out.index(SUFFIX)
    # the block that the suffix changed places with
    other = out.index(MIDDLE if form == PSM else PREFIX)
    with memoryview(out) as view:
        rotate(view[moved:], other - moved)
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        place = out.index(sentinel)
        del out[place: place + len(sentinel)]
    return bytes(out)


def draws(doc_id: str | None, seed: str = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return tuple(int.from_bytes(digest[k: k + 4], "big") for k in range(0, 16, 4))


def _slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, memoryview, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of slices of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]
        low = high


def _cut(texts: memoryview, at: np.ndarray, ids: list, seed: str, rates: Rates) -> list[tuple]:
    """n, form, prefix_chars, middle_chars, output of every text of a slice."""
    raw = np.frombuffer(texts, np.uint8)
    starts = token_starts(raw, at)
    first_token = np.searchsorted(starts, at)
    points = np.concatenate(([0], np.cumsum(~_CONTINUES[raw], dtype=np.int64)))
    out = []
    for i, doc_id in enumerate(ids):
        text = bytes(texts[at[i]: at[i + 1]])
        n = int(first_token[i + 1] - first_token[i])
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not text or h3 % 100 >= rates.transformed or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            out.append((n, PLAIN, None, None, text))
            continue
        first, second = (at[i + 1] if k == n else starts[first_token[i] + k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        form = SPM if h4 % 100 < rates.spm else PSM
        changed = transform(text, int(first - at[i]), int(second - at[i]), form)
        out.append((n, form, int(points[first] - points[at[i]]), int(points[second] - points[first]), bytes(changed)))
    return out


def fill_in_middle(docs: DataFrame, seed: str = SEED, rates: Rates = Rates()) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output (the text to train on)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for low, high, texts, at in _slices(batch.column("text")):
                n, form, prefix, middle, output = zip(*_cut(texts, at, ids[low:high].to_pylist(), seed, rates), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low:high], pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), whole_text().alias("text"))
    return narrow.mapInArrow(
        rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` of :func:`fill_in_middle` with ``restored``, the text rebuilt from output and form alone."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts, at in _slices(batch.column("output")):
                part = batch.slice(low, high - low)
                back = [restore(texts[a:b], form) for a, b, form in
                        zip(at[:-1], at[1:], part.column("form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(back, pa.binary()).cast(pa.string())], names=[*part.schema.names, "restored"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outputs.schema)
    return outputs.mapInArrow(rows, f"{kinds}, restored string")


def fill_digests(docs: DataFrame) -> DataFrame:
    """Counts, form, and the digests of output and rebuilt text, of every document."""
    digest = {c: F.sha2(F.col(c).cast("binary"), 256) for c in ("output", "restored")}
    return restored(fill_in_middle(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest["output"].alias("output_sha256"), digest["restored"].alias("restored_sha256"))
