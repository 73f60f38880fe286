"""Importance resampling towards a target distribution of hashed word runs.

1. *Dictionary.* The distinct words of a slice of texts go into an Aho-Corasick automaton, bounded by delimiters on
   both sides; each carries the CRC-32 and the length of its bytes. A scan of the slice emits the payloads in
   reading order. Payloads of adjacent words compose: the CRC of a run follows from those of its parts and the
   length of the later part, so a longer run is never spelled out. The CRC modulo the number of buckets is a
   feature's bucket.
2. *Counting.* Buckets are counted inside tasks over all documents and all target texts; a task gives one row per
   bucket, so a word that makes up a third of a corpus reaches the sum as one row per task.
3. *Scoring.* A bucket's gain is the floored, scaled log ratio of the smoothed frequencies in target and corpus, a
   document's weight the floored mean of its features' gains. The gains, one per bucket and so of fixed
   size, are part of the scoring function.
4. *Drawing.* Gumbel noise from a digest of the id is added, and the highest scores are drawn among documents with
   enough words. Scores are ranked in range slices, with one carried row per slice.

Slices hold ``SLICE_BYTES`` or one text; a long text is scanned in pieces cut at delimiters. Buckets of a document
are written once (two bytes per feature where 65,536 buckets suffice) and used for counting and scoring.

Cases: null, empty and wordless texts have no feature, weight 0, and are never drawn unless ``least_words`` is 0; a
missing id counts as empty text in the digest and comes last in ties; rows that repeat have the same score and take
ranks of their own. Empty tables give empty results; an empty target gives gains for frequency 0. Columns other than
those named are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxlake.llm.common import whole_text
from fluxlake.operators.ordered import row_index
from fluxlake.session import materialize

N_BUCKETS = 10_000
MAX_RUN = 1
SCALE = 1000
LEAST_WORDS = 20
DRAWN_PERCENT = 10
SEED = "2024"
SLICE_BYTES = 1 << 18
SPACE_CRC = np.uint32(zlib.crc32(b" "))

# A-Z lower-cased; other ASCII that is neither digit nor letter becomes the delimiter.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@lru_cache(maxsize=64)
def _advance_table(power: int) -> np.ndarray:
    """What ``2 ** power`` further bytes of a message do to the CRC before them: a table per byte of the CRC.

    Appending n zero bytes is linear over bits: ``crc(a + b) = advance(crc(a), len(b)) ^ crc(b)``.
    """
    if power:
        half = _advance_table(power - 1)
        unit = _apply(half, _apply(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    else:
        zero = zlib.crc32(b"\0")
        # crc32(b"\0", c) = advance(c, 1) ^ crc32(b"\0")
        unit = np.array([zlib.crc32(b"\0", 1 << bit) ^ zero for bit in range(32)], np.uint32)
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            step = 1 << bit
            table[byte, step: 2 * step] = table[byte, :step] ^ unit[8 * byte + bit]
    return table


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & 255] ^ table[1][(crc >> np.uint32(8)) & 255]
            ^ table[2][(crc >> np.uint32(16)) & 255] ^ table[3][crc >> np.uint32(24)])


def compose(crc: np.ndarray, later_crc: np.ndarray, later_length: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, from the CRC of each part and the byte length of the later one."""
    out, power = crc.copy(), 0
    while len(out) and later_length.max() >> power:
        has = np.flatnonzero((later_length >> power) & 1)
        out[has] = _apply(_advance_table(power), out[has])
        power += 1
    return out ^ later_crc


class Dictionary:
    """Automaton over the delimiter-bounded distinct words of a text, with a payload for each."""

    def __init__(self, text: bytes) -> None:
        words = list(set(text.split()))
        self.crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, word in enumerate(words):
            # the automaton reads characters; latin-1 gives one for every byte
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        if words:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> np.ndarray:
        """(end, word number) rows in reading order; the end is the position of the delimiter behind the word."""
        if not len(self.crc):
            return np.empty((0, 2), np.int64)
        flat = chain.from_iterable(self.automaton.iter(text.decode("latin-1")))
        return np.fromiter(flat, np.int64).reshape(-1, 2)


def _pieces(text: bytes, limit: int) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of a text that starts and ends with delimiters; neighbours share the delimiter at the cut."""
    low = 0
    while len(text) - low > limit:
        cut = text.rfind(b" ", low + 1, low + limit)
        cut = cut if cut > 0 else text.find(b" ", low + limit)
        yield low, text[low: cut + 1]
        low = cut
    yield low, text[low:]


def run_buckets(texts: list[bytes], n_buckets: int = N_BUCKETS, max_run: int = MAX_RUN,
                limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, features per text, and all features' buckets, text by text."""
    joined = b" " + b"  ".join(texts).translate(_NORMAL) + b" "
    # a text's words end before the position behind its last byte
    stops = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    crc, length, ends = [], [], []
    for offset, piece in _pieces(joined, limit):
        words = Dictionary(piece)
        found = words.scan(piece)
        number = found[:, 1]
        ends.append(found[:, 0] + offset)
        crc.append(words.crc[number])
        length.append(words.length[number])
    crc, length, ends = map(np.concatenate, (crc, length, ends))
    owner = np.searchsorted(stops, ends, "left")
    n_words = np.bincount(owner, minlength=len(texts))
    buckets, owners, run = [crc % np.uint32(n_buckets)], [owner], crc
    for extra in range(1, min(max_run, len(crc))):
        # the run that starts at word i goes on with a space and word i + extra
        tail = compose(np.full(len(crc) - extra, SPACE_CRC), crc[extra:], length[extra:])
        run = compose(run[: len(crc) - extra], tail, length[extra:] + 1)
        whole = owner[extra:] == owner[: len(owner) - extra]
        buckets.append(run[whole] % np.uint32(n_buckets))
        owners.append(owner[extra:][whole])
    if len(buckets) > 1:
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return n_words, np.bincount(owner, minlength=len(texts)), np.concatenate(buckets)[order]
    return n_words, n_words, buckets[0]


def _grouped(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of slices of a binary column."""
    ends = np.cumsum(np.asarray(pc.binary_length(column)))
    low = 0
    while low < len(column):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield low, column[low:high].to_pylist()
        low = high


def _code(n_buckets: int) -> type:
    return np.uint16 if n_buckets <= 2**16 else np.uint32


def featured(docs: DataFrame, n_buckets: int = N_BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of a document's features, as packed integers."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _grouped(batch.column("text")):
                n_words, n_features, buckets = run_buckets(texts, n_buckets, max_run)
                width = np.dtype(_code(n_buckets)).itemsize
                ends = np.concatenate(([0], np.cumsum(n_features))) * width
                packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [
                    None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buckets.astype(_code(n_buckets)))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low: low + len(texts)], pa.array(n_words, pa.int64()),
                     pa.array(n_features, pa.int64()), packed.cast(pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(
        rows, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def _packed(column: pa.Array, code: type) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    return data.view(code), np.diff(offsets) // np.dtype(code).itemsize


def bucket_counts(features: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: a fixed number of sums, whatever the input."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            total += np.bincount(_packed(batch.column("buckets"), _code(n_buckets))[0], minlength=n_buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["bucket", "n"])

    sums = features.select("buckets").mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def log_gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Floored, scaled log ratio of the smoothed frequencies, per bucket."""
    n = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def _weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features."""
    code = _code(len(gains))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, sizes = _packed(batch.column("buckets"), code)
            sums = np.concatenate(([0], np.cumsum(gains[buckets])))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            total = sums[ends[1:]] - sums[ends[:-1]]
            weight = total // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(rows, f"doc_id {kind}, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS, max_run: int = MAX_RUN,
              least_words: int = LEAST_WORDS, percent: int = DRAWN_PERCENT, seed: str = SEED,
              scale: int = SCALE) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where not drawn).

    ``target`` has a column ``text``; documents are drawn without replacement with odds that grow with their weight.
    """
    features = materialize(featured(docs, n_buckets, max_run), "features")
    wanted = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n_buckets, max_run)
    gains = log_gains(bucket_counts(features, n_buckets), bucket_counts(wanted, n_buckets), scale)
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(code, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(scale)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = materialize(_weighted(features, gains).withColumn("score", F.col("weight") + noise), "scores")

    # the gains and the noise are bounded, so the scores are some ten thousand different numbers at any size
    able = F.col("n_words") >= least_words
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counts.select("score", "n", F.sum("n").over(above).alias("so_far"), F.sum("n").over(Window.partitionBy()).alias("all"))
    draw = F.floor(F.lit(percent) * F.col("all") / 100)
    least = totals.filter((F.col("so_far") - F.col("n")) < draw).agg(
        F.min("score").alias("least"), F.max("all").alias("all")).first()
    keep = scored.filter(able & (F.col("score") >= least["least"])) if least["least"] is not None else scored.limit(0)
    drawn = percent * (least["all"] or 0) // 100
    ranked = row_index(keep.select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("unnamed")),
                       ["down", "unnamed", "doc_id"], out="place")
    ranked = ranked.select("doc_id", "n_features", "weight", "score",
                           F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"))
    rest = scored.filter(~able | (F.col("score") < least["least"])) if least["least"] is not None else scored
    return ranked.unionAll(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
