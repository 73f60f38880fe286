"""Calendar terms, rotating folds and row-ratio splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.operators.ordered import row_index

SPLIT_TYPES = ("year", "year_half")


def term_label(time: str | Column, split_type: str = "year_half") -> Column:
    """``2003`` or ``2003-H1`` from a timestamp."""
    if split_type not in SPLIT_TYPES:
        raise ValueError(f"unsupported split_type: {split_type!r}; expected one of {SPLIT_TYPES}")
    col = F.col(time) if isinstance(time, str) else time
    year = F.year(col).cast("string")
    if split_type == "year":
        return year
    return F.concat(year, F.when(F.month(col) <= 6, "-H1").otherwise("-H2"))


def term_table(obs: DataFrame, time: str = "time_utc", split_type: str = "year_half") -> DataFrame:
    """All terms of the raw times with their sorted position and row count.

    Terms come from every row that has a time, whether or not it has a value. The table has one
    row per half-year, so ordering it in one partition is harmless.
    """
    per_term = (obs.filter(F.col(time).isNotNull())
                .groupBy(term_label(time, split_type).alias("term"))
                .agg(F.count("*").alias("n_rows")))
    return per_term.withColumn("term_idx", F.row_number().over(Window.orderBy("term")) - 1)


def check_fold(n_fold: int, fold: int | None = None, n_term: int | None = None) -> None:
    if n_term is not None and n_term < n_fold:
        raise ValueError(f"{n_term} terms are too few for {n_fold} folds")
    if fold is not None and not 0 <= fold < n_fold:
        raise ValueError(f"fold must be in [0, {n_fold}); got {fold}")


def split_of(term_idx: str | Column, fold: str | Column, n_fold: int) -> Column:
    """Split of a term in a fold: two residue classes rotate, the rest is training data."""
    idx = F.col(term_idx) if isinstance(term_idx, str) else term_idx
    num = F.col(fold) if isinstance(fold, str) else fold
    residue = F.pmod(idx - num, F.lit(n_fold))
    return (F.when(residue == n_fold - 2, "val").when(residue == n_fold - 1, "test")
            .otherwise("train"))


def test_fold_of(term_idx: str | Column, n_fold: int) -> Column:
    """The one fold in which a term is the test term."""
    idx = F.col(term_idx) if isinstance(term_idx, str) else term_idx
    return F.pmod(idx + 1, F.lit(n_fold)).cast("int")


def fold_splits(terms: DataFrame, n_fold: int = 5, folds: list[int] | None = None) -> DataFrame:
    """``(fold, term, term_idx, n_rows, split)`` for the folds asked for (all by default)."""
    for fold in folds or []:
        check_fold(n_fold, fold)
    check_fold(n_fold, n_term=terms.count())
    wanted = folds if folds is not None else list(range(n_fold))
    numbered = terms.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in wanted])))
    return numbered.withColumn("split", split_of("term_idx", "fold", n_fold))


def split_totals(splits: DataFrame) -> DataFrame:
    """Terms, rows and share of rows per fold and split."""
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("fold"))
    return (
        splits.groupBy("fold", "split")
        .agg(F.count("*").alias("n_terms"), F.sum("n_rows").alias("n_rows"))
        .withColumn("pct_rows", share * 100)
    )


def assign_split(obs: DataFrame, n_fold: int = 5, fold: int = 0, time: str = "time_utc",
                 split_type: str = "year_half") -> DataFrame:
    """Tag every row with its term and its split in one fold.

    The term table has two rows a year; the optimizer picks the join by its measured size.
    """
    splits = fold_splits(term_table(obs, time, split_type), n_fold, [fold]).select("term", "split")
    return obs.withColumn("term", term_label(time, split_type)).join(
        splits, "term", "left")


def split_frames(obs: DataFrame, **kwargs) -> dict[str, DataFrame]:
    tagged = assign_split(obs, **kwargs)
    return {name: tagged.filter(F.col("split") == name) for name in ("train", "val", "test")}


def ratio_split(obs: DataFrame, seq_len: int, pred_len: int, train_ratio: float, val_ratio: float,
                order: list[str], time: str = "time_utc") -> DataFrame:
    """Dense windows over the row order (no gap rule) with a train/val/test split by position.

    One output row per window: ``window_idx``, the forecast start time and the split. The row
    order is built slice by slice; only the forecast row of each window is kept, so nothing is
    joined back and no window is materialised.
    """
    numbered = row_index(obs, order)
    span = seq_len + pred_len
    n = obs.count()
    if n < span:
        raise ValueError(f"rows={n} is too short for seq_len+pred_len={span}")
    n_windows = n - span + 1
    train_end = int(n_windows * train_ratio)
    val_end = train_end + int(n_windows * val_ratio)
    idx = F.col("row_idx") - F.lit(seq_len)
    return (
        numbered.withColumn("window_idx", idx)
        .filter((F.col("window_idx") >= 0) & (F.col("window_idx") < n_windows))
        .withColumn("split", F.when(F.col("window_idx") < train_end, "train")
                    .when(F.col("window_idx") < val_end, "val").otherwise("test"))
        .withColumnRenamed(time, "forecast_start")
        .drop("row_idx")
    )
