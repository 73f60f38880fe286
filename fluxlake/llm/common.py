"""Tables, the white space of the corpus, and joins that survive missing ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.session import prepare

# White space is [\x20\x09-\x0D]; bytes.split() without arguments splits on the same six bytes.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, by name, so that further columns never get in the way."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def whole_text(col: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def remainder(col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % divisor
