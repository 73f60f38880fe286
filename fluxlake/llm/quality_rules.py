"""Quality rules: a threshold table compiled into one projection.

Every statistic is a built-in expression over the whole text, every rule a row (statistic, lowest,
highest) of a table, and a document is kept when all rules hold. No user function runs and nothing
is shuffled.

Repeated windows: where the three-word windows of a text aren't all distinct, they are sorted with
their positions, so equal windows are neighbours; the words they cover are counted from the
positions. The sort is per document.

Cases: null text has no words; a text without words fails the base rule. Ratios over zero are 0. Rows
that repeat give repeated results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import SPACES, whole_text

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that for it with as was on be at by this are from or".split(),
    "de": "der die das und in zu den von mit ist des im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au il elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}


class Rule(NamedTuple):
    statistic: str
    lowest: float
    highest: float


RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", 0.0, 0.1),       # symbols per word
    Rule("shout_ratio", 0.0, 0.3),        # exclamation marks per word
    Rule("capital_ratio", 0.0, 0.5),      # A-Z among A-Z and a-z
    Rule("stop_ratio", 0.04, 1.0),        # stop words of the best language per word, in any case
    Rule("dup_line_ratio", 0.0, 0.3),     # repeated lines per line with a word
    Rule("open_line_ratio", 0.0, 0.3),    # lines ending in an ellipsis
    Rule("bullet_line_ratio", 0.0, 0.9),  # lines starting with a bullet
)


def _ratio(part: str | Column, whole: str | Column) -> Column:
    whole = F.col(whole) if isinstance(whole, str) else whole
    part = F.col(part) if isinstance(part, str) else part
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count_of(text: str, chars: str) -> Column:
    """Characters of ``text`` in a class of a regular expression."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def _length_in(text: str, chars: str) -> Column:
    """The same count for a class that most characters are in: runs are removed, not listed."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def _hits(words: str, listed: list[str]) -> Column:
    """Words that are in the list."""
    return F.size(F.filter(words, lambda w: w.isin(listed)))


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text parts and the counts that the base rule reads."""
    split = docs.select("doc_id", whole_text().alias("body")).select(
        "doc_id", "body",
        F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.expr("split(body, '\\n')").alias("all_lines"))
    split = split.select(
        "doc_id", "body", "words", F.size("words").cast("long").alias("n_words"),
        F.filter("all_lines", lambda line: F.length(F.trim(line, F.lit(SPACES))) > 0).alias("lines"))
    windows = F.when(F.col("n_words") >= 3, F.transform(
        F.slice("words", 1, F.col("n_words").cast("int") - 2),
        lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2))))
    cut = split.withColumn("windows", windows)
    # only where a window repeats: windows sorted with their positions, so that equal ones are neighbours
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = cut.withColumn("ordered", F.when(repeated, F.sort_array(
        F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    at = F.expr(
        "filter(ordered, (x, k) -> (k > 0 AND get(ordered, k - 1).w = x.w) "
        "OR (k + 1 < size(ordered) AND get(ordered, k + 1).w = x.w))")
    covered = ordered.withColumn("repeats", at)
    words_in = F.size(F.array_distinct(F.flatten(F.transform(
        "repeats", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return covered.select(
        "doc_id", "body", "words", "lines", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of("body", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats").isNull(), 0).otherwise(words_in).cast("long").alias("n_repeat_words"))


def ratios(stats: DataFrame) -> DataFrame:
    """The statistics that the threshold table names."""
    n_lines = F.size("lines")
    # one pass over the words, then one over the hits per language
    listed_words = sorted(set().union(*STOP_WORDS.values()))
    hits = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(listed_words))
    stops = [_hits("hits", listed) for listed in STOP_WORDS.values()]
    open_lines = F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))
    bullets = F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "‣")))
    return stats.withColumns({
        "hits": hits, "open_lines": open_lines, "bullets": bullets,
        "upper": _count_of("body", "A-Z"), "lower": _length_in("body", "a-z"),
    }).withColumns({
        "stops": reduce(F.greatest, stops),
    }).withColumns({
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "shout_ratio": _ratio(_count_of("body", "!"), "n_words"),
        "capital_ratio": _ratio("upper", F.col("upper") + F.col("lower")),
        "stop_ratio": _ratio("stops", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", n_lines),
        "open_line_ratio": _ratio("open_lines", n_lines),
        "bullet_line_ratio": _ratio("bullets", n_lines),
    })


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the base counts, the verdict, and the first failed rule."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = reduce(lambda a, b: a & b, [F.col(r.statistic).between(r.lowest, r.highest) for r in rules])
    reason = F.coalesce(F.when(F.col("base_failed"), "base"), *[
        F.when(~F.col(r.statistic).between(r.lowest, r.highest), r.statistic) for r in rules])
    return ratios(base_statistics(docs)).withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & verdict).alias("kept"), reason.alias("reason"))
