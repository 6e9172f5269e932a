"""Quality rules: a table of thresholds compiled into native column expressions.

Everything is computed row by row in one projection: no shuffle, no user
function. The heavier parts are staged (words, their hashes, the windows'
hashes), so that each array is built once and read by index after that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, staged, words

#: Words in a window that counts as repeated when found again in the text.
REPEAT_WINDOW = 8

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were which with "
    "aber als am auf aus bei das dem den der des die ein eine einer für im ist mit nicht sich sie und von zu "
    "au aux ce dans de des du elle en est et il la le les leur ne par pas pour que qui se sur un une "
    "al como con del el ella es las lo los más no o para pero por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``metric`` lies within [least, most]; a missing bound does not bind."""

    metric: str
    least: float | None = None
    most: float | None = None


#: Ratios a kept document must satisfy, besides the base conditions.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.05, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeat_words(ordered: Column) -> Column:
    """Words in windows whose hash occurs more than once; ``ordered`` holds (hash, position), sorted."""
    last = F.size(ordered) - 1
    twins = F.filter(
        ordered,
        lambda x, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(ordered, j + 1)["h"] == x["h"])),
    )
    spots = F.array_sort(F.transform(twins, lambda x: x["at"]))
    return F.aggregate(
        spots,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
        lambda acc, at: F.struct(
            (acc["total"] + (at + REPEAT_WINDOW) - F.greatest(at, acc["end"])).cast("long").alias("total"),
            (at + REPEAT_WINDOW).alias("end"),
        ),
        lambda acc: acc["total"],
    )


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, counts, ratios) per row of ``docs``. Null and empty texts have no words, and every count and ratio 0."""
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).select(
        "doc",
        staged(words(text)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(SPACE_CHARS)) != "").alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"[^a-z]+", "")).cast("long").alias("n_lower"),
    )
    rows = rows.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        "n_lower",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        staged(F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"),
    )
    hashes = F.col("hashes")
    window = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - REPEAT_WINDOW),
        lambda at: F.xxhash64(*(F.get(hashes, at + i) for i in range(REPEAT_WINDOW))),
    )
    # Within one text two different windows share a 64-bit hash with a chance below n^2 / 2^65.
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("windows", staged(F.when(F.size(hashes) >= REPEAT_WINDOW, window).otherwise(none))).drop("hashes")
    windows = F.col("windows")
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    pairs = F.array_sort(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    rows = rows.withColumn("ordered", staged(F.when(repeats, pairs))).drop("windows")
    rows = rows.withColumn("n_repeat_words", staged(F.coalesce(_repeat_words(F.col("ordered")), F.lit(0)).cast("long"))).drop("ordered")
    n = F.col("n_words")
    return rows.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), n),
            "symbol_ratio": _ratio(F.col("n_symbols"), n),
            "shout_ratio": _ratio(F.col("n_upper"), F.col("n_upper") + F.col("n_lower")),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), n),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        }
    )


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    """Too few words, or too many of them in repeated windows."""
    n = F.col("n_words")
    return (n < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * n)


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One boolean column: every rule holds."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            verdict &= F.col(rule.metric) >= F.lit(rule.least)
        if rule.most is not None:
            verdict &= F.col(rule.metric) <= F.lit(rule.most)
    return verdict


def judge_quality(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The metrics of :func:`quality_metrics` with ``base_failed`` and ``kept``, one row per row of ``docs``.

    A null or empty text fails the base (it has too few words). Repeated rows
    are judged alike; an empty table gives no rows; other columns are not read.
    """
    rows = quality_metrics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
