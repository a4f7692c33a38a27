"""Quality rules: a table of thresholds compiled into one projection over length, symbol,
stop-word and line ratios.

Everything is built-in expressions. A document is one row in and one row out, so nothing
is shuffled and a document's work depends on its own length only: its three-word windows
are sorted inside the row, which finds the repeated ones in n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import own_columns

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was on be with by this from as at are an or not "
    "der die das und zu den von mit sich des ist ein eine nicht auf im dem "
    "de la le les et des en un une du que qui est pour dans par sur au "
    "el los las y se del por con para su al como más lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document if ``low <= 100 * part / whole <= high``; a whole of zero counts as one."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", high=10),
    Rule("marks_per_word", "n_marks", "n_words", high=25),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=30),
)


def _holds(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part), F.greatest(F.col(rule.whole), F.lit(1))
    bounds = [part >= rule.low * whole] if rule.low is not None else []
    bounds += [part <= rule.high * whole] if rule.high is not None else []
    held = bounds[0]
    for bound in bounds[1:]:
        held = held & bound
    return held


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts the rules look at, one row per document.

    A null text has no words. Repeated rows are measured each by itself; columns other than
    ``doc_id`` and ``text`` are not carried.
    """
    whole = F.coalesce(F.col("_text"), F.lit(""))
    rows = own_columns(docs, doc_id, text).toDF("doc_id", "_text").select("doc_id", whole.alias("_text"))
    trimmed = F.btrim("_text", F.lit(SPACES))
    empty = F.array().cast("array<string>")
    rows = rows.select(
        "doc_id", "_text",
        F.when(trimmed == "", empty).otherwise(F.split(trimmed, GAP)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"),
    )
    n = F.size("_words")
    windows = F.transform(
        F.slice("_words", 1, F.greatest(n - 2, F.lit(0))),
        lambda word, i: F.struct(
            F.xxhash64(word, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    rows = rows.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("_text", F.lit("!")).cast("bigint").alias("n_marks"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.sort_array(windows).alias("_windows"),
    )
    same = lambda i, h: F.coalesce(F.get("_windows", i)["h"] == h, F.lit(False))
    repeated = F.filter("_windows", lambda w, i: same(i - 1, w["h"]) | same(i + 1, w["h"]))
    rows = rows.select("*", F.sort_array(F.transform(repeated, lambda w: w["i"])).alias("_starts")).drop("_windows")
    covered = F.aggregate(
        F.transform("_starts", lambda start, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - start, F.lit(3)))),
        F.lit(0), lambda total, words: total + words,
    )
    return rows.select("*", covered.cast("bigint").alias("n_repeat_words")).drop("_starts")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS,
                max_repeated_percent: int = MAX_REPEATED_PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, the names of the rules that fail, and the verdict of every document.

    An empty or null text has zero words and so fails the base rule. An empty table gives
    an empty result.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words"))
    failed = F.filter(
        F.array(*[F.when(~_holds(rule), F.lit(rule.name)) for rule in rules]), lambda name: name.isNotNull()
    )
    measured = measure(docs, doc_id, text)
    return measured.select(
        "*", base.alias("base_failed"), failed.alias("failed_rules")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
