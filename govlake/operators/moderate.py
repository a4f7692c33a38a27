"""Moderation of answers and the search for banned phrases in documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.functions import outputs
from govlake.functions.text import ascii_fold
from govlake.operators.sizing import MAX_BROADCAST_BYTES, spread

_SPACE = "[ \\t\\n\\r\\f\\x0B]"
ANCHOR_BYTES = 64  # what an anchored phrase takes besides its text
_RUN = 3  # words (or characters) an anchor spans at most


def moderate(answers: DataFrame, text: Column, phrases: Sequence[str], code: str = outputs.BLOCKED_CODE) -> DataFrame:
    """Add ``violation`` and, for violating answers, the replacement response.

    ``response`` is null for answers that pass unchanged.
    """
    verdict = answers.withColumn("violation", outputs.violation(text, phrases))
    status = F.lit(outputs.BLOCKED_STATUS)
    blocked = F.struct(
        status.alias("status"),
        F.lit(code).alias("code"),
        F.concat(F.lit(outputs.BLOCKED_MESSAGE), "violation").alias("message"),
        F.struct(status.alias("status")).alias("data"),
    )
    return verdict.withColumn("response", F.when(F.col("violation").isNotNull(), blocked))


def violations(moderated: DataFrame) -> DataFrame:
    """The violation log: one row per blocked answer."""
    return moderated.where(F.col("violation").isNotNull())


def phrase_matches(docs: DataFrame, doc_id: str, text: str, phrases: DataFrame) -> DataFrame:
    """Per document: the first phrase of the list that occurs, and how many occur.

    ``phrases`` (pos, phrase) may be long. Instead of trying every phrase on every
    document, each phrase gets an anchor that must occur in any text containing it: a run
    of up to three words that stand whole inside the phrase, or its first three characters
    if it has no such word. Documents meet phrases on hashed anchors, and only those pairs
    are compared in full.
    """
    folded = phrases.select("pos", ascii_fold(F.col("phrase")).alias("phrase")).where("phrase != ''")
    worded_phrases = folded.withColumn("_words", _words(F.col("phrase")))
    anchored = worded_phrases.select("pos", "phrase", _anchor(F.col("phrase"), F.col("_words")).alias("_a")).select(
        "pos", "phrase", "_a.kind", "_a.anchor"
    )
    # One look at the phrases tells which anchors to make and how large they really are.
    seen = anchored.agg(
        F.collect_set("kind").alias("kinds"), F.sum(F.octet_length("phrase") + ANCHOR_BYTES).alias("bytes")
    ).first()
    kinds = set(seen["kinds"])
    if not kinds:
        nothing = F.lit(None).cast("bigint")
        return docs.where(F.lit(False)).select(doc_id, nothing.alias("first_pos"), nothing.alias("phrases_hit"))

    # The words are a column of their own: inside a lambda they would be split again per word.
    texts = spread(docs.select(doc_id, text), doc_id).select(doc_id, ascii_fold(F.col(text)).alias("_text"))
    worded = texts.withColumn("_words", _words(F.col("_text")))
    anchors = _anchors_in(F.col("_text"), F.col("_words"), kinds)
    if seen["bytes"] <= MAX_BROADCAST_BYTES:
        pairs = worded.select(doc_id, "_text", F.explode(anchors).alias("anchor")).join(F.broadcast(anchored), "anchor")
    else:
        # Only hashes are shuffled; texts come back in for the pairs that met.
        met = worded.select(doc_id, F.explode(anchors).alias("anchor")).join(anchored, "anchor")
        pairs = met.join(texts, doc_id)
    found = pairs.where(F.contains("_text", "phrase"))
    return found.groupBy(doc_id).agg(
        F.min("pos").cast("bigint").alias("first_pos"), F.count(F.lit(1)).alias("phrases_hit")
    )


def _words(text: Column) -> Column:
    return F.split(text, _SPACE, -1)


def _hash(kind: int, run: Column) -> Column:
    return F.xxhash64(F.lit(kind), run)


def _anchor(phrase: Column, words: Column) -> Column:
    """Struct (kind, anchor hash). The kind says what the anchor is: a run of 3 words, 1
    word, 0 for the first three characters, -n for a whole phrase of only n characters."""
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))

    def chosen(kind: int, run: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), _hash(kind, run).alias("anchor"))

    def longest(runs: Column) -> Column:
        return F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]

    anchor = F.when(F.size(inner) >= _RUN, chosen(_RUN, longest(_runs(inner, _RUN))))
    anchor = anchor.when(F.size(inner) >= 1, chosen(1, longest(inner)))
    for length in range(1, _RUN):
        anchor = anchor.when(F.length(phrase) == length, chosen(-length, phrase))
    return anchor.otherwise(chosen(0, F.substring(phrase, 1, _RUN)))


def _runs(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))


def _anchors_in(text: Column, words: Column, kinds: set[int]) -> Column:
    """Distinct anchor hashes of the given kinds that a text contains."""
    def hashed(kind: int) -> Column:
        if kind > 0:
            found = words if kind == 1 else _runs(words, kind)
        else:
            width = _RUN if kind == 0 else -kind
            found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))
        return F.transform(found, lambda run: _hash(kind, run))

    return F.array_distinct(F.concat(*[hashed(kind) for kind in sorted(kinds)]))
