"""Expressions over model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from govlake.functions.text import ascii_fold

# Fields that may hold the answer, in order of preference.
TEXT_FIELDS = ("result", "output", "text", "content")

# The verdict, the status and the message of a blocked answer.
VIOLATION = "banned phrase detected"
BLOCKED_STATUS = 451
BLOCKED_MESSAGE = "AI output blocked: "
BLOCKED_CODE = "ai_output_blocked"


def output_text(body: Column) -> Column:
    """Answer text of a JSON body: a bare string, else the first string field, else ''."""
    parsed = F.try_parse_json(body)
    choices = [_if_string(parsed, "$")]
    choices += [_if_string(parsed, f"$.{name}") for name in TEXT_FIELDS]
    return F.coalesce(*choices, F.lit(""))


def _if_string(parsed: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(parsed, path, "string"))


def has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase occurs, ignoring the case of A-Z; empty phrases never do."""
    wanted = sorted({_fold(p) for p in phrases if p != ""})
    if not wanted:
        return F.lit(False)
    # The text is folded once per row; `transform` over a one-element array binds it.
    bound = F.transform(
        F.array(ascii_fold(text)),
        lambda folded: F.exists(F.lit(wanted), lambda phrase: F.contains(folded, phrase)),
    )
    return F.coalesce(bound[0], F.lit(False))


def violation(text: Column, phrases: Sequence[str]) -> Column:
    """The verdict on a text, null when it may pass. Empty texts are never scanned."""
    return F.when((text != "") & has_phrase(text, phrases), F.lit(VIOLATION))


def _fold(phrase: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in phrase)
