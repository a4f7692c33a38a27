"""Awkward documents every corpus operator has to take."""

import random

import pytest

CLASHING = ["fp", "key", "deleted", "n_deleted", "text_key", "_doc", "_key", "_row_key", "unit", "shard", "rank", "kept",
            "score", "lang_pred", "n_words", "_text", "component_id", "spans", "items", "start", "h"]
BASE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    for place in range(words):
        out.append("".join(rng.choice("aeioulnrstm") for _ in range(rng.randint(2, 9))))
        if place % 12 == 11:
            out.append("\n")
    return " ".join(out)


def frame(spark, rows, clashing=False):
    """documents from (doc_id, text) or full rows; with columns named like working columns if asked for."""
    full = [tuple(r) if len(r) == 5 else (r[0], r[1], "en", "src", len(r[1] or "")) for r in rows]
    names = CLASHING if clashing else []
    schema = ", ".join([BASE, *[f"`{n}` string" for n in names]])
    return spark.createDataFrame([r + ("x",) * len(names) for r in full], schema)


LONG = prose(1, 30_000)
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t\x0b \n"), (4, "word"), (5, "two words"), (6, LONG), (7, LONG), (8, LONG + " end"),
    (9, prose(2, 200)), (9, prose(2, 200)), (10, "é ü  \U0001f600 \x00 x"), (None, prose(3, 80)), (None, None),
    (11, "!!! ### 12.5 --"), (12, "\n".join(["same line of several words here"] * 40)),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, AWKWARD, clashing=True)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
