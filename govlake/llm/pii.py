"""Personal data by anchor expansion.

An Aho-Corasick automaton reads the text once and stops only at anchors: at-signs, plus
signs before digits, digits, URL schemes and identifier cues. Local parsers expand an
anchor to the left and right and validate what they find (part sizes, digit counts, Luhn).
A parser never looks at more than the run of characters its kind may consist of, and a text
without anchors costs the automaton's pass only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from govlake.llm.common import map_batches, own_columns, worker_memory

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE_RUN = re.compile(r"[\x20().0-9-]*")
_URL_REST = re.compile(r"""[^\s<>"'|\\^`{}\[\]]+""")
_ACCOUNT = re.compile(r"""["']?[\x20\t]*[:=#][\x20\t]*["']?([A-Za-z0-9][A-Za-z0-9_-]{7,})""")

# What announces an address or an account number.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "iban", "token", "password", "api_key", "apikey", "secret", "passport", "ssn")

Span = tuple[int, int]


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for digit in _DIGITS:
        automaton.add_word(digit, ("digit", 1))
        automaton.add_word(f"+{digit}", ("plus", 2))
    automaton.add_word("@", ("at", 1))
    for scheme in SCHEMES:
        automaton.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            automaton.add_word(form, ("cue", len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> Span | None:
    """Around the at-sign at ``at``; nothing before ``free`` belongs to it."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _phone(text: str, plus: int) -> Span | None:
    """From the plus sign: a digit, then the run of digits and separators up to its last digit."""
    run = _PHONE_RUN.match(text, plus + 2)
    last = run.end() - 1
    while last >= plus + 3 and text[last] not in _DIGITS:
        last -= 1
    return (plus, last + 1) if last >= plus + 3 else None


def _valid_ip(found: str) -> bool:
    parts = [part.lstrip("0") for part in found.split(".")]
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def _valid_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _valid_phone(found: str) -> bool:
    return 9 <= sum(c in _DIGITS for c in found) <= 15


def find_spans(text: str | None, automaton: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """Spans by kind, leftmost first and without overlap inside a kind; null and empty have none.

    A base match that fails validation is dropped and its characters stay used up.
    """
    spans: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if not text:
        return spans
    free = dict.fromkeys(KINDS, 0)
    for last, (anchor, length) in automaton.iter(text):
        start = last - length + 1
        if anchor == "digit":
            if start >= free["ip"] and (start == 0 or text[start - 1] not in _DIGITS or start == free["ip"]):
                found = _DOTTED.match(text, start)
                if found:
                    free["ip"] = found.end()
                    if _valid_ip(found.group()):
                        spans["ip"].append(found.span())
            if start >= free["card"]:
                found = _DIGIT_CHAIN.match(text, start)
                if found:
                    free["card"] = found.end()
                    if _valid_card(found.group()):
                        spans["card"].append(found.span())
        elif anchor == "at":
            found = _email(text, start, free["email"])
            if found:
                free["email"] = found[1]
                spans["email"].append(found)
        elif anchor == "plus":
            found = _phone(text, start) if start >= free["phone"] else None
            if found:
                free["phone"] = found[1]
                if _valid_phone(text[found[0]:found[1]]):
                    spans["phone"].append(found)
        elif anchor == "scheme":
            rest = _URL_REST.match(text, last + 1) if start >= free["url"] else None
            if rest:
                end = last + 1 + len(rest.group().rstrip(".,;:!?)"))
                if end > last + 1:
                    free["url"] = end
                    spans["url"].append((start, end))
        elif last + 1 >= free["account"]:
            found = _ACCOUNT.match(text, last + 1)
            if found and any(c in _DIGITS for c in found.group(1)):
                free["account"] = found.end()
                spans["account"].append(found.span(1))
    return spans


def joined(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in spans[kind])


def redacted(text: str | None, spans: dict[str, list[Span]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted((a, -b, kind) for kind in KINDS for a, b in spans[kind]):
        end = -end
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Counts per kind, all spans (code points, end exclusive) and, if asked for, the redacted text.

    One row per input row; repeated rows are read each by itself, a null text counts as empty
    (its redacted text stays null), columns other than doc_id and text are not carried.
    """
    rows = own_columns(docs, "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, " + ", ".join(f"n_{kind} bigint" for kind in KINDS)
        + ", base_spans string, spans string" + ", redacted string" * with_text
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_memory("pii_anchors", _automaton)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [find_spans(text, automaton) for text in texts]
            columns = [batch.column("doc_id")]
            columns += [pa.array([len(spans[kind]) for spans in found], pa.int64()) for kind in KINDS]
            columns += [pa.array([joined(spans, kinds) for spans in found], pa.string()) for kinds in (BASE_KINDS, KINDS)]
            if with_text:
                columns.append(pa.array([redacted(t, s) for t, s in zip(texts, found)], pa.string()))
            names = ["doc_id", *[f"n_{kind}" for kind in KINDS], "base_spans", "spans", *["redacted"] * with_text]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(rows, run, schema)
