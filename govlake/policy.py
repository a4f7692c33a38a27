"""Typed policy configuration with the default of every option."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default token prices in USD per 1,000 tokens.
DEFAULT_RATE_IN = "0.003"
DEFAULT_RATE_OUT = "0.015"

# Redaction patterns, applied in this order.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
}

# Roles allowed per ability unless configured otherwise.
DEFAULT_ROLE_MAP = {
    "ai/comment-moderation": ["administrator", "editor"],
    "ai/image-generation": ["administrator", "editor"],
}

# Abilities that receive the site guidelines automatically.
EDITORIAL_ABILITIES = ("ai/editorial-notes", "ai/editorial-updates")

# The built-in ability catalogue, in order.
ABILITIES = {
    "ai/title-generation": "Title generation",
    "ai/excerpt-generation": "Excerpt generation",
    "ai/meta-description": "Meta description",
    "ai/summarization": "Summarization",
    "ai/content-classification": "Content classification",
    "ai/content-resizing": "Content resizing",
    "ai/comment-moderation": "Comment moderation",
    "ai/alt-text-generation": "Image alt text",
    "ai/image-generation": "Image generation",
    "ai/image-prompt-generation": "Image prompt generation",
    "ai/editorial-notes": "Editorial notes",
    "ai/editorial-updates": "Editorial updates",
}

# The settable policy keys and their defaults, as JSON text.
POLICY_DEFAULTS = {
    "preamble": '""',
    "rate_limits": '{"minute":20,"day":500}',
    "monthly_user_cap": "0",
    "log_retention_days": "90",
    "model_allowlist": "[]",
    "disabled_features": "[]",
    "banned_phrases": "[]",
    "redact_pii": "true",
    "use_guidelines": "true",
}


@dataclass(frozen=True)
class RateWindow:
    """One counter of the rate limiter: at most ``limit`` within ``ttl_seconds``."""

    name: str
    ttl_seconds: int
    limit: int


# Default rate limits.
DEFAULT_RATE_WINDOWS = (RateWindow("minute", 60, 20), RateWindow("day", 86_400, 500))


@dataclass(frozen=True)
class Policy:
    """Everything an administrator can configure; each field has the default."""

    preamble: str = ""
    rate_windows: Sequence[RateWindow] = DEFAULT_RATE_WINDOWS
    monthly_user_cap_usd: str = "0"
    log_retention_days: int = 0
    usage_retention_months: int = 24
    disabled_features: Sequence[str] = ()
    model_allowlist: Sequence[tuple[str, str, str]] = ()
    banned_phrases: Sequence[str] = ()
    redact_pii: bool = True
    use_guidelines: bool = True
    guidelines_override: Callable[[bool], bool] | None = None
    guideline_statuses: Sequence[str] = ("publish", "draft")
    guideline_abilities: Sequence[str] = EDITORIAL_ABILITIES
    guideline_text: Callable[[Column], Column] | None = None
    pii_patterns: Mapping[str, str] = field(default_factory=lambda: dict(PII_PATTERNS))
    parse_usage_metadata: bool = False

    def guidelines_on(self) -> bool:
        """The stored toggle, then the code-level override."""
        enabled = bool(self.use_guidelines)
        return enabled if self.guidelines_override is None else bool(self.guidelines_override(enabled))


def _allowlisted(stored) -> list[tuple[str, str, str]]:
    """(capability, provider, model) rows of a stored allowlist: lists of pairs by capability."""
    if not isinstance(stored, Mapping):
        return []
    pairs = [(kind, pair) for kind, listed in stored.items() for pair in listed if isinstance(pair, Sequence) and len(pair) >= 2]
    return [(str(kind), str(pair[0]), str(pair[1])) for kind, pair in pairs]


def load_policy(options: DataFrame, **overrides) -> Policy:
    """Policy of one site from its stored options (key, value as JSON text).

    With a column ``version`` the latest value of a key counts, as in a policy snapshot.
    Options that are not stored keep their default; ``overrides`` replace fields that only
    code can set. At most one row per known option reaches the driver.
    """
    known = (*POLICY_DEFAULTS, "usage_retention_months")
    value = F.max_by("value", "version") if "version" in options.columns else F.max("value")
    rows = options.where(F.col("key").isin(*known)).groupBy("key").agg(value.alias("value")).collect()
    stored = {r["key"]: json.loads(r["value"]) for r in rows if r["value"] is not None}
    fields = {
        "preamble": ("preamble", str), "log_retention_days": ("log_retention_days", int),
        "usage_retention_months": ("usage_retention_months", int), "disabled_features": ("disabled_features", tuple),
        "banned_phrases": ("banned_phrases", lambda v: tuple(str(p) for p in v)), "redact_pii": ("redact_pii", bool),
        "use_guidelines": ("use_guidelines", bool), "monthly_user_cap": ("monthly_user_cap_usd", str),
    }
    chosen = {name: cast(stored[key]) for key, (name, cast) in fields.items() if key in stored}
    if "model_allowlist" in stored:
        chosen["model_allowlist"] = tuple(_allowlisted(stored["model_allowlist"]))
    if "rate_limits" in stored:
        limits = stored["rate_limits"]
        chosen["rate_windows"] = tuple(
            RateWindow(w.name, w.ttl_seconds, int(limits.get(w.name, 0))) for w in DEFAULT_RATE_WINDOWS
        )
    return Policy(**{**chosen, **overrides})
