"""Request prices in whole micro-USD.

Money is rounded to six decimals per request and then summed, so a BIGINT of
micro-USD holds it exactly and keeps every sum on the fast integer path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from govlake.policy import DEFAULT_RATE_IN, DEFAULT_RATE_OUT

def rate(value: Column | None, default: str) -> Column:
    """USD per 1,000 tokens as whole billionths."""
    chosen = F.lit(default).cast("decimal(12,9)")
    if value is not None:
        chosen = F.coalesce(value.cast("decimal(12,9)"), chosen)
    return (chosen * F.lit(10**9)).cast("bigint")


def price_micros(tokens_in: Column, tokens_out: Column, rate_in: Column | None = None,
                 rate_out: Column | None = None) -> Column:
    """Price of one request, rounded half away from zero to a micro-USD.

    Amounts that overflow on the way are worked out again in decimals; one that a BIGINT of
    micro-USD can't hold is an error, not another amount. Unknown token counts cost nothing.
    """
    zero = F.lit(0).cast("bigint")
    sides = [
        (F.coalesce(tokens, zero), rate(value, default))
        for tokens, value, default in ((tokens_in, rate_in, DEFAULT_RATE_IN), (tokens_out, rate_out, DEFAULT_RATE_OUT))
    ]
    # tokens * billionths per 1,000 tokens = 1e-12 USD; a micro-USD is a million of them
    scaled = F.try_add(*[F.try_multiply(tokens, billionths) for tokens, billionths in sides])
    half = F.when(scaled < 0, F.lit(-500_000).cast("bigint")).otherwise(F.lit(500_000).cast("bigint"))
    fast = F.call_function("div", F.try_add(scaled, half), F.lit(10**6).cast("bigint"))
    wide = [tokens.cast("decimal(19,0)") * billionths.cast("decimal(18,0)") for tokens, billionths in sides]
    exact = F.round((wide[0] + wide[1]) * F.lit("0.000001").cast("decimal(6,6)"), 0).cast("decimal(38,0)").cast("bigint")
    return F.coalesce(fast, exact)


def usd(micros: Column) -> Column:
    """Micro-USD as DECIMAL(22,6)."""
    return (micros.cast("decimal(22,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(22,6)")


def usd_double(micros: Column) -> Column:
    """Micro-USD as DOUBLE, the type of the spend report."""
    return micros.cast("double") / F.lit(1_000_000.0)


def micros_of(amount: str | int | float) -> int:
    """Whole micro-USD of a configured amount."""
    from decimal import ROUND_HALF_UP, Decimal

    return int((Decimal(str(amount)) * 1_000_000).to_integral_value(ROUND_HALF_UP))
