"""Money as integer minor units: parsing, scaling and rendering without floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000
# Currencies as the sources name them, and decimal places where they aren't two. The sources write
# every amount but bitcoin with up to two places, yen too.
CURRENCY_NAMES = {
    "US Dollar": "USD", "Euro": "EUR", "Swiss Franc": "CHF", "Yuan": "CNY", "Shekel": "ILS", "Mexican Peso": "MXN", "Indian Rupee": "INR",
    "Canadian Dollar": "CAD", "Congo Franc": "CDF", "Malaysian": "MYR", "Brazilian Real": "BRL", "British Pound": "GBP", "Romanian Leu": "RON",
    "Turkish Lira": "TRY", "Vietnamese Dong": "VND", "Australian Dollar": "AUD", "Brazil Real": "BRL", "Ruble": "RUB", "Rupee": "INR",
    "Saudi Riyal": "SAR", "UK Pound": "GBP", "Yen": "JPY", "Bitcoin": "BTC",
}
PLACES, OTHER_PLACES = 2, {"BTC": 8}
EXPONENTS = {c: OTHER_PLACES.get(c, PLACES) for c in sorted({*CURRENCY_NAMES.values(), "UGX"})}


def two_places(text: Column) -> Column:
    """'12.34' to 1234; null for anything that isn't plain decimal text with at most two places."""
    ok = text.rlike(r"^[0-9]+(\.[0-9]{1,2})?$")
    return F.when(ok, (text.cast("decimal(38,2)") * 100).cast("long"))


def any_decimal(text: Column) -> tuple[Column, Column, Column]:
    """(minor, expanded, rounded): any decimal text, scientific included, half-even beyond two places."""
    d = text.try_cast("decimal(38,18)")
    minor = F.bround(d * 100, 0).cast("long")
    return minor, text.rlike("[eE]"), d.isNotNull() & (d * 100 != minor)


def by_currency(text: Column, currency: Column) -> Column:
    """Minor units by the currency's own exponent; null if the text is finer than that or the currency unknown."""
    e = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXPONENTS.items() for x in kv]), currency)
    d = text.try_cast("decimal(38,8)")
    scaled = d * F.pow(F.lit(10), e).cast("decimal(10,0)")
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def to_text(minor: Column) -> Column:
    """1234 to '12.34'."""
    a = F.abs(minor)
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.call_function("div", a, F.lit(100)).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def scaled(minor: Column, numerator: Column, denominator: Column | int = MICRO) -> Column:
    """minor * numerator / denominator, one rounding, ties toward +infinity, exact."""
    n = minor.cast("decimal(38,0)") * numerator.cast("decimal(18,0)")
    d = F.lit(denominator).cast("decimal(18,0)") if isinstance(denominator, int) else denominator.cast("decimal(18,0)")
    top, low = (2 * n + d).cast("decimal(38,0)"), (2 * d).cast("decimal(38,0)")
    r = F.pmod(top, low)  # floor division: take the remainder off first, then divide evenly
    return ((top - r) / low).cast("decimal(38,0)").cast("long")


def to_micro(ratio: Column) -> Column:
    """A ratio as integer millionths."""
    return F.round(ratio * MICRO).cast("long")
