"""Tax, differences and quantity tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAX = 1.1


def with_tax(price: Column, included: Column | None = None) -> Column:
    """A price with tax, rounded half to even; one that includes it already is returned as it is."""
    taxed = F.rint(price.cast("double") * TAX)
    return taxed if included is None else F.when(F.coalesce(included, F.lit(False)), price.cast("double")).otherwise(taxed)


def with_tax_unrounded(price: Column) -> Column:
    return price.cast("double") * TAX


def difference(base: Column, other: Column) -> Column:
    """What the other price is above the base price."""
    return other.cast("double") - base.cast("double")


def percent(base: Column, other: Column, rounding: str) -> Column:
    """The difference in percent of the base price; null without a base.

    ``rounding``: ``trunc`` cuts decimals, ``even`` rounds half to even, ``tenth`` keeps one decimal, half to even.
    """
    p = F.try_divide(difference(base, other), F.nullif(base.cast("double"), F.lit(0.0))) * 100
    return {"trunc": p.cast("int"), "even": F.rint(p).cast("int"), "tenth": F.bround(p, 1)}[rounding]


def tier(tiers: Column, quantity: Column, mode: str) -> Column:
    """The entry of a map from quantity to price that holds for ``quantity``: ``struct(quantity, value, exact)``, null for no tiers.

    ``ceil`` takes the least tier of at least the quantity, or the greatest there is; ``floor`` the greatest of at most it, or the least.
    """
    keys = F.map_keys(tiers)
    if mode == "ceil":
        key = F.coalesce(F.array_min(F.filter(keys, lambda k: k >= quantity)), F.array_max(keys))
    elif mode == "floor":
        key = F.coalesce(F.array_max(F.filter(keys, lambda k: k <= quantity)), F.array_min(keys))
    else:
        raise ValueError(f"no tier mode {mode!r}")
    return F.when(key.isNotNull() & quantity.isNotNull(), F.struct(key.alias("quantity"), F.element_at(tiers, key).alias("value"), (key == quantity).alias("exact")))


def tier_or_lowest(tiers: Column, quantity: Column) -> Column:
    """``struct(quantity, value)``: the exact tier of a given quantity, null if there is none; the least tier without a quantity."""
    key = F.coalesce(quantity.cast("int"), F.array_min(F.map_keys(tiers)))
    return F.struct(key.alias("quantity"), F.try_element_at(tiers, key).alias("value"))


#: Quantities that price tables usually have
COMMON_QUANTITIES = (100, 200, 300, 500, 1000, 2000, 3000, 5000, 10000)


def text_price(text: Column) -> Column:
    """The first price in won of a text."""
    return F.regexp_replace(F.regexp_extract(text, r"([\d,]+)\s*원", 1), ",", "").try_cast("long")


def text_min_quantity(text: Column) -> Column:
    """The first number before a unit of count."""
    return F.regexp_replace(F.regexp_extract(text, r"(?i)([\d,]+)\s*(?:개|EA|pcs)", 1), ",", "").try_cast("long")
