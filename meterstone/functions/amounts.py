"""Credits and prices. Credits are decimal(38,6): their sums are exact and do not depend on order."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterstone.fixed_values import DEFAULT_RATES, SERVICE_PRICE_CLASS

CREDITS = "decimal(38,6)"
COST = "decimal(38,8)"


def credits(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(CREDITS)


def sum_or_zero(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast(CREDITS)).cast(CREDITS)


def cost(amount: Column, rate: Column | Decimal) -> Column:
    """Exact product of credits and dollars per credit."""
    price = rate if isinstance(rate, Column) else F.lit(rate)
    return (amount.cast("decimal(28,6)") * price.cast("decimal(8,2)")).cast(COST)


def rate_of(service: str, rates: Mapping[str, Decimal] | None = None) -> Column:
    """Dollars per credit of a service; a service without a class pays the standard rate."""
    prices = {**DEFAULT_RATES, **(rates or {})}
    pairs = []
    for name, price_class in SERVICE_PRICE_CLASS.items():
        pairs += [F.lit(name), F.lit(prices[price_class]).cast("decimal(8,2)")]
    listed = F.try_element_at(F.create_map(*pairs), F.col(service))
    return F.coalesce(listed, F.lit(prices["standard"]).cast("decimal(8,2)"))


def with_commas(amount: Column, places: int) -> Column:
    """Number as text with thousands separators."""
    return F.format_number(amount, places)


def fill(template: str, *values: Column) -> Column:
    """Text with its braces replaced in order. A NULL value makes the whole text NULL."""
    texts = template.split("{}")
    parts = [F.lit(texts[0])]
    for value, after in zip(values, texts[1:], strict=True):
        parts += [value.cast("string"), F.lit(after)]
    return F.concat(*parts)


def fraction(part: Column, whole: Column) -> Column:
    """Share rounded half-even to a tenth of a percent, as a fraction of one."""
    percent = part.cast("double") / whole.cast("double") * 100
    return (F.bround(percent, 1) / 100).cast("decimal(9,3)")
