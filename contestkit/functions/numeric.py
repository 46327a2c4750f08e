"""Numbers: ratings, ratios, probabilities and prices (NUM-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def expected_score(a: Column, b: Column) -> Column:
    """Elo expectation of the first side."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (b - a) / 400.0))


def ratio(over: Column, under: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(under > 0, over / under)


def clip(p: Column) -> Column:
    return F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))


def logit(p: Column) -> Column:
    return F.ln(clip(p) / (1 - clip(p)))


def log_loss(p: Column, y: Column) -> Column:
    return F.when(y == 1, -F.ln(clip(p))).otherwise(-F.ln(1 - clip(p)))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_days(days: Column) -> Column:
    return F.log1p(days.cast("double"))


def american_to_decimal(odds: Column) -> Column:
    """Zero is no price."""
    return F.when(odds > 0, 1 + odds / 100.0).when(odds < 0, 1 + 100.0 / F.abs(odds))


def price_error(price: Column) -> Column:
    """Null for a valid decimal price."""
    return F.when(price.isNull(), "missing").when(F.isnan(price) | (F.abs(price) == F.lit(float("inf"))), "not_finite").when(price <= 1, "not_over_one")


def implied(price: Column) -> Column:
    return F.when(price_error(price).isNull(), 1.0 / price)


def fair_share(own: Column, other: Column) -> Column:
    """Proportional removal of the margin."""
    return own / (own + other)


def overround(own: Column, other: Column) -> Column:
    return own + other


def blend(weight: float, p1: Column, p2: Column) -> Column:
    return clip(weight * p1 + (1 - weight) * p2)
