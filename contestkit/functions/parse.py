"""Parsers of measurements, times and dates (PRS-*, DAT-*). Junk gives null, or zero where said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "d MMM yyyy", "yyyy/MM/dd")


def _int(c: Column) -> Column:
    return F.expr("try_cast(NULL AS INT)") if c is None else c.try_cast("int")


def landed_of_attempted(c: Column) -> Column:
    """'37 of 102' to struct (landed, attempted); junk to zeros."""
    part = lambda k: F.coalesce(_int(F.regexp_extract(c, r"^\s*(\d+)\s+of\s+(\d+)\s*$", k)), F.lit(0))
    return F.struct(part(1).alias("landed"), part(2).alias("attempted"))


def clock_seconds(c: Column) -> Column:
    """'m:ss' to seconds; junk to zero."""
    part = lambda k: _int(F.regexp_extract(c, r"^\s*(\d+):(\d+)\s*$", k))
    return F.coalesce(part(1) * 60 + part(2), F.lit(0))


def round_lengths(c: Column) -> Column:
    """'3 Rnd (5-5-5)' to [5, 5, 5]; unknown formats to five fives."""
    inner = F.regexp_extract(c, r"\((\d+(?:-\d+)*)\)", 1)
    return F.when(inner != "", F.transform(F.split(inner, "-"), lambda x: x.cast("int"))).otherwise(F.array(*[F.lit(5)] * 5))


def fight_minutes(lengths: Column, last_round: Column, clock: Column) -> Column:
    """Full rounds before the last, and the clock of the last."""
    done = F.slice(lengths, F.lit(1), F.greatest(last_round - 1, F.lit(0)))
    return F.aggregate(done, F.lit(0.0), lambda s, x: s + x) + clock_seconds(clock) / 60.0


def fight_minutes_of_fives(last_round: Column, clock: Column) -> Column:
    """As above for rounds of five minutes."""
    return F.greatest(last_round - 1, F.lit(0)) * 5.0 + clock_seconds(clock) / 60.0


def height_cm(c: Column) -> Column:
    """Feet and inches to centimetres, one decimal."""
    part = lambda k: F.regexp_extract(c, r"(\d+)'\s*(\d+)", k).try_cast("double")
    return F.round((part(1) * 12 + part(2)) * 2.54, 1)


def reach_cm(c: Column) -> Column:
    """Inches to centimetres; dashes are null."""
    inches = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.round(inches * 2.54, 1)


def weight_lbs(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def any_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that fits; a time after an ISO date is ignored."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.substring(c, 1, 10)).otherwise(F.trim(c))
    return F.coalesce(*[F.try_to_date(iso, f) for f in formats])


def age_at(born: Column, day: Column) -> Column:
    """Years to two decimals; null if born after the day."""
    return F.when(born <= day, F.round(F.datediff(day, born) / 365.25, 2))


def signed_age(born: Column, day: Column) -> Column:
    """Unrounded and maybe negative."""
    return F.datediff(day, born) / 365.25


def days_since(day: Column, earlier: Column) -> Column:
    """Days from an earlier day; null if there is none."""
    return F.datediff(day, earlier)


def utc_timestamp(c: Column) -> Column:
    """Only texts with an offset or Z are timestamps."""
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def utc_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window_start(day: Column, days: int) -> Column:
    return F.date_sub(day, days)


def days_around(day: Column) -> Column:
    """The day before, the day, the day after: turns a range join into an equi join."""
    return F.array(F.date_sub(day, 1), day, F.date_add(day, 1))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def year_of(day: Column) -> Column:
    return F.date_format(day, "yyyy")
