"""Chronological splits (SRT-01 to SRT-08). No split needs a global row number: a cut is a (date, id) found from counts per day."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.session import cut

PARTS = 4096


@dataclass(frozen=True)
class Cut:
    """Rows from (day, fight_id) on come after the cut; without an id, the whole day does; without a day, none."""

    day: date | None
    fight_id: int | None

    def after(self) -> Column:
        if self.day is None:
            return F.lit(False)
        if self.fight_id is None:
            return F.col("date") >= self.day
        return (F.col("date") > self.day) | ((F.col("date") == self.day) & (F.col("fight_id") >= self.fight_id))


def day_counts(rows: DataFrame) -> list[tuple[date, int]]:
    """(day, rows) in order: one number a day, whatever the rows."""
    return sorted((r["date"], r["n"]) for r in rows.filter("date is not null").groupBy("date").agg(F.count("*").alias("n")).collect())


def nth_cuts(rows: DataFrame, wanted: list[int], counts: list[tuple[date, int]] | None = None) -> list[Cut]:
    """The cuts before the rows of these numbers (from 0) in (date, fight_id) order.

    The days are counted once for all cuts. Of the days that a cut falls into, the ids are stored once; a cut's range of ids is split by
    counts per part of it until a part is one id, so no day is sorted in one task.
    """
    counts = day_counts(rows) if counts is None else counts
    ends = np.cumsum([n for _, n in counts])
    places = [int(np.searchsorted(ends, n, "right")) for n in wanted]
    inside = [(counts[k][0], n - int(ends[k]) + counts[k][1]) if k < len(counts) else (None, 0) for k, n in zip(places, wanted, strict=True)]
    days = sorted({d for d, left in inside if left})
    ids = cut(rows.filter(F.col("date").isin(days)).select("date", "fight_id")) if days else None
    return [Cut(d, _nth_id(ids.filter(F.col("date") == d), left) if left else None) for d, left in inside]


def _nth_id(day: DataFrame, want: int) -> int:
    low, high = day.agg(F.min("fight_id"), F.max("fight_id")).first()
    while low < high:
        width = (high - low) // PARTS + 1
        counts = day.filter(F.col("fight_id").between(low, high)).groupBy(F.expr(f"(fight_id - {low}) div {width}").alias("part")).agg(F.count("*").alias("n")).collect()  # PARTS rows at most
        for r in sorted(counts, key=lambda r: r["part"]):
            if want < r["n"]:
                low, high = low + r["part"] * width, min(high, low + (r["part"] + 1) * width - 1)
                break
            want -= r["n"]
    return low


def nth_cut(rows: DataFrame, n: int) -> Cut:
    """The cut before the row number ``n`` (from 0) in (date, fight_id) order."""
    return nth_cuts(rows, [n])[0]


def two_way(rows: DataFrame, test: float = 0.2, on: date | None = None) -> DataFrame:
    """Adds split: train or test. The cut rounds half to even; by date the test starts on the day."""
    if on is not None:
        return rows.withColumn("split", F.when(F.col("date") < on, "train").otherwise("test"))
    counts = day_counts(rows)
    (found,) = nth_cuts(rows, [round(sum(n for _, n in counts) * (1 - test))], counts)
    return rows.withColumn("split", F.when(found.after(), "test").otherwise("train"))


def three_way(rows: DataFrame, train: float = 0.70, calibration: float = 0.15, days: tuple[date, date] | None = None) -> DataFrame:
    """Adds split: train, calibration or test; every part must have rows."""
    if days is None and not (0 < train < 1 and 0 < calibration < 1 and train + calibration < 1):
        raise ValueError("fractions must be positive and leave a test part")
    if days is not None and days[0] >= days[1]:
        raise ValueError("the calibration must start before the test")
    counts = day_counts(rows)
    n = sum(k for _, k in counts)
    ends = [sum(k for d, k in counts if d < day) for day in days] if days else [round(n * train), round(n * (train + calibration))]
    if not 0 < ends[0] < ends[1] < n:
        raise ValueError("a part of the split is empty")
    first, second = [Cut(day, None) for day in days] if days else nth_cuts(rows, ends, counts)
    return rows.withColumn("split", F.when(second.after(), "test").when(first.after(), "calibration").otherwise("train"))


#: (end of fit, end of calibration, end of validation) as shares of the rows before the test. Fixed values.
FOLDS = ((0.55, 0.65, 0.75), (0.65, 0.75, 0.85), (0.75, 0.85, 1.00))
CONFIRMATION_FOLDS = ((0.45, 0.55, 0.65), (0.50, 0.60, 0.70), *FOLDS)


def fold_marks(rows: DataFrame, fractions: tuple[tuple[float, float, float], ...] = FOLDS) -> list[tuple[Column, Column, Column]]:
    """Conditions (fit, calibration, validation) of expanding windows, each before the next (SRT-05)."""
    counts = day_counts(rows)
    n = sum(k for _, k in counts)
    ends = sorted({x for each in fractions for x in each if x < 1})
    cuts = dict(zip(ends, nth_cuts(rows, [round(n * f) for f in ends], counts), strict=True))
    after = lambda f: cuts[f].after() if f < 1 else F.lit(False)
    return [(~after(a), after(a) & ~after(b), after(b) & ~after(c)) for a, b, c in fractions]


def folds(rows: DataFrame, fractions: tuple[tuple[float, float, float], ...] = FOLDS) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """The rows of expanding windows (SRT-05)."""
    return [tuple(rows.filter(m) for m in marks) for marks in fold_marks(rows, fractions)]


def live_window(rows: DataFrame, as_of: date, days: int = 730) -> DataFrame:
    """Rows up to ``as_of``; the last ``days`` days calibrate, all before train (SRT-06, INC-09)."""
    start = F.date_sub(F.lit(as_of), days)
    return rows.filter(F.col("date") <= as_of).withColumn("split", F.when(F.col("date") < start, "train").otherwise("calibration"))


def locked(rows: DataFrame, expected: dict[str, tuple[int, date, date]]) -> DataFrame:
    """Refuses a split whose counts and first and last days are not as stated (SRT-07)."""
    found = {r["split"]: (r["n"], r["first"], r["last"]) for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).collect()}
    if found != expected:
        raise ValueError(f"locked split differs: expected {expected}, found {found}")
    return rows


def noise_band_rank(candidates: list[dict], band: float = 0.002) -> list[dict]:
    """Greedy: all within the band of the best log loss, by Brier, then higher AUC, then fewer features (SRT-08)."""
    left, out = sorted(candidates, key=lambda c: c["log_loss"]), []
    while left:
        near = [c for c in left if c["log_loss"] <= left[0]["log_loss"] + band]
        near.sort(key=lambda c: (c["brier"], -(c.get("auc") or 0.0), c.get("n_features", 0)))
        out += near
        left = [c for c in left if all(c is not x for x in near)]
    return out
