"""Point-in-time history (WIN-03 to WIN-12): what was known before each bout.

Input is the long table, two rows a bout: fight_id, date, side (a/b), entity, opponent, won and statistics. All frames
share one window, partitioned by entity and ordered by (date, fight_id), so one shuffle and one sort serve them all;
``to_bouts`` brings the sides back to one row with a second one. No frame includes the current row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from contestkit.functions.numeric import log_days, ratio

RECORD = ("prior_fights", "prior_wins", "prior_losses", "prior_win_pct")
FORM = tuple(f"{c}_last_{n}" for n in (3, 5) for c in ("wins", "win_pct"))
ROLLING = (
    "sig_strikes_landed_per_min", "sig_strikes_absorbed_per_min", "sig_strike_differential", "striking_accuracy", "striking_defense", "knockdown_rate",
    "takedowns_per_15", "takedown_accuracy", "takedown_defense", "control_time_per_15", "submission_attempts_per_15",
)
AGAINST = ("takedowns_allowed_per_15", "opp_takedown_attempts_per_15", "opp_sig_str_attempted_per_min", "control_time_absorbed_per_15", "knockdowns_absorbed_per_15", "submission_attempts_absorbed_per_15")
LAYOFF = ("layoff_days", "layoff_missing", "log_layoff_days", "short_turnaround", "long_layoff", "extreme_layoff")
SUMMED = ("minutes", "kd", "sl", "sa", "opp_sl", "opp_sa", "tdl", "tda", "opp_tdl", "opp_tda", "sub", "ctrl", "opp_kd", "opp_sub", "opp_ctrl")


def by_entity() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("date", "fight_id")


def before() -> WindowSpec:
    return by_entity().rowsBetween(Window.unboundedPreceding, -1)


def record(long: DataFrame) -> DataFrame:
    """Prior bouts, wins and losses (0 on debut) and the share of wins (null on debut)."""
    n, wins = F.count("*").over(before()), F.coalesce(F.sum("won").over(before()), F.lit(0))
    return with_losses(long.withColumns({"prior_fights": n, "prior_wins": wins}))


def with_losses(counted: DataFrame) -> DataFrame:
    """Adds prior_losses and prior_win_pct to prior_fights and prior_wins."""
    return counted.withColumns({"prior_losses": F.col("prior_fights") - F.col("prior_wins"), "prior_win_pct": ratio(F.col("prior_wins").cast("double"), F.col("prior_fights"))})


def form(long: DataFrame, sizes: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Wins in the last n bouts and their share of the bouts there are."""
    for n in sizes:
        frame = by_entity().rowsBetween(-n, -1)
        long = long.withColumn(f"wins_last_{n}", F.coalesce(F.sum("won").over(frame), F.lit(0))).withColumn(f"win_pct_last_{n}", F.avg(F.col("won").cast("double")).over(frame))
    return long


def activity(long: DataFrame) -> DataFrame:
    """Days since the previous bout, which may be on the same day."""
    return long.withColumn("days_since_last_fight", F.datediff("date", F.lag("date").over(by_entity())))


def layoff(long: DataFrame) -> DataFrame:
    """Days since the latest earlier day with a bout, and functions of them; same-day bouts do not count."""
    day = F.datediff("date", F.to_date(F.lit("1970-01-01")))
    earlier = Window.partitionBy("entity").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return with_layoff_flags(long.withColumn("day", day).withColumn("layoff_days", F.col("day") - F.max("day").over(earlier)).drop("day"))


def with_layoff_flags(long: DataFrame) -> DataFrame:
    """Adds what follows from layoff_days."""
    days = F.col("layoff_days")
    flag = lambda c: c.cast("int")  # noqa: E731  null stays null
    return long.withColumns({"layoff_missing": days.isNull().cast("int"), "log_layoff_days": log_days(days), "short_turnaround": flag(days < 60), "long_layoff": flag(days >= 365), "extreme_layoff": flag(days >= 730)})


def contributions(strict: bool = False) -> dict[str, Column]:
    """What a bout adds to each total of ``SUMMED``, and to their number ``n``; null for a bout that does not count.

    A missing component adds 0; with ``strict`` such bouts are left out as a whole.
    """
    # a side without minutes of its own takes the other's
    minutes = F.coalesce(F.nullif("minutes", F.lit(0.0)), F.col("opp_minutes"), F.lit(0.0))
    usable = minutes > 0
    both = F.col("has_stats") & F.col("opp_has_stats") & usable
    if strict:
        both = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in SUMMED], both)
    return {c: F.when(both, minutes if c == "minutes" else F.coalesce(F.col(c), F.lit(0.0))) for c in SUMMED} | {"n": F.when(both, F.lit(1))}


def rates(long: DataFrame, strict: bool = False) -> DataFrame:
    """Rates over all earlier bouts with both sides' statistics and positive minutes."""
    each = contributions(strict)
    totals = {f"t_{c}": F.coalesce(F.sum(v).over(before()), F.lit(0.0)) for c, v in each.items() if c != "n"}
    return with_rates(long.withColumns(totals | {"t_n": F.count(each["n"]).over(before())}))


def with_rates(summed: DataFrame) -> DataFrame:
    """Replaces the totals t_* by the rates they make."""
    t = lambda c: F.col(f"t_{c}")
    per = lambda c, m: F.when(t("minutes") > 0, t(c) / t("minutes") * m)
    minute_control = lambda c: F.when(t("minutes") > 0, t(c) / 60.0 / t("minutes") * 15)
    missed = lambda got, tried: F.when(t("minutes") > 0, 1 - ratio(t(got), t(tried)))
    share = lambda got, tried: F.when(t("minutes") > 0, ratio(t(got), t(tried)))
    out = {
        "sig_strikes_landed_per_min": per("sl", 1), "sig_strikes_absorbed_per_min": per("opp_sl", 1), "sig_strike_differential": per("sl", 1) - per("opp_sl", 1),
        "striking_accuracy": share("sl", "sa"), "striking_defense": missed("opp_sl", "opp_sa"), "knockdown_rate": per("kd", 15),
        "takedowns_per_15": per("tdl", 15), "takedown_accuracy": share("tdl", "tda"), "takedown_defense": missed("opp_tdl", "opp_tda"),
        "control_time_per_15": minute_control("ctrl"), "submission_attempts_per_15": per("sub", 15),
        "takedowns_allowed_per_15": per("opp_tdl", 15), "opp_takedown_attempts_per_15": per("opp_tda", 15), "opp_sig_str_attempted_per_min": per("opp_sa", 1),
        "control_time_absorbed_per_15": minute_control("opp_ctrl"), "knockdowns_absorbed_per_15": per("opp_kd", 15), "submission_attempts_absorbed_per_15": per("opp_sub", 15),
    }
    flagged = summed.withColumns(out).withColumn("no_prior_stats", ((t("n") == 0) | (t("minutes") <= 0)).cast("int"))
    return flagged.drop(*[f"t_{c}" for c in (*SUMMED, "n")])


def to_bouts(long: DataFrame, columns: tuple[str, ...], diffs: bool = True) -> DataFrame:
    """One row a bout: column_a, column_b and, if wanted, a - b (null if either is); also date, ids and a_won."""
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    keys = [F.max(F.when(F.col("side") == "a", F.col(c))).alias(n) for c, n in (("entity", "a_id"), ("opponent", "b_id"), ("won", "a_won"))]
    wide = long.groupBy("fight_id", "date").agg(*keys, *[side(c, s) for c in columns for s in "ab"])
    return wide.withColumns({f"{c}_diff": F.col(f"{c}_a") - F.col(f"{c}_b") for c in columns}) if diffs else wide


def features(long: DataFrame) -> DataFrame:
    """All history features, one row a bout."""
    known = rates(layoff(activity(form(record(long)))))
    return to_bouts(known, (*RECORD, *FORM, "days_since_last_fight", *LAYOFF, *ROLLING, *AGAINST, "no_prior_stats"))


#: Predictions that a task holds when it takes trailing means, about.
RANGE = 50_000


def positions(rows: DataFrame, order: tuple[str, str], within: str, width: int = RANGE) -> DataFrame:
    """Adds _at, the position of a row in its group by day and number (from 0).

    Rows are counted by day and range of numbers, ``width`` numbers or so a range and finer for a day that holds more; each range is ranked on its own, so
    that no day, however hot, is one task.
    """
    day, key = order
    spread = rows.groupBy(within, day).agg(F.count("*").alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high"))
    # ranges of a day's numbers: as many as it has rows for; numbers that lie unevenly make uneven ranges, which are still counted right
    step = F.greatest(F.lit(1), F.ceil((F.col("_high") - F.col("_low") + 1) / F.greatest(F.lit(1), F.ceil(F.col("_n") / width)))).cast("long")
    placed = rows.join(spread.select(within, day, "_low", step.alias("_step")), [within, day]).withColumn("_range", F.expr(f"({key} - _low) div _step")).drop("_low", "_step")
    counts = placed.groupBy(within, day, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(within, day, "_range", (F.sum("_n").over(Window.partitionBy(within).orderBy(day, "_range")) - F.col("_n")).alias("_before"))  # a row a range
    nth = F.row_number().over(Window.partitionBy(within, day, "_range").orderBy(key)) - 1
    return placed.join(before, [within, day, "_range"]).withColumn("_at", F.col("_before") + nth).drop("_before", "_range")


def trailing(predictions: DataFrame, measures: dict[str, Column], size: int, order: tuple[str, str] = ("date", "fight_id"), within: str = "model") -> DataFrame:
    """Means of the last ``size`` predictions within a group; null until there are so many (WIN-11).

    Every prediction's position comes from counts; ranges of positions are windowed apart, each with the ``size`` - 1 predictions before it, so
    a group of any size is spread over tasks.
    """
    width = max(RANGE, 2 * size)
    placed = positions(predictions, order, within).withColumn("_own", F.expr(f"_at div {width}"))
    shown = F.when(F.col("_at") % width > width - size, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    frame = Window.partitionBy(within, "_part").orderBy("_at").rowsBetween(1 - size, 0)
    full = F.col("_at") >= size - 1
    out = placed.withColumn("_part", F.explode(shown)).withColumns({f"{name}_{size}": F.when(full, F.avg(c).over(frame)) for name, c in measures.items()} | {f"status_{size}": F.when(full, "ok").otherwise("insufficient_sample")})
    return out.filter("_part = _own").drop("_at", "_own", "_part")


def one_to_one(left: DataFrame, right: DataFrame, key: str = "fight_id") -> DataFrame:
    """Left join of two tables of one row a key; a repeated key on either side, or a lost row, is an error (JOIN-05)."""
    for name, rows in (("left", left), ("right", right)):
        if rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").take(1):
            raise ValueError(f"{key} repeats on the {name} side")
    return left.join(right, key, "left")


def seen(sides: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(slug, first_seen, last_seen) of the days on which slugs appear, widened by what is stored already (WIN-16)."""
    now = sides.filter("slug is not null").groupBy("slug").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    both = now if stored is None else now.unionByName(stored.select("slug", "first_seen", "last_seen"))
    return both.groupBy("slug").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def latest(rows: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """The newest row of each key, as an aggregate: partial maxima before the shuffle (WIN-01, WIN-13)."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("newest")
    return rows.groupBy(key).agg(newest).select(key, "newest.*")


def keep_first(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of equal keys (WIN-14)."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")


def cut_offs(rows: DataFrame, least_train: int, calibration: int) -> DataFrame:
    """Per event day: rows strictly before it, cut to training and the last ``calibration`` ones (WIN-15)."""
    per_day = rows.groupBy("date").agg(F.count("*").alias("n"))
    prior = F.coalesce(F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a day
    counted = per_day.withColumn("prior", prior)
    return counted.withColumn("train_n", F.greatest(F.col("prior") - calibration, F.lit(0))).withColumn("ready", F.col("prior") >= least_train + calibration)
