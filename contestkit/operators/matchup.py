"""Projections over one row a bout (PRJ-01 to PRJ-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.functions.parse import age_at
from contestkit.functions.text import division_column

#: name -> (own rate X, opposing rate Y): (aX - bY) - (bX - aY)
NETS = {
    "striking_matchup_net_advantage": ("sig_strikes_landed_per_min", "sig_strikes_absorbed_per_min"),
    "striking_accuracy_matchup_net_advantage": ("striking_accuracy", "striking_defense"),
    "takedown_matchup_net_advantage": ("takedowns_per_15", "takedowns_allowed_per_15"),
    "takedown_accuracy_matchup_net_advantage": ("takedown_accuracy", "takedown_defense"),
    "control_matchup_net_advantage": ("control_time_per_15", "control_time_absorbed_per_15"),
    "knockdown_matchup_net_advantage": ("knockdown_rate", "knockdowns_absorbed_per_15"),
    "submission_matchup_net_advantage": ("submission_attempts_per_15", "submission_attempts_absorbed_per_15"),
}


def matchup(wide: DataFrame) -> DataFrame:
    """Net rates of each side against the other's defence, and three compounds; null if a part is."""
    c = F.col
    nets = {name: (c(f"{x}_a") - c(f"{y}_b")) - (c(f"{x}_b") - c(f"{y}_a")) for name, (x, y) in NETS.items()}
    landed, downs = "sig_strikes_landed_per_min", "takedowns_per_15"
    absorbed, allowed = "sig_strikes_absorbed_per_min", "takedowns_allowed_per_15"
    more = {
        "pace_pressure_advantage": (c(f"{landed}_a") + c(f"{downs}_a")) - (c(f"{landed}_b") + c(f"{downs}_b")),
        "opponent_pressure_absorption_advantage": (c(f"{absorbed}_b") + c(f"{allowed}_b")) - (c(f"{absorbed}_a") + c(f"{allowed}_a")),
        "matchup_history_missing": F.greatest(c("no_prior_stats_a"), c("no_prior_stats_b")),
    }
    if "reach_diff" in wide.columns:
        more["reach_volume_interaction"] = c("reach_diff") * (c(f"{landed}_a") + c(f"{landed}_b")) / 2
    return wide.withColumns(nets | more)


def division_interactions(wide: DataFrame, base: tuple[str, ...], divisions: list[str], column: str = "weight_class") -> DataFrame:
    """base x division: the base inside its division (null stays null), exactly 0 outside (PRJ-05)."""
    name = lambda b, d: f"{b}_x_{d.lower().replace(' ', '_').replace(chr(39), '')}"
    return wide.withColumns({name(b, d): F.when(F.col(column) == d, F.col(b).cast("double")).otherwise(F.lit(0.0)) for b in base for d in divisions})


def eligible_divisions(rows: DataFrame, column: str = "weight_class", least: int = 100, share: float = 0.01) -> DataFrame:
    """Divisions with at least ``least`` rows and that share of all, with their column name (AGG-04)."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.greatest(F.lit(least), F.ceil(F.count("*") * share)).alias("least"))
    return counts.crossJoin(F.broadcast(total)).filter("n >= least").select(column, "n", division_column(F.col(column)).alias("name"))  # one row on the right


def layoff_bucket(days_a: Column, days_b: Column) -> Column:
    """Seven groups of the longer layoff (PRJ-06)."""
    days = F.greatest(days_a, days_b)
    out = F.when(days_a.isNull() | days_b.isNull(), "Missing").when(days < 60, "Under 60 days")
    for first, bound in ((60, 120), (120, 240), (240, 365), (365, 730)):
        out = out.when(days < bound, f"{first}-{bound - 1} days")
    return out.otherwise("730+ days")


def dashboard_confidence(p: Column) -> Column:
    """Label of the higher side's probability (PRJ-07)."""
    return F.when(p >= 0.80, "Very high confidence").when(p >= 0.70, "High confidence").when(p >= 0.62, "Moderate confidence").when(p >= 0.55, "Slight lean").otherwise("Toss-up")


def ledger_confidence(p: Column) -> Column:
    """Label of either side's probability, on another ladder (PRJ-07)."""
    top = F.greatest(p, 1 - p)
    return F.when(top >= 0.8, "strong").when(top >= 0.7, "confident").when(top >= 0.6, "lean").otherwise("toss-up")


def coalesce_physical(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The bout's own value, else the entity's static one, which is text (PRJ-03)."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"static_{c}").try_cast("double")) for c in columns})


def age_or_born(age: Column, born: Column, day: Column) -> Column:
    """The bout's own age, else the one by date of birth (PRJ-04)."""
    return F.coalesce(age, age_at(born, day))


def prediction_input(rows: DataFrame, features: list[str]) -> DataFrame:
    """What a model sees of bouts to come: ids, weight class and features, under the names of predictions; results are left behind (PRJ-08)."""
    named = {"event_date": "date", "event_name": "event", "fighter_a": "fighter_a", "fighter_b": "fighter_b"}
    return rows.select(*[F.col(c).alias(n) for n, c in named.items()], *[c for c in ("weight_class",) if c in rows.columns], *features)
