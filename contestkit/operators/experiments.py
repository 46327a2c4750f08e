"""Workflows over splits, feature sets and settings (EXP-01 to EXP-03, EXP-05, EXP-07, EXP-12, EXP-13) and their decision rules.

Loops on the driver are over candidates and folds, never over rows; logistic candidates are fitted together. Folds expand in time, so
random cross-validation is not used.
"""

from __future__ import annotations

from statistics import fmean, pstdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestkit.functions.numeric import blend, clip, log_loss
from contestkit.operators import batch
from contestkit.operators.filters import guard, leaking
from contestkit.operators.history import positions
from contestkit.operators.metrics import best_method, bundle, calibration_error, high_confidence
from contestkit.operators.models import OFFICIAL, Fitted, Isotonic, Platt, forest, logistic
from contestkit.operators.rules import effect
from contestkit.operators.splits import fold_marks, noise_band_rank
from contestkit.session import cut

BAND = 0.002
GRID_C = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0)
GRID_L1 = (0.1, 0.25, 0.5, 0.75, 0.9)


def scores(predicted: DataFrame, label: str) -> dict:
    return bundle(predicted.withColumn("y", F.col(label).cast("int"))).first().asDict()


def part(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("split") == name)


def train_and_evaluate(rows: DataFrame, numeric: list[str], label: str, expected: str, trees: int = 50) -> dict[str, dict]:
    """Rating alone, logistic regression and random forest on one two-way split (EXP-01)."""
    guard(numeric)
    train, test = part(rows, "train"), part(rows, "test")
    out = {"rating": scores(test.withColumn("p", F.col(expected)), label)}
    out["logistic"] = scores(logistic(train, numeric, label).predict(test), label)
    out["forest"] = scores(forest(train, numeric, label, trees).predict(test), label)
    return out


def compare_feature_sets(rows: DataFrame, sets: dict[str, list[str]], label: str) -> dict[str, dict]:
    """The same split and model for several feature lists (EXP-02)."""
    train, test = part(rows, "train"), part(rows, "test")
    return {name: scores(logistic(train, cols, label).predict(test), label) for name, cols in sets.items()}


def calibrate(rows: DataFrame, numeric: list[str], label: str, c: float = OFFICIAL["c"], l1_ratio: float = OFFICIAL["l1_ratio"]) -> dict:
    """Base model on train, Platt and isotonic on calibration, all on test; the method by rule (EXP-03)."""
    base = logistic(part(rows, "train"), numeric, label, c, l1_ratio)
    held = base.predict(part(rows, "calibration")).withColumn("y", F.col(label).cast("int"))
    test = base.predict(part(rows, "test"))
    n = held.count()
    platt, isotonic = Platt().fit(held), Isotonic().fit(held)
    results = {"uncalibrated": test, "platt": platt.apply(test), "isotonic": isotonic.apply(test)}
    out = {k: scores(v.withColumn("p", clip(F.col("p"))), label) for k, v in results.items()}
    for k, v in results.items():
        y = v.withColumn("y", F.col(label).cast("int"))
        out[k] |= {"ece": calibration_error(y).first()["ece"], "high_confidence": [r.asDict() for r in high_confidence(y).collect()]}
    return {"models": out, "best": best_method(out["platt"], out["isotonic"], n), "n_calibration": n}


def ablation(rows: DataFrame, groups: dict[str, list[str]], label: str) -> list[dict]:
    """All features against all but one group; helpful, harmful or neutral by the noise band (EXP-05). All models are fitted together."""
    every = [c for g in groups.values() for c in g]
    listed = [batch.Candidate("all", every), *(batch.Candidate(n, [c for c in every if c not in own]) for n, own in groups.items())]
    found = batch.fit(rows, label, [(F.col("split") == "train", F.lit(False), F.col("split") == "test")], listed).scores()
    rises = {c.name: own[0]["log_loss"] - found[0][0]["log_loss"] for c, own in zip(listed, found, strict=True)}
    return [{"group": n, "rise": rises[n], "effect": effect(rises[n], BAND)} for n in groups]


def candidates(cs: tuple[float, ...] = GRID_C, l1: tuple[float, ...] = GRID_L1) -> list[dict]:
    """L2 and L1 at every strength, elastic nets at every mix: 56 by default."""
    return [{"c": c, "l1_ratio": r} for r in (0.0, 1.0, *l1) for c in cs]


def search(pretest: DataFrame, configs: dict[str, list[str]], label: str, grid: list[dict] | None = None, fractions: tuple | None = None) -> list[dict]:
    """Mean validation scores of every candidate and feature list over expanding folds, calibrated by Platt, in noise-band order (EXP-07, EXP-08).

    All candidates and folds are fitted, calibrated and scored together, by passes over rows that are stored once.
    """
    stored = cut(pretest)
    windows = fold_marks(stored, fractions) if fractions else fold_marks(stored)
    listed = [(n, s) for n in configs for s in (grid or candidates())]
    fits = batch.fit(stored, label, windows, [batch.Candidate(n, configs[n], **s) for n, s in listed])
    fits.calibrate()
    out = []
    for (name, setting), found in zip(listed, fits.scores(), strict=True):
        losses = [f["log_loss"] for f in found]
        out.append({"config": name, **setting, "n_features": len(configs[name]), "folds": losses, "log_loss": fmean(losses), "brier": fmean(f["brier"] for f in found), "auc": fmean(f["auc"] if f["auc"] is not None else 0.5 for f in found), "sd": pstdev(losses)})
    return noise_band_rank(out)


def stability(fits: list[Fitted]) -> list[dict]:
    """Per feature over folds: mean and deviation of the coefficient, folds with a nonzero one, and whether signs differ."""
    by: dict[str, list[float]] = {}
    for f in fits:
        for row in f.coefficients():
            by.setdefault(row["feature"], []).append(row["coefficient"])
    return [{"feature": k, "mean": fmean(v), "sd": pstdev(v), "nonzero": sum(x != 0 for x in v), "sign_flip": min(v) < 0 < max(v)} for k, v in by.items()]


def blends(predicted: DataFrame, p1: str, p2: str, label: str, steps: int = 11) -> DataFrame:
    """Log loss of convex blends of two columns, all weights in one aggregation (EXP-10)."""
    weights = [k / (steps - 1) for k in range(steps)]
    sums = predicted.agg(*[F.avg(log_loss(blend(w, F.col(p1), F.col(p2)), F.col(label))).alias(f"w{k}") for k, w in enumerate(weights)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"w{k}").alias("log_loss")) for k, w in enumerate(weights)])).alias("r")).select("r.*")


#: Days that are replayed together.
TOGETHER = 50


def replay(rows: DataFrame, numeric: list[str], label: str, days: list, least_train: int, calibration: int, c: float = 1.0, l1_ratio: float = 0.0) -> DataFrame | None:
    """Event by event: train on all strictly before the day but the last ``calibration`` rows, which fit Platt; then predict the day (EXP-12).

    Rows are stored once with their positions, so a day's parts are ranges of positions. ``TOGETHER`` days are fitted and calibrated by one batch of passes, whose
    weights begin with those of the day before: the plan grows by a stored table for so many days, the jobs by a dozen. None if no day has enough rows before it.
    """
    placed = positions(rows.withColumn("_all", F.lit(True)), ("date", "fight_id"), "_all")
    stored = cut(placed.drop("_all", "_step"))
    counts = stored.groupBy("date").agg(F.count("*").alias("n")).orderBy("date").collect()  # a row a day
    total, at = 0, {}
    for r in counts:
        at[r["date"]] = (total, r["n"])
        total += r["n"]
    ready = [(at[d][0], at[d][1]) for d in days if d in at and at[d][0] >= least_train + calibration]
    out, start = None, None
    place = F.col("_at")
    between = lambda a, b: (place >= a) & (place < b)
    for k in range(0, len(ready), TOGETHER):
        windows = [(place < n - calibration, between(n - calibration, n), between(n, n + own)) for n, own in ready[k : k + TOGETHER]]
        last = ready[min(k + TOGETHER, len(ready)) - 1]
        fits = batch.fit(stored.filter(place < sum(last)), label, windows, [batch.Candidate("replay", numeric, c, l1_ratio)], ("fight_id", "date"), start)
        fits.calibrate()
        start = [fits.weights[0][-1]]
        now = cut(fits.predictions().select("fight_id", "date", "y", "p"))
        out = now if out is None else out.unionByName(now)
    return out


def leakage_report(columns: list[str], train: DataFrame, test: DataFrame, allowed: frozenset[str] = frozenset()) -> dict[str, bool]:
    """Booleans (EXP-13): no forbidden names, parts share no bout, all training is before the test."""
    shared = train.select("fight_id").join(test.select("fight_id"), "fight_id", "left_semi").take(1)
    last, first = train.agg(F.max(F.struct("date", "fight_id"))).first()[0], test.agg(F.min(F.struct("date", "fight_id"))).first()[0]
    return {"names_ok": not leaking(columns, allowed=allowed), "disjoint": not shared, "in_order": bool(last and first and tuple(last) < tuple(first))}


def layoff_recommendation(deltas: dict[str, float], band: float = BAND) -> str:
    return "confirm" if min(deltas.values()) <= -band else "keep_disabled"


def promote_rule(gain: float, folds_won: int, n_folds: int, test_gain: float, brier_not_worse: bool, leakage_ok: bool, fragile: bool, band: float = BAND) -> bool:
    return gain > band and folds_won == n_folds and test_gain > band and brier_not_worse and leakage_ok and not fragile and test_gain >= 1.5 * band


def blend_robust(gains: list[float], weights: list[float]) -> bool:
    """At least four folds improve, weights differ by 0.3 at most, and no fold holds over 60 % of the gain."""
    total = sum(g for g in gains if g > 0)
    return sum(g > 0 for g in gains) >= 4 and max(weights) - min(weights) <= 0.3 and (total == 0 or max(gains) <= 0.6 * total)


def weak_features(rows: list[dict]) -> list[str]:
    """Small coefficient (first quartile) and small importance."""
    import numpy as np

    bound = float(np.percentile([abs(r["coefficient"]) for r in rows], 25)) if rows else 0.0
    return [r["feature"] for r in rows if abs(r["coefficient"]) <= bound and abs(r["importance"]) <= 0.0005]
