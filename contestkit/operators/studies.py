"""Whole studies over splits and folds (EXP-04, EXP-06, EXP-08 to EXP-11, EXP-13). Loops are over candidates and folds, never over rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from statistics import fmean, pstdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.functions.numeric import blend, clip, log_loss
from contestkit.operators import batch, quantiles, rules
from contestkit.operators.batch import Candidate
from contestkit.operators.experiments import blend_robust, layoff_recommendation, part, promote_rule, scores, stability, weak_features
from contestkit.operators.filters import leaking, market_names
from contestkit.operators.matchup import division_interactions, eligible_divisions
from contestkit.operators.metrics import evaluate
from contestkit.operators.models import Fitted, Isotonic, Platt, boosted, fitted, logistic, permutation_importance
from contestkit.operators.splits import CONFIRMATION_FOLDS, fold_marks
from contestkit.session import cut

Fit = Callable[[DataFrame], Fitted]
Window = tuple[DataFrame, DataFrame, DataFrame]

#: Settings of the boosting searches: the grid, the audit's coarse grid, and the finer values that surround its best point. Fixed values.
GRID = {"rate": (0.03, 0.05, 0.1), "leaves": (15, 31), "least_leaf": (50, 100), "l2": (0.0, 1.0)}
COARSE = {"rate": (0.03, 0.1), "leaves": (3, 7, 15, 31), "least_leaf": (20, 100), "l2": (0.0, 1.0)}
FINE = {"rate": (0.01, 0.03, 0.05, 0.1), "leaves": (3, 7, 15, 31), "least_leaf": (10, 20, 50, 100), "l2": (0.0, 0.01, 0.1, 1.0)}
ROUNDS, HELD = 400, 0.1


@dataclass(frozen=True)
class Trial:
    """One candidate's calibrated scores on each validation window, and its models."""

    name: str
    by_fold: list[dict]
    fits: list[Fitted]

    @property
    def losses(self) -> list[float]:
        return [f["log_loss"] for f in self.by_fold]

    def summary(self, against: Trial | None = None) -> dict:
        """Means and population deviations over the folds, and folds won (AGG-15); folds are compared by their number (JOIN-19)."""
        out = {"name": self.name, "n_folds": len(self.by_fold)}
        for key in ("log_loss", "brier", "accuracy", "auc"):
            values = [f[key] for f in self.by_fold if f.get(key) is not None]
            out |= {key: fmean(values) if values else None, f"{key}_sd": pstdev(values) if values else None}
        if against is not None:
            gains = [b - a for a, b in zip(self.losses, against.losses, strict=True)]
            out |= {"gain": fmean(gains), "folds_won": sum(g > 0 for g in gains), "gains": gains}
        return out


def judged(base: Fitted, window: Window, label: str) -> tuple[dict, DataFrame]:
    """(scores, predictions) on the window's last part, calibrated by Platt on its second."""
    _, calibration, validation = window
    base.calibrator = Platt().fit(base.predict(calibration, calibrated=False).withColumn("y", F.col(label)))
    out = base.predict(validation)
    return scores(out, label), out


def trial(name: str, fit: Fit, windows: Windows, label: str) -> Trial:
    each = [windows[k] for k in range(len(windows))]
    fits = [fit(w[0]) for w in each]
    return Trial(name, [judged(f, w, label)[0] for f, w in zip(fits, each, strict=True)], fits)


@dataclass(frozen=True)
class Windows:
    """Rows that are stored once, and the conditions of their windows."""

    rows: DataFrame
    marks: list[tuple[Column, Column, Column]]

    @classmethod
    def of(cls, rows: DataFrame, fractions: tuple = CONFIRMATION_FOLDS) -> Windows:
        stored = cut(rows)
        return cls(stored, fold_marks(stored, fractions))

    def __getitem__(self, k: int) -> Window:
        return tuple(self.rows.filter(m) for m in self.marks[k])

    def __len__(self) -> int:
        return len(self.marks)


def trials(candidates: dict[str, Fit | Candidate], windows: Windows, label: str, parallel: int = 4) -> dict[str, Trial]:
    """Logistic candidates are fitted, calibrated and scored together; others by their functions, a few at a time."""
    together = [c for c in candidates.values() if isinstance(c, Candidate)]
    found: dict[str, Trial] = {}
    if together:
        fits = batch.fit(windows.rows, label, windows.marks, together)
        fits.calibrate()
        names = [n for n, c in candidates.items() if isinstance(c, Candidate)]
        found = {n: Trial(n, own, [fitted(fits, k, w) for w in range(len(windows))]) for k, (n, own) in enumerate(zip(names, fits.scores(), strict=True))}
    others = {n: c for n, c in candidates.items() if n not in found}
    with ThreadPoolExecutor(parallel) as pool:
        found |= dict(zip(others, pool.map(lambda c: trial(c[0], c[1], windows, label), others.items()), strict=True))
    return {n: found[n] for n in candidates}


def refit(candidate: Fit | Candidate, rows: DataFrame, label: str) -> Fitted:
    """A candidate on rows of its own."""
    return logistic(rows, candidate.features, label, candidate.c, candidate.l1_ratio) if isinstance(candidate, Candidate) else candidate(rows)


def split_window(rows: DataFrame) -> Window:
    return part(rows, "train"), part(rows, "calibration"), part(rows, "test")


def layoff_study(rows: DataFrame, base: list[str], candidates: dict[str, list[str]], label: str, bucket: str | None = None) -> dict:
    """The locked split's test loss with each list of layoff features added, by bucket of layoff as well, and whether any is confirmed (EXP-04)."""
    window, out = split_window(cut(rows)), {}
    for name, more in {"baseline": [], **candidates}.items():
        score, predicted = judged(logistic(window[0], base + more, label), window, label)
        if bucket:
            score["by_bucket"] = {r[bucket]: r.asDict() for r in evaluate(predicted.withColumn("y", F.col(label).cast("int")), (bucket,)).collect()}
        out[name] = score
    deltas = {n: s["log_loss"] - out["baseline"]["log_loss"] for n, s in out.items() if n != "baseline"}
    return {"models": out, "deltas": deltas, "recommendation": layoff_recommendation(deltas)}


def feature_audit(rows: DataFrame, features: list[str], label: str) -> dict:
    """Names that could leak, features by group of kind, scaling fitted on train against all rows, and weak features (EXP-06)."""
    rows = cut(rows)
    train, test = part(rows, "train"), part(rows, "test")
    found = logistic(train, features, label)
    whole = rows.agg(*[x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first().asDict()
    scaling = [{"feature": c, "train_mean": found.prep.means[c], "train_deviation": found.prep.deviations[c], "all_mean": whole[f"m_{c}"], "all_deviation": whole[f"s_{c}"], "train_only": found.prep.means[c] != whole[f"m_{c}"]} for c in features]
    importance = {r["feature"]: r["importance"] for r in permutation_importance(found, test, label, features)}
    ranked = [{**r, "importance": importance[r["feature"]]} for r in found.coefficients()]
    kind = lambda c: "difference" if c.endswith("_diff") else "interaction" if "_x_" in c else "flag" if c.endswith(("missing", "_stats")) else "other"
    return {"leaking": leaking(features), "markets": market_names(features), "kinds": {c: kind(c) for c in features}, "scaling": scaling, "features": ranked, "weak": weak_features(ranked)}


def confirmation(pretest: DataFrame, test: DataFrame, candidates: dict[str, Fit | Candidate], official: str, label: str, fragile: Callable[[str], bool] = lambda name: False, leakage_ok: bool = True) -> dict:
    """Five expanding folds, coefficient stability over them, and a recommendation (EXP-08, AGG-21).

    The best candidate but the official one is fitted once more on all but the last calibration window and judged on test.
    """
    windows, test = Windows.of(pretest), cut(test)
    found = trials(candidates, windows, label)
    summaries = {n: t.summary(found[official]) for n, t in found.items()}
    best = min((n for n in found if n != official), key=lambda n: summaries[n]["log_loss"])
    last = (windows[-1][0].unionByName(windows[-1][1]), windows[-1][2], test)
    final = {n: judged(refit(candidates[n], last[0], label), last, label)[0] for n in (official, best)}
    own = summaries[best]
    stable = {n: sparsity(t.fits) for n, t in found.items()}
    promoted = promote_rule(own["gain"], own["folds_won"], own["n_folds"], final[official]["log_loss"] - final[best]["log_loss"], own["brier"] <= summaries[official]["brier"] and final[best]["brier"] <= final[official]["brier"], leakage_ok, fragile(best))
    return {"summaries": summaries, "stability": stable, "best": best, "final": final, "promote": promoted}


def sparsity(fits: list[Fitted]) -> dict:
    """Coefficients over folds: per feature as ``stability`` gives them, and how many are zero in all, some or no folds."""
    per = stability(fits)
    n = len(fits)
    return {"features": per, "always": sum(r["nonzero"] == n for r in per), "sometimes": sum(0 < r["nonzero"] < n for r in per), "never": sum(r["nonzero"] == 0 for r in per), "sign_flips": [r["feature"] for r in per if r["sign_flip"]]}


def interaction_study(pretest: DataFrame, numeric: list[str], bases: dict[str, tuple[str, ...]], label: str, c: float = 0.003, l1_ratio: float = 0.1, column: str = "weight_class") -> dict:
    """Interactions of features and divisions against the plain model (EXP-09). Divisions are those with enough rows before the test.

    bases: a name and the features that interact. An interaction is stable if its coefficient is not zero in most folds and has one sign.
    """
    pretest = cut(pretest)
    divisions = [r[column] for r in eligible_divisions(pretest, column).select(column).collect()]  # a dimension
    wide, plain = {}, {"plain": Candidate("plain", numeric, c, l1_ratio)}
    for name, own in bases.items():
        made = [x for x in division_interactions(pretest, own, divisions, column).columns if x not in pretest.columns]
        wide[name] = (own, made)
    with_all = division_interactions(pretest, tuple({b: 0 for own, _ in wide.values() for b in own}), divisions, column)
    fit = {n: Candidate(n, numeric + made, c, l1_ratio) for n, (_, made) in wide.items()}
    found = trials(plain | fit, Windows.of(with_all), label)
    out = {}
    for name, (_, made) in wide.items():
        per = {r["feature"]: r for r in stability(found[name].fits)}
        stable = [x for x in made if per[x]["nonzero"] > len(CONFIRMATION_FOLDS) / 2 and not per[x]["sign_flip"]]
        own = found[name].summary(found["plain"])
        out[name] = own | {"stable": stable, "nonzero": sum(per[x]["nonzero"] > 0 for x in made), "include": rules.include_interactions(own["gain"], own["folds_won"], stable)}
    return {"divisions": divisions, "plain": found["plain"].summary(), "candidates": out}


def points(grid: dict[str, tuple]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def around(best: dict, fine: dict[str, tuple] = FINE) -> list[dict]:
    """All points one step or none from the best in each setting's finer values."""
    near = {k: tuple(v for v in fine[k] if abs(fine[k].index(v) - fine[k].index(best[k])) <= 1) for k in fine}
    return points(near)


def boosting(numeric: list[str], label: str, setting: dict, rounds: int = ROUNDS) -> Fit:
    """Trees grown by leaves, with the point's leaves, rate, smallest leaf and L2 penalty."""
    return lambda rows: boosted(rows, numeric, label, rounds, setting["leaves"], setting["rate"], setting["least_leaf"], setting["l2"], held=HELD)


def _label(setting: dict) -> str:
    return "boosted_" + "_".join(f"{k}{v}" for k, v in setting.items())


def boosting_trials(numeric: list[str], label: str, settings: list[dict], windows: Windows, rounds: int = ROUNDS) -> dict[str, tuple[dict, Trial]]:
    named = {_label(s): s for s in reversed(settings)}
    found = trials({n: boosting(numeric, label, s, rounds) for n, s in named.items()}, windows, label)
    return {n: (named[n], t) for n, t in found.items()}


def blend_study(windows: Windows, linear: list[Fitted], other: list[Fitted], label: str, steps: int = 11) -> dict:
    """Each weight's mean validation loss over the folds, the best one, and whether its gain is robust; one aggregation a fold (EXP-10)."""
    weights = [k / (steps - 1) for k in range(steps)]
    table = []
    for k, (a, b) in enumerate(zip(linear, other, strict=True)):
        validation = windows[k][2]
        both = b.predict(a.predict(validation).withColumnRenamed("p", "p1")).withColumnRenamed("p", "p2")
        row = both.agg(*[F.avg(log_loss(blend(w, F.col("p1"), F.col("p2")), F.col(label))).alias(f"w{n}") for n, w in enumerate(weights)]).first()
        table.append([row[f"w{w}"] for w in range(steps)])
    means = [fmean(fold[k] for fold in table) for k in range(steps)]
    best = min(range(steps), key=means.__getitem__)
    own = [weights[min(range(steps), key=fold.__getitem__)] for fold in table]
    gains = [fold[-1] - fold[best] for fold in table]
    return {"weights": weights, "means": means, "best_weight": weights[best], "best": means[best], "linear": means[-1], "other": means[0], "gains": gains, "fold_weights": own, "robust": blend_robust(gains, own)}


def nonlinear_study(pretest: DataFrame, test: DataFrame, numeric: list[str], label: str, grid: list[dict] | None = None, c: float = 0.003, l1_ratio: float = 0.1, rounds: int = ROUNDS, leakage_ok: bool = True) -> dict:
    """The boosting grid and blends with the linear anchor on five folds; the best of each on test (EXP-10)."""
    windows, test = Windows.of(pretest), cut(test)
    linear = Candidate("linear", numeric, c, l1_ratio)
    anchor = trials({"linear": linear}, windows, label)["linear"]
    found = boosting_trials(numeric, label, grid or points(GRID), windows, rounds)
    summaries = {n: t.summary(anchor) | {"setting": s} for n, (s, t) in found.items()}
    best = min(summaries, key=lambda n: summaries[n]["log_loss"])
    mixed = blend_study(windows, anchor.fits, found[best][1].fits, label)
    last = (windows[-1][0].unionByName(windows[-1][1]), windows[-1][2], test)
    a, b = refit(linear, last[0], label), boosting(numeric, label, found[best][0], rounds)(last[0])
    final = {"linear": judged(a, last, label)[0], best: judged(b, last, label)[0]}
    both = b.predict(a.predict(test).withColumnRenamed("p", "p1")).withColumnRenamed("p", "p2")
    final["blend"] = scores(both.withColumn("p", blend(mixed["best_weight"], F.col("p1"), F.col("p2"))), label)
    own, anchor_test = summaries[best], final["linear"]["log_loss"]
    return {
        "anchor": anchor.summary(), "summaries": summaries, "best": best, "blend": mixed, "final": final, "replace_now": False,
        "nonlinear_promotable": rules.nonlinear_promotable(own["gain"], own["folds_won"], final[best]["log_loss"], anchor_test, leakage_ok),
        "blend_promotable": rules.blend_promotable(mixed["best"], mixed["linear"], mixed["other"], final["blend"]["log_loss"], anchor_test, leakage_ok),
    }


def orientation(predicted: DataFrame, label: str) -> dict:
    """Whether probabilities point the right way: their mean is higher where the label is 1, and turning them round is worse (EXP-11)."""
    p, y = F.col("p"), F.col(label)
    r = predicted.agg(F.avg(F.when(y == 1, p)).alias("won"), F.avg(F.when(y == 0, p)).alias("lost"), F.avg(log_loss(p, y)).alias("loss"), F.avg(log_loss(1 - p, y)).alias("turned")).first()
    return {**r.asDict(), "ok": r["won"] is not None and r["lost"] is not None and r["won"] >= r["lost"] and r["loss"] <= r["turned"]}


def missingness(rows: DataFrame, features: list[str]) -> list[dict]:
    """Share of nulls of each feature in each part of the split, and the widest difference; one wide aggregation (EXP-11)."""
    table = {r["split"]: r for r in rows.groupBy("split").agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features]).collect()}  # three rows
    return [{"feature": c, **{s: r[c] for s, r in table.items()}, "spread": max(r[c] for r in table.values()) - min(r[c] for r in table.values())} for c in features]


def parity(frames: dict[str, DataFrame], label: str) -> dict:
    """Whether frames hold the same bouts with the same labels (EXP-11)."""
    marks = {n: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("fight_id", F.col(label).cast("int")).cast("decimal(38,0)"))).first()) for n, df in frames.items()}
    return {"rows": {n: m[0] for n, m in marks.items()}, "aligned": len(set(marks.values())) <= 1}


def distributions(predicted: DataFrame) -> dict:
    """Nine quantiles, mean and deviation of the probabilities (EXP-11)."""
    stored = cut(predicted.select("p"))
    r = stored.agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("deviation"), F.min("p").alias("low"), F.max("p").alias("high")).first()
    return {"deciles": quantiles.exact(stored, ["p"], tuple(k / 10 for k in range(1, 10)))[0]["p"]} | r.asDict()


def calibration_audit(base: Fitted, window: Window, label: str) -> dict:
    """Scores without calibration, by Platt and by isotonic regression; Platt keeps the order and so the area under the curve (EXP-11)."""
    _, calibration, validation = window
    held = base.predict(calibration, calibrated=False).withColumn("y", F.col(label).cast("int"))
    raw = base.predict(validation, calibrated=False)
    out = {"raw": scores(raw.withColumn("p", clip(F.col("p"))), label), "platt": scores(Platt().fit(held).apply(raw), label), "isotonic": scores(Isotonic().fit(held).apply(raw).withColumn("p", clip(F.col("p"))), label)}
    a, b = out["raw"]["auc"], out["platt"]["auc"]
    return out | {"auc_stable": a is None or b is None or abs(a - b) < 1e-6}


def sanity_audit(pretest: DataFrame, test: DataFrame, numeric: list[str], label: str, expected: dict[str, float], coarse: list[dict] | None = None, c: float = 0.003, l1_ratio: float = 0.1, rounds: int = ROUNDS) -> dict:
    """The audit of a search that found nothing (EXP-11): reproduction, orientation, parity, calibration, missing values, a staged search and its early stopping.

    expected: the earlier validation losses of ``linear`` and, if it was recorded, ``boosted``. The staged search goes over the coarse grid, then around
    its best point; each point is fitted once.
    """
    windows, test = Windows.of(pretest), cut(test)
    anchor = trials({"linear": Candidate("linear", numeric, c, l1_ratio)}, windows, label)["linear"]
    first = boosting_trials(numeric, label, coarse or points(COARSE), windows, rounds)
    start = min(first, key=lambda n: fmean(first[n][1].losses))
    refined = [s for s in around(first[start][0]) if _label(s) not in first]
    every = first | (boosting_trials(numeric, label, refined, windows, rounds) if refined else {})
    best = min(every, key=lambda n: fmean(every[n][1].losses))
    setting, tried = every[best]
    last = windows[-1]
    predicted = {"linear": anchor.fits[-1].predict(last[2]), "boosted": tried.fits[-1].predict(last[2])}
    turned = {n: orientation(p, label) for n, p in predicted.items()}
    aligned = parity(predicted, label)
    calibrations = {"linear": calibration_audit(anchor.fits[-1], last, label), "boosted": calibration_audit(tried.fits[-1], last, label)}
    marked = last[0].withColumn("split", F.lit("train")).unionByName(last[2].withColumn("split", F.lit("validation"))).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    mixed = blend_study(windows, anchor.fits, tried.fits, label)
    losses = {"linear": fmean(anchor.losses), "boosted": fmean(first[start][1].losses)}
    bugs = {"orientation": not all(t["ok"] for t in turned.values()), "parity": not aligned["aligned"], "calibration": not calibrations["boosted"]["auc_stable"]}
    gain = losses["linear"] - fmean(tried.losses)
    return {
        "coarse": len(first), "refined": len(every) - len(first), "best": best, "setting": setting, "summary": tried.summary(anchor), "rounds_used": [len(f.model.trees) for f in tried.fits],
        "reproduction": {n: (e, losses[n]) for n, e in expected.items()}, "orientation": turned, "parity": aligned, "calibration": calibrations, "missing": missingness(marked, numeric), "distributions": {n: distributions(p) for n, p in predicted.items()},
        "blend": mixed, "bugs": bugs, "result_is_real": rules.result_is_real({n: (e, losses[n]) for n, e in expected.items()}, bugs, gain > rules.BAND),
    }


def leakage_checks(windows: Windows | list[Window], test: DataFrame, features: list[str], allowed: frozenset[str] = frozenset()) -> dict[str, bool]:
    """All booleans of a study's leakage report (EXP-13): names, market tokens, order and disjointness of every window's parts, and of all of them and the test."""
    extent = lambda df: df.agg(F.min(F.struct("date", "fight_id")).alias("a"), F.max(F.struct("date", "fight_id")).alias("b")).first()
    before = lambda x, y: bool(x["b"] is None or y["a"] is None or tuple(x["b"]) < tuple(y["a"]))
    at = [[extent(p) for p in w] for w in windows]
    last = extent(test)
    keys = lambda df: df.select("fight_id")
    shared = any(keys(w[2]).join(keys(test), "fight_id", "left_semi").take(1) for w in windows)
    return {
        "names_ok": not leaking(features, allowed=allowed), "no_markets": not market_names(features), "fit_before_calibration": all(before(a, b) for a, b, _ in at), "calibration_before_validation": all(before(b, c) for _, b, c in at),
        "windows_grow": all(at[k][0]["a"] == at[0][0]["a"] and at[k][0]["b"] >= at[k - 1][0]["b"] for k in range(1, len(at))), "all_before_test": all(before(c, last) for _, _, c in at), "test_untouched": not shared,
    }
