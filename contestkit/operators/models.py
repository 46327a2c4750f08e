"""Probability models (ML-01 to ML-17) on MLlib, with exact preprocessing in expressions.

Medians are exact and deviations are those of the population, all from the fitting rows only; MLlib's own imputer and scaler
differ in both. A penalty strength C on a sum of losses is ``regParam = 1 / (C n)`` on MLlib's mean.
"""

from __future__ import annotations

import importlib
import importlib.util
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from contestkit.functions.numeric import logit
from contestkit.functions.text import canonical_json, schema_version
from contestkit.operators import batch, boosting, quantiles

#: The reference model's settings. Fixed values.
OFFICIAL = {"c": 0.003, "l1_ratio": 0.1}


#: Groups of the model's features; each feature is in one. Fixed values.
FEATURE_GROUPS = {
    "elo": ("elo_diff",),
    "physical": ("height_diff", "reach_diff"),
    "age": ("age_diff",),
    "experience": ("prior_fights_diff", "prior_wins_diff", "prior_losses_diff", "prior_win_pct_diff"),
    "recent_form": ("wins_last_3_diff", "win_pct_last_3_diff", "wins_last_5_diff", "win_pct_last_5_diff"),
    "activity": ("days_since_last_fight_diff",),
    "striking_rolling": ("sig_strikes_landed_per_min_diff", "sig_strikes_absorbed_per_min_diff", "sig_strike_differential_diff", "striking_accuracy_diff", "striking_defense_diff", "knockdown_rate_diff"),
    "grappling_rolling": ("takedowns_per_15_diff", "takedown_accuracy_diff", "takedown_defense_diff", "control_time_per_15_diff", "submission_attempts_per_15_diff"),
    "missing_flags": ("fighter_a_no_prior_stats", "fighter_b_no_prior_stats", "matchup_history_missing"),
    "opponent_adjusted": ("takedowns_allowed_per_15_diff", "opp_takedown_attempts_per_15_diff", "opp_sig_str_attempted_per_min_diff", "control_time_absorbed_per_15_diff", "knockdowns_absorbed_per_15_diff", "submission_attempts_absorbed_per_15_diff"),
    "matchup_style": (
        "striking_matchup_net_advantage", "striking_accuracy_matchup_net_advantage", "takedown_matchup_net_advantage", "takedown_accuracy_matchup_net_advantage", "control_matchup_net_advantage",
        "knockdown_matchup_net_advantage", "submission_matchup_net_advantage", "reach_volume_interaction", "pace_pressure_advantage", "opponent_pressure_absorption_advantage",
    ),
}


def check_groups(features: list[str], groups: dict[str, tuple[str, ...]] = FEATURE_GROUPS) -> None:
    """Raises unless the groups are a partition of the features (ML-16)."""
    counts = Counter(c for own in groups.values() for c in own)
    wrong = {"unknown": sorted(counts.keys() - set(features)), "in several groups": sorted(c for c, n in counts.items() if n > 1), "in none": sorted(set(features) - counts.keys())}
    if wrong := {k: v for k, v in wrong.items() if v}:
        raise ValueError(f"feature groups are no partition: {wrong}")


def columns_of(wanted: list[str], features: list[str], groups: dict[str, tuple[str, ...]] = FEATURE_GROUPS) -> list[str]:
    """The wanted groups' features, in the order of ``features``, on which an exact fit depends (ML-16)."""
    if unknown := [g for g in wanted if g not in groups]:
        raise ValueError(f"unknown groups {unknown}; known: {sorted(groups)}")
    chosen = {c for g in wanted for c in groups[g]}
    return [c for c in features if c in chosen]


@dataclass
class Preprocessor:
    """Median, mean and population deviation per feature, and known categories; fitted on the training rows in one aggregation."""

    numeric: list[str]
    categorical: str | None = None
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    categories: list[str] = field(default_factory=list)
    frequent: str | None = None
    impute: bool = True

    def fit(self, rows: DataFrame, mode: str = "all", least: int = 50, allowed: tuple[str, ...] = ()) -> Preprocessor:
        """mode of categories: all, none, allowlist or rare (at least ``least`` fitting rows)."""
        medians = quantiles.exact(rows, self.numeric)[0]
        self.medians = {c: (v[0] if v[0] is not None else 0.0) for c, v in medians.items()}
        filled = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(c) for c in self.numeric])
        stats = filled.agg(*[x for c in self.numeric for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first().asDict()
        self.means = {c: stats[f"m_{c}"] or 0.0 for c in self.numeric}
        self.deviations = {c: stats[f"s_{c}"] or 1.0 for c in self.numeric}
        if self.categorical and mode != "none":
            counts = {r[0]: r["n"] for r in rows.filter(F.col(self.categorical).isNotNull()).groupBy(self.categorical).agg(F.count("*").alias("n")).collect()}
            keep = {"all": lambda v, n: True, "allowlist": lambda v, n: v in allowed, "rare": lambda v, n: n >= least}[mode]
            self.categories = sorted(v for v, n in counts.items() if keep(v, n))
            self.frequent = min(counts, key=lambda v: (-counts[v], v)) if counts else None
        return self

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"{self.categorical}={v}" for v in self.categories)]

    def transform(self, rows: DataFrame, scale: bool = True) -> DataFrame:
        """Adds ``features``, a vector; unknown categories are all zeros. Without ``impute`` it is an array of the raw values, nulls included."""
        if not self.impute:
            return rows.withColumn("features", F.array(*map(boosting.value, self.numeric)))
        columns = {}
        for k, c in enumerate(self.numeric):
            value = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
            columns[f"_x{k}"] = (value - self.means[c]) / self.deviations[c] if scale else value
        for k, v in enumerate(self.categories, len(self.numeric)):
            columns[f"_x{k}"] = (F.coalesce(F.col(self.categorical), F.lit(self.frequent)) == v).cast("double")
        out = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows.withColumns(columns))
        return out.drop(*columns)


@dataclass
class Fitted:
    """A preprocessor, a classifier and maybe a calibrator."""

    prep: Preprocessor
    model: object
    scale: bool = True
    calibrator: object | None = None

    def predict(self, rows: DataFrame, calibrated: bool = True) -> DataFrame:
        """Adds p, the probability of label 1."""
        scored = self.model.transform(self.prep.transform(rows, self.scale))
        out = scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        return self.calibrator.apply(out) if calibrated and self.calibrator else out

    def coefficients(self) -> list[dict]:
        """Per feature: coefficient, sign and rank by size (ML-14)."""
        values = [float(x) for x in self.model.coefficients]
        order = sorted(range(len(values)), key=lambda k: -abs(values[k]))
        rank = {k: r for r, k in enumerate(order, 1)}
        return [{"feature": n, "coefficient": v, "sign": (v > 0) - (v < 0), "rank": rank[k], "median": self.prep.medians.get(n), "mean": self.prep.means.get(n), "deviation": self.prep.deviations.get(n)} for k, (n, v) in enumerate(zip(self.prep.names, values, strict=True))]


#: What an artifact's manifest must hold. Fixed values.
MANIFEST = ("prep", "calibrator", "model", "model_version", "calibration_version", "feature_schema_version", "scale", "training")
FAMILY = "features"


def save(fitted: Fitted, path: str, model_version: str, training: dict | None = None) -> str:
    """Writes a fitted model and its manifest to a new folder (ML-17); returns the feature schema's version."""
    spark = SparkSession.active()
    own = fitted.calibrator
    version = schema_version(fitted.prep.names, FAMILY)
    manifest = {
        "prep": asdict(fitted.prep), "scale": fitted.scale, "model": f"{type(fitted.model).__module__}.{type(fitted.model).__name__}", "model_version": model_version, "training": training or {},
        "calibrator": None if own is None else {"kind": type(own).__name__, **asdict(own)}, "calibration_version": "none" if own is None else type(own).__name__.lower(), "feature_schema_version": version,
    }
    spark.createDataFrame([(canonical_json(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    fitted.model.save(f"{path}/model")
    return version


def load(path: str, expected: list[str] | None = None) -> tuple[Fitted, dict]:
    """(model, manifest) as saved (ML-17). A manifest that lacks a field, or whose schema is not that of its own features or of ``expected``, is an error."""
    manifest = json.loads(SparkSession.active().read.text(f"{path}/manifest").first()["value"])
    if missing := [f for f in MANIFEST if f not in manifest]:
        raise ValueError(f"the artifact's manifest lacks {missing}")
    prep = Preprocessor(**manifest["prep"])
    for names in (prep.names, expected):
        if names is not None and schema_version(names, FAMILY) != manifest["feature_schema_version"]:
            raise ValueError(f"the artifact's features are {manifest['feature_schema_version']}, not {schema_version(names, FAMILY)}")
    own = manifest["calibrator"]
    calibrator = own and {"Platt": Platt, "Isotonic": Isotonic}[own["kind"]](**{k: v for k, v in own.items() if k != "kind"})
    module, _, name = manifest["model"].rpartition(".")
    return Fitted(prep, getattr(importlib.import_module(module), name).load(f"{path}/model"), manifest["scale"], calibrator), manifest


def logistic(rows: DataFrame, numeric: list[str], label: str, c: float = 1.0, l1_ratio: float = 0.0, categorical: str | None = None, balanced: bool = False, mode: str = "all", max_iter: int = 200, tol: float = 1e-8) -> Fitted:
    """L2 (l1_ratio 0), L1 (1) or elastic-net logistic regression (ML-04, ML-05, ML-12)."""
    prep = Preprocessor(numeric, categorical).fit(rows, mode)
    ready = prep.transform(rows).withColumn("_y", F.col(label).cast("double"))
    counts = {r["_y"]: r["n"] for r in ready.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        for value, own in counts.items():
            weight = F.when(F.col("_y") == value, n / (len(counts) * own)).otherwise(weight)
    fit = LogisticRegression(labelCol="_y", weightCol="_w", regParam=1 / (c * n), elasticNetParam=l1_ratio, standardization=False, maxIter=max_iter, tol=tol)
    return Fitted(prep, fit.fit(ready.withColumn("_w", weight)))


def fitted(found: batch.Batch, k: int, w: int) -> Fitted:
    """Candidate ``k`` of a batch in window ``w`` as a model of its own, with its calibrator if there is one."""
    figures, model = found.fitted_parts(k, w)
    calibrator = Platt(*map(float, found.platt[k][w])) if found.platt else None
    return Fitted(Preprocessor(found.candidates[k].features, **figures), model, calibrator=calibrator)


def forest(rows: DataFrame, numeric: list[str], label: str, trees: int = 300, least_leaf: int = 1, seed: int = 42) -> Fitted:
    prep = Preprocessor(numeric).fit(rows)
    fit = RandomForestClassifier(labelCol="_y", numTrees=trees, minInstancesPerNode=least_leaf, maxDepth=12, seed=seed)
    return Fitted(prep, fit.fit(prep.transform(rows, False).withColumn("_y", F.col(label).cast("double"))), scale=False)


def boosted(rows: DataFrame, numeric: list[str], label: str, rounds: int = 100, leaves: int = 31, rate: float = 0.1, least_leaf: int = 20, l2: float = 0.0, seed: int = 42, held: float = 0.0) -> Fitted:
    """Histogram boosting by leaves on raw values, missing ones included (ML-07).

    With ``held``, that share of the rows, by a hash of fight_id, stops the rounds once it gains nothing.
    """
    away = F.pmod(F.xxhash64("fight_id", F.lit(seed)), F.lit(1000)) < int(1000 * held) if held else None
    return Fitted(Preprocessor(numeric, impute=False), boosting.fit(rows, numeric, label, rounds, leaves, rate, least_leaf, l2, away), scale=False)


def boosters() -> list[str]:
    """The optional boosting libraries that can be fitted and are installed here (ML-08)."""
    return [n for n in ("xgboost",) if importlib.util.find_spec(n)]


def external_boosted(rows: DataFrame, numeric: list[str], label: str, rounds: int = 100, depth: int = 4, rate: float = 0.05, seed: int = 42) -> Fitted:
    """Distributed boosting by an optional library, where it is installed (ML-08); else an error that names it."""
    if "xgboost" not in boosters():
        raise ModuleNotFoundError("xgboost is not installed; use boosted()")
    from xgboost.spark import SparkXGBClassifier

    prep = Preprocessor(numeric).fit(rows)
    fit = SparkXGBClassifier(features_col="features", label_col="_y", n_estimators=rounds, max_depth=depth, learning_rate=rate, random_state=seed)
    return Fitted(prep, fit.fit(prep.transform(rows, False).withColumn("_y", F.col(label).cast("int"))), scale=False)


@dataclass
class Platt:
    """Logistic regression on the logit, with C = 1e6 (ML-09)."""

    slope: float = 1.0
    intercept: float = 0.0

    def fit(self, rows: DataFrame, p: str = "p", label: str = "y") -> Platt:
        ready = VectorAssembler(inputCols=["_z"], outputCol="_v").transform(rows.select(logit(F.col(p)).alias("_z"), F.col(label).cast("double").alias("_y")))
        model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1 / (1e6 * max(1, ready.count())), standardization=False, tol=1e-10, maxIter=200).fit(ready)
        self.slope, self.intercept = float(model.coefficients[0]), float(model.intercept)
        return self

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("p", 1 / (1 + F.exp(-(self.slope * logit(F.col("p")) + self.intercept))))


@dataclass
class Isotonic:
    """Isotonic regression, clipped to its range and to [0, 1] (ML-10); applied by a search in its sorted steps, however many there are."""

    bounds: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)

    def fit(self, rows: DataFrame, p: str = "p", label: str = "y") -> Isotonic:
        model = IsotonicRegression(featuresCol="_p", labelCol="_y").fit(rows.select(F.col(p).cast("double").alias("_p"), F.col(label).cast("double").alias("_y")))
        self.bounds, self.values = list(map(float, model.boundaries)), list(map(float, model.predictions))
        return self

    def apply(self, rows: DataFrame) -> DataFrame:
        bounds, values = self.bounds, self.values

        def lookup(p: pd.Series) -> pd.Series:
            return pd.Series(np.clip(np.interp(p.to_numpy(float), bounds, values), 0.0, 1.0), index=p.index).where(p.notna())

        return rows.withColumn("p", F.pandas_udf(lookup, "double")("p"))


def permutation_importance(fitted: Fitted, rows: DataFrame, label: str, features: list[str], seed: int = 42) -> list[dict]:
    """Rise in log loss when a column's values change places (ML-15), for all features in one job.

    Rows are dealt out by a hash; within each batch of so dealt rows (some thousands) every feature's values are shuffled by themselves, in a copy of the
    batch that carries the feature's name. One shuffle moves the rows once; the copies are scored where they are made.
    """
    from contestkit.operators.metrics import evaluate

    needed = list(dict.fromkeys([*fitted.prep.numeric, *([fitted.prep.categorical] if fitted.prep.categorical else []), *features]))
    plain = rows.select(*needed, F.col(label).cast("int").alias("y"))
    dealt = plain.withColumn("_deal", F.xxhash64(*plain.columns, F.lit(seed))).repartition("_deal").sortWithinPartitions("_deal")
    names = ["", *features]

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rng = np.random.default_rng([seed, batch.column("_deal")[0].as_py() & (1 << 63) - 1])
            for name in names:
                own = batch
                if name:
                    at = batch.schema.get_field_index(name)
                    own = batch.set_column(at, batch.schema.field(at), batch.column(at).take(pa.array(rng.permutation(batch.num_rows))))
                yield own.append_column("_feature", pa.array([name] * own.num_rows))

    schema = StructType([*dealt.schema.fields, StructField("_feature", StringType())])
    scored = evaluate(fitted.predict(dealt.mapInArrow(copies, schema)), ("_feature",))
    losses = {r["_feature"]: r["log_loss"] for r in scored.collect()}  # a row a feature
    return [{"feature": c, "importance": losses[c] - losses[""]} for c in features]
