"""Many penalised logistic regressions in one pass over the rows (EXP-05, EXP-07, EXP-08).

All candidates, that is window x features x penalty, are solved side by side by Newton steps: one aggregation carries the losses, gradients and Hessians
of all of them, and the driver takes each candidate's step (with a soft threshold for L1). So the number of Spark jobs is that of the slowest candidate's
steps, ten or so, not the number of candidates. The driver holds (features + 1)**2 numbers a candidate.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestkit.operators import quantiles
from contestkit.session import cut

STEPS = 100
TOLERANCE = 1e-9
CLIP = 1e-6


@dataclass
class Linear:
    """A logistic model of given coefficients, in the place of a fitted one of MLlib's."""

    coefficients: list[float]
    intercept: float

    def transform(self, rows: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        total = sum((F.get(F.col("_x"), k) * w for k, w in enumerate(self.coefficients) if w), F.lit(self.intercept))
        p = 1 / (1 + F.exp(-total))
        return rows.withColumn("_x", x).withColumn("_p1", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1")))).drop("_x", "_p1")

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(json.dumps([self.coefficients, self.intercept]),)], "value string").coalesce(1).write.mode("errorifexists").text(path)

    @classmethod
    def load(cls, path: str) -> Linear:
        return cls(*json.loads(SparkSession.active().read.text(path).first()["value"]))


@dataclass
class Problem:
    """One candidate: sum of log losses over its rows + (l1_ratio |w| + (1 - l1_ratio) / 2 w**2) / c, the last weight (the intercept) left free."""

    c: float
    l1_ratio: float
    w: np.ndarray
    step: np.ndarray | None = None
    value: float = math.inf
    shrink: float = 1.0
    done: bool = False

    def objective(self, loss: float) -> float:
        w = self.w[:-1]
        return loss + (self.l1_ratio * np.abs(w).sum() + (1 - self.l1_ratio) / 2 * (w**2).sum()) / self.c

    def advance(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """The next weights, given the figures at the present ones; half the last step if that did not help."""
        value = self.objective(loss)
        if self.step is not None and value > self.value + 1e-12 * abs(self.value) and self.shrink > 1e-6:
            self.shrink /= 2
            self.w = self.w - self.step * self.shrink
            return
        self.value, self.shrink = value, 1.0
        new = newton(self.w, gradient, hessian, self.l1_ratio / self.c, (1 - self.l1_ratio) / self.c)
        self.step = new - self.w
        self.w = new
        self.done = bool(np.abs(self.step).max() <= TOLERANCE)


def newton(w: np.ndarray, g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The least of the local parabola with penalties on all weights but the last: a solution of linear equations, or descent by coordinates with a soft threshold."""
    h = h + np.eye(len(w)) * 1e-12 * max(1.0, float(np.trace(h)))
    ridge = np.append(np.full(len(w) - 1, l2), 0.0)
    if not l1:
        return w - np.linalg.solve(h + np.diag(ridge), g + ridge * w)
    new, slope = w.copy(), g.copy()  # slope: gradient of the smooth part's parabola at new
    for _ in range(10_000):
        most = 0.0
        for k in range(len(w)):
            a = h[k, k] + ridge[k]
            target = h[k, k] * new[k] - slope[k]
            least = l1 if k < len(w) - 1 else 0.0
            moved = math.copysign(max(abs(target) - least, 0.0), target) / a - new[k]
            if moved:
                slope += h[:, k] * moved
                new[k] += moved
                most = max(most, abs(moved))
        if most < 1e-13:
            break
    return new


Design = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def solve(table: DataFrame, problems: list[Problem], design: Design) -> None:
    """Solves all problems; ``design`` yields (number of the problem, its rows' features, their labels) of a batch. One aggregation a step."""
    for _ in range(STEPS):
        todo = {k: p.w for k, p in enumerate(problems) if not p.done}
        if not todo:
            return

        def sums(batches: Iterator[pa.RecordBatch], todo: dict[int, np.ndarray] = todo) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(1 + len(w) + len(w) ** 2) for k, w in todo.items()}
            for batch in batches:
                for k, x, y in design(batch):
                    if k not in todo or not len(y):
                        continue
                    full = np.hstack([x, np.ones((len(x), 1))])
                    score = full @ todo[k]
                    p = 1 / (1 + np.exp(-score))
                    # log(1 + exp(s)) - y s without overflow
                    loss = (np.maximum(score, 0) + np.log1p(np.exp(-np.abs(score))) - y * score).sum()
                    total[k] += np.concatenate([[loss], full.T @ (p - y), (full.T @ (full * (p * (1 - p))[:, None])).ravel()])
            for k, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), k), pa.int32()), pa.array(np.arange(len(t)), pa.int32()), pa.array(t)], names=["problem", "cell", "v"])

        found = table.mapInArrow(sums, "problem int, cell int, v double").groupBy("problem", "cell").agg(F.sum("v").alias("v")).toArrow()  # bounded by the candidates
        figures = {k: np.zeros(1 + len(w) + len(w) ** 2) for k, w in todo.items()}
        number, cell, v = (found.column(c).to_numpy() for c in ("problem", "cell", "v"))
        for k, own in figures.items():
            mine = number == k
            own[cell[mine]] = v[mine]
            d = len(todo[k])
            problems[k].advance(own[0], own[1 : 1 + d], own[1 + d :].reshape(d, d))


@dataclass
class Candidate:
    name: str
    features: list[str]
    c: float = 1.0
    l1_ratio: float = 0.0


@dataclass
class Batch:
    """Fits of candidates x windows: ``weights[candidate][window]`` on standardised features, the last one the intercept; ``platt`` alike (slope, intercept)."""

    candidates: list[Candidate]
    features: list[str]
    table: DataFrame
    medians: list[dict[str, float]]
    means: list[dict[str, float]]
    deviations: list[dict[str, float]]
    carried: tuple[str, ...] = ()
    weights: list[list[np.ndarray]] = field(default_factory=list)
    platt: list[list[np.ndarray]] = field(default_factory=list)

    @property
    def n_windows(self) -> int:
        return len(self.medians)

    def design(self, part: str) -> Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Yields (candidate, window, standardised features, labels) of the rows in that part of the window."""
        d, n = len(self.features), self.n_windows
        at = {c: k for k, c in enumerate(self.features)}
        own = [[at[c] for c in cand.features] for cand in self.candidates]
        filled, centre, scale = (np.array([[w[c] for c in self.features] for w in x]) for x in (self.medians, self.means, self.deviations))

        def of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            inside = batch.column(part).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, n)
            for w in range(n):
                mine = inside[:, w]
                z = (np.where(np.isnan(x[mine]), filled[w], x[mine]) - centre[w]) / scale[w]
                for k, columns in enumerate(own):
                    yield k, w, z[:, columns], y[mine]

        return of

    def fitted_parts(self, k: int, w: int) -> tuple[dict[str, dict[str, float]], Linear]:
        """(preprocessing figures, model) of a candidate in a window."""
        names = self.candidates[k].features
        prep = {"medians": self.medians[w], "means": self.means[w], "deviations": self.deviations[w]}
        return {n: {c: v[c] for c in names} for n, v in prep.items()}, Linear([float(x) for x in self.weights[k][w][:-1]], float(self.weights[k][w][-1]))

    def calibrate(self) -> None:
        """Platt's slope and intercept (C = 1e6) of every candidate and window, from the window's second part; all together."""
        design, n, weights = self.design("second"), self.n_windows, self.weights
        problems = [Problem(1e6, 0.0, np.array([1.0, 0.0])) for _ in range(len(self.candidates) * n)]

        def logits(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for k, w, x, y in design(batch):
                yield k * n + w, _logit(x, weights[k][w])[:, None], y

        solve(self.table, problems, logits)
        self.platt = [[problems[k * n + w].w for w in range(n)] for k in range(len(self.candidates))]

    def predictions(self) -> DataFrame:
        """(candidate, window, p, y and the carried columns) of the rows of each window's third part, by the calibrated models if there are any."""
        design, weights, platt, carried, n = self.design("third"), self.weights, self.platt, self.carried, self.n_windows

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inside = batch.column("third").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, n)
                for k, w, x, y in design(batch):
                    if not len(y):
                        continue
                    z = _logit(x, weights[k][w])
                    if platt:
                        z = platt[k][w][0] * z + platt[k][w][1]
                    own = batch.filter(pa.array(inside[:, w]))
                    columns = [pa.array(np.full(len(y), k), pa.int32()), pa.array(np.full(len(y), w), pa.int32()), pa.array(1 / (1 + np.exp(-z))), pa.array(y.astype(np.int64)), *(own.column(c) for c in carried)]
                    yield pa.RecordBatch.from_arrays(columns, names=["candidate", "window", "p", "y", *carried])

        kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in self.table.schema if f.name in carried)
        return self.table.mapInArrow(predict, "candidate int, window int, p double, y long" + kept)

    def scores(self) -> list[list[dict]]:
        """For each candidate and window: n, log_loss, brier, accuracy and auc on the third part; all together."""
        from contestkit.operators.metrics import bundle

        found = {(r["candidate"], r["window"]): r.asDict() for r in bundle(self.predictions(), ("candidate", "window")).collect()}  # a row a candidate and window
        return [[found.get((k, w), {"n": 0, "log_loss": None, "brier": None, "accuracy": None, "auc": None}) for w in range(self.n_windows)] for k in range(len(self.candidates))]


def _logit(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of probabilities clipped to [CLIP, 1 - CLIP]."""
    bound = math.log((1 - CLIP) / CLIP)
    return np.clip(x @ weights[:-1] + weights[-1], -bound, bound)


def fit(rows: DataFrame, label: str, windows: list[tuple[Column, Column, Column]], candidates: list[Candidate], carried: tuple[str, ...] = (), start: list[np.ndarray] | None = None) -> Batch:
    """All candidates on the first part of each window (fit, calibration, validation).

    ``carried`` columns come with the predictions; ``start`` are weights of the candidates to begin with, such as those of an earlier window. Medians (exact), means and population deviations are those of each window's fitting rows. Rows without a label are left out.
    """
    features = sorted({c for cand in candidates for c in cand.features})
    parts = {n: F.array(*[F.coalesce(w[k], F.lit(False)) for w in windows]) for k, n in enumerate(("first", "second", "third"))}
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in features]
    table = cut(rows.filter(F.col(label).isNotNull()).select(*values, F.col(label).cast("double").alias("_y"), *[F.col(c).alias(f"_kept_{c}") for c in carried], *[c.alias(n) for n, c in parts.items()]))
    inside = [F.get("first", w) for w in range(len(windows))]
    medians = [{c: (v[0] if v[0] is not None else 0.0) for c, v in own.items()} for own in quantiles.exact(table, features, groups=inside)]
    stats = []
    for k, c in enumerate(features):
        for w, mark in enumerate(inside):
            x = F.when(mark, F.coalesce(F.col(c), F.lit(medians[w][c])))
            stats += [F.avg(x).alias(f"m{k}_{w}"), F.stddev_pop(x).alias(f"s{k}_{w}")]
    found = table.agg(*stats).first()
    means, deviations = ([{c: found[f"{kind}{k}_{w}"] or other for k, c in enumerate(features)} for w in range(len(windows))] for kind, other in (("m", 0.0), ("s", 1.0)))
    ready = table.select(F.array(*features).alias("x"), F.col("_y").alias("y"), "first", "second", "third", *[F.col(f"_kept_{c}").alias(c) for c in carried])
    out = Batch(candidates, features, ready, medians, means, deviations, carried)
    design, n = out.design("first"), len(windows)
    begin = start or [np.zeros(len(cand.features) + 1) for cand in candidates]
    problems = [Problem(cand.c, cand.l1_ratio, w.copy()) for cand, w in zip(candidates, begin, strict=True) for _ in windows]
    solve(ready, problems, lambda batch: ((k * n + w, x, y) for k, w, x, y in design(batch)))
    out.weights = [[problems[k * n + w].w for w in range(n)] for k in range(len(candidates))]
    return out
