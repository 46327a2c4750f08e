import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestkit.operators import batch, experiments, metrics, models, quantiles, splits


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for k in range(900):
        x, z = rng.gauss(3, 2), rng.gauss(0, 1)
        data.append((k, date(2019, 1, 1) + timedelta(days=k // 3), None if k % 13 == 0 else x, z, x + 0.1 * rng.gauss(0, 1), int(rng.random() < 1 / (1 + np.exp(-(x - 3) - 0.3 * z)))))
    return spark.createDataFrame(data, "fight_id long, date date, x double, z double, near double, y int").repartition(5).cache()


def test_coefficients_equal_single_fits(rows):
    marks = splits.fold_marks(rows)
    listed = [batch.Candidate(f"{c}_{l1}", cols, c, l1) for c in (0.003, 0.1, 3.0) for l1 in (0.0, 0.3, 1.0) for cols in (["x", "z", "near"], ["z"])]
    found = batch.fit(rows, "y", marks, listed)
    for k, cand in enumerate(listed):
        for w, (fit, *_) in enumerate(marks):
            one = models.logistic(rows.filter(fit), cand.features, "y", cand.c, cand.l1_ratio, tol=1e-14, max_iter=3000)
            got = models.fitted(found, k, w)
            assert list(one.model.coefficients) == pytest.approx(got.model.coefficients, abs=2e-6) and one.model.intercept == pytest.approx(got.model.intercept, abs=2e-6), cand
            assert got.prep.medians == one.prep.medians
        if k > 6:
            break


def test_jobs_do_not_grow_with_candidates(rows, spark):
    def jobs(cs):
        spark.sparkContext.setJobGroup(f"n{len(cs)}", "")
        marks = splits.fold_marks(rows)
        spark.sparkContext.setJobGroup(f"fit{len(cs)}", "")
        batch.fit(rows, "y", marks, [batch.Candidate(str(c), ["x", "z"], c, 0.5) for c in cs])
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit{len(cs)}"))

    few, many = jobs([0.05]), jobs([0.05] * 30)
    spark.sparkContext.setJobGroup("", "")
    assert 0 < many <= few + 2


def test_calibrated_scores_equal_those_of_single_models(rows):
    marks = splits.fold_marks(rows)
    found = batch.fit(rows, "y", marks, [batch.Candidate("a", ["x", "z"], 0.1, 0.3), batch.Candidate("b", ["z"], 1.0, 0.0)])
    found.calibrate()
    table = found.scores()
    for k in range(2):
        for w, (_, second, third) in enumerate(marks):
            base = models.fitted(found, k, w)
            platt = models.Platt().fit(base.predict(rows.filter(second), calibrated=False).withColumn("y", F.col("y")))
            assert [platt.slope, platt.intercept] == pytest.approx([base.calibrator.slope, base.calibrator.intercept], abs=1e-4)
            want = experiments.scores(base.predict(rows.filter(third)), "y")
            assert {k2: table[k][w][k2] for k2 in ("n", "log_loss", "brier", "accuracy", "auc")} == pytest.approx({k2: want[k2] for k2 in ("n", "log_loss", "brier", "accuracy", "auc")}, abs=1e-9)


def test_artifact_of_a_batch(rows, tmp_path):
    found = batch.fit(rows, "y", splits.fold_marks(rows), [batch.Candidate("a", ["x", "z"], 0.1, 0.3)])
    found.calibrate()
    own = models.fitted(found, 0, 0)
    models.save(own, f"file://{tmp_path}/l", "v1")
    again, _ = models.load(f"file://{tmp_path}/l", ["x", "z"])
    ps = [sorted(r["p"] for r in m.predict(rows).select("p").collect()) for m in (own, again)]
    assert ps[0] == pytest.approx(ps[1])


def test_quantiles_equal_medians(spark, monkeypatch):
    rng = random.Random(4)
    pool = [0.0, -0.0, 1e-300, -1e300, 2.5, 2.5, -7.25, float("nan"), None, 3.0, 1e-5]
    data = [(rng.choice(pool), rng.gauss(0, 1) if rng.random() < 0.9 else None, float(rng.randrange(5)), None, rng.random() < 0.4) for _ in range(2001)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, m boolean").repartition(6)
    clean = df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "abcd"], "m").cache()
    shares = (0.5, 0.0, 0.1, 0.25, 0.999, 1.0)
    for fetched in (quantiles.FETCHED, 0):  # with and without fetching what is left
        monkeypatch.setattr(quantiles, "FETCHED", fetched)
        for group, rows in ((None, clean), (F.col("m"), clean.filter("m"))):
            got = quantiles.exact(df, list("abcd"), shares, [group] if group is not None else None)[0]
            want = rows.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in "abcd"]).first()
            assert got == {c: (list(want[c]) if want[c] is not None else [None] * len(shares)) for c in "abcd"}
    assert quantiles.exact(df.limit(0), ["a"]) == [{"a": [None]}]


def test_auc_by_group(spark):
    rng = random.Random(6)
    data = [(rng.randrange(3), round(rng.random(), rng.choice([1, 6])), rng.randrange(2)) for _ in range(3000)] + [(7, 0.5, 1)]
    df = spark.createDataFrame(data, "g int, p double, y int")
    got = {r["g"]: r["auc"] for r in metrics.auc(df, ("g",)).collect()}
    for g in (0, 1, 2):
        pos, neg = ([p for h, p, y in data if h == g and y == v] for v in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
        assert metrics.auc(df.filter(F.col("g") == g)).first()["auc"] == pytest.approx(got[g])
    assert got[7] is None
