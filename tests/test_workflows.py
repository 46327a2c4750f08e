import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contestkit.operators import experiments, ledger, metrics, models, splits, studies
from contestkit.streaming import live


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    data = []
    for k in range(600):
        x = r.gauss(0, 1)
        data.append((k, date(2020, 1, 1) + timedelta(days=k // 10), x, r.gauss(0, 1) if k % 5 else None, 0.5 + 0.1 * (x > 0), int(r.random() < 1 / (1 + 2.718281828 ** (-2 * x)))))
    return splits.three_way(spark.createDataFrame(data, "fight_id long, date date, x double, z double, expected double, y int")).cache()


def test_rating_regression_and_forest_on_one_split(rows):
    got = experiments.train_and_evaluate(rows, ["x", "z"], "y", "expected", trees=10)
    assert set(got) == {"rating", "logistic", "forest"} and len({s["n"] for s in got.values()}) == 1
    assert got["logistic"]["auc"] > 0.8 and got["logistic"]["log_loss"] < got["rating"]["log_loss"] and 0.7 < got["forest"]["auc"] <= 1
    with pytest.raises(ValueError, match="leak"):
        experiments.train_and_evaluate(rows, ["winner"], "y", "expected")


def test_feature_sets_on_one_split(rows):
    got = experiments.compare_feature_sets(rows, {"noise": ["z"], "both": ["x", "z"]}, "y")
    assert got["both"]["log_loss"] < got["noise"]["log_loss"] and got["both"]["n"] == got["noise"]["n"]


def test_forest_respects_its_leaves(rows):
    one = models.forest(experiments.part(rows, "train"), ["x"], "y", trees=3, least_leaf=100)
    assert one.model.getNumTrees == 3 and all(t.numNodes < 9 for t in one.model.trees)


def test_sanity_audit_of_a_search(rows, monkeypatch):
    monkeypatch.setattr(studies, "around", lambda best: [best | {"leaves": 2}])
    pretest, test = rows.filter("split <> 'test'"), experiments.part(rows, "test")
    coarse = [{"rate": 0.1, "leaves": 3, "least_leaf": 20, "l2": 0.0}]
    out = studies.sanity_audit(pretest, test, ["x"], "y", {"linear": 9.0}, coarse, 1.0, 0.0, rounds=1)
    assert out["reproduction"]["linear"][0] == 9.0 and not out["result_is_real"]
    assert out["parity"]["aligned"] and out["orientation"]["linear"]["ok"] and out["coarse"] == out["refined"] == 1 and out["rounds_used"] == [1] * 5


def test_audits_of_predictions(rows):
    windows = studies.Windows.of(rows.filter("split <> 'test'"))
    base = models.logistic(windows[0][0], ["x"], "y")
    found = studies.calibration_audit(base, windows[0], "y")
    assert found["auc_stable"] and set(found) == {"raw", "platt", "isotonic", "auc_stable"}
    spread = studies.distributions(base.predict(windows[0][2]))
    assert spread["low"] <= spread["deciles"][0] <= spread["deciles"][8] <= spread["high"] and len(spread["deciles"]) == 9
    heavy = metrics.nan_heavy(rows.select("z", F.lit(None).cast("double").alias("u"), F.lit(1).alias("v")), ("z", "u", "v")).first()["nan_heavy"]
    assert heavy == 120


def test_results_that_nobody_predicted(spark):
    known = spark.createDataFrame([(date(2024, 1, 1), "Ann", "Bob")], "event_date date, fighter_a string, fighter_b string")
    results = spark.createDataFrame([(date(2024, 1, 1), "bob", "ANN"), (date(2024, 1, 2), "Ann", "Bob")], "event_date date, fighter_a string, fighter_b string")
    assert [r["event_date"] for r in ledger.unmatched_results(known, results).collect()] == [date(2024, 1, 2)]


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    kind = "ts timestamp, user_id long, event_type string, value double"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    spark.createDataFrame([(at(1), 1, "view", 1.0), (at(4), 1, "view", 2.0), (at(7), 2, "buy", 4.0), (at(30), 1, "view", 8.0)], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(at(600), 9, "end", 0.0)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    events = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    per = {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in run(live.tumbling(events(), "ts", "5 minutes"), "tumbling").collect()}
    assert per == {(at(0), "view"): (2, 3.0), (at(5), "buy"): (1, 4.0), (at(30), "view"): (1, 8.0)}
    spells = sorted((r["user_id"], r["start"], r["n"]) for r in run(live.sessions(events(), "ts", "10 minutes"), "sessions").collect())
    assert spells == [(1, at(1), 2), (1, at(30), 1), (2, at(7), 1)]
