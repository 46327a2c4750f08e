import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from contestkit.operators import experiments, history, ledger, models, quotes, splits
from contestkit.streaming import rolling, state

LEDGER = "event_date date, event_name string, seq long, status string, target_a_win int, predicted_probability_a double, model_version string"


def made(n, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        day = date(2024, 1, 1) + timedelta(days=7 * (k // 6))
        rows.append((day, f"E{k // 6}", k, "pending" if k % 11 == 10 else "error" if k % 37 == 36 else "resolved", r.randint(0, 1), r.choice([0.0, r.random()]), "v1"))
    return rows


@pytest.mark.parametrize("n", [0, 10, 40, 80, 160])
def test_live_report(spark, n):
    rows = made(n)
    report = ledger.live_report(spark.createDataFrame(rows, LEDGER).repartition(3))
    done = [r for r in rows if r[3] == "resolved"]
    assert (report["total"], report["resolved"], report["pending"]) == (n, len(done), sum(r[3] == "pending" for r in rows))
    assert report["level"] == ("too_noisy" if len(done) < 50 else "preliminary" if len(done) < 100 else "usable")
    if not done:
        assert report["overall"] is None
        return
    assert (report["overall"]["auc"] is None) == (len(done) < 20) and report["overall"]["n"] == len(done)
    assert (report["by_month"] == "insufficient_sample") == (len(done) < 30) == (report["by_year"] == "insufficient_sample")
    assert report["by_event"].count() == report["resolved_events"]
    assert (report["rolling"] == "insufficient_sample") == (len(done) < 50)
    if len(done) >= 50:
        got = {r["seq"]: r for r in report["rolling"].collect()}
        for at, r in enumerate(done):
            for size in (50, 100):
                own = done[at + 1 - size : at + 1] if at + 1 >= size else None
                want = own and sum((x[5] >= 0.5) == x[4] for x in own) / size
                assert got[r[2]][f"accuracy_{size}"] == (want if want is None else pytest.approx(want))


def test_rolling_stream_equals_trailing(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    r = random.Random(9)
    rows = [(f"m{k % 2}", date(2024, 1, 1) + timedelta(days=k // 9), k, r.random(), r.randint(0, 1)) for k in range(290)]
    kind = "model string, day date, number long, p double, y int"
    measures = {"loss": (F.col("p") - F.col("y")) ** 2, "mean_p": F.col("p")}
    try:
        for part in (rows[:90], rows[90:198], rows[198:]):  # between days
            random.Random(1).shuffle(part)
            spark.createDataFrame(part, kind).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
            stream = rolling.rolling(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), measures)
            q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = spark.createDataFrame(rows, kind)
    for size in rolling.SIZES:
        want = history.trailing(want, measures, size, ("day", "number"), "model")
    names = ["model", "number", *[f"{n}_{s}" for s in rolling.SIZES for n in (*measures, "status")]]
    rounded = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()], key=str)
    assert rounded(spark.read.parquet(f"{tmp_path}/out")) == rounded(want)


def test_positions_of_a_hot_day(spark):
    r = random.Random(2)
    rows = [("m", date(2024, 1, 1), k * k) for k in range(300)] + [("m", date(2024, 1, 2), k) for k in range(5)] + [("n", date(2024, 1, 1), k) for k in range(7)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "model string, date date, fight_id long").repartition(4)
    got = sorted(tuple(x) for x in history.positions(df, ("date", "fight_id"), "model", width=20).select("model", "date", "fight_id", "_at").collect())
    want, last = [], {}
    for m, d, k in sorted(rows):
        last[m] = last.get(m, -1) + 1
        want.append((m, d, k, last[m]))
    assert got == want


def test_replay_equals_a_fit_a_day(spark, monkeypatch):
    monkeypatch.setattr(experiments, "TOGETHER", 4)
    r = random.Random(5)
    data = []
    for k in range(400):
        x = r.gauss(0, 1)
        data.append((k, date(2021, 1, 1) + timedelta(days=k // 10), None if k % 19 == 0 else x, int(r.random() < 1 / (1 + 2.718281828 ** (-2 * x)))))
    rows = spark.createDataFrame(data, "fight_id long, date date, x double, y int").repartition(3).cache()
    days = [date(2021, 1, 1) + timedelta(days=k) for k in (2, 15, 20, 21, 22, 30, 31, 39, 50)]
    got = {q["fight_id"]: (q["y"], q["p"]) for q in experiments.replay(rows, ["x"], "y", days, 100, 40).collect()}
    assert len(got) == 70
    for day in days[1:8:3]:
        past = rows.filter(F.col("date") < day)
        cut = splits.nth_cut(past, past.count() - 40).after()
        base = models.logistic(past.filter(~cut), ["x"], "y", tol=1e-14, max_iter=2000)
        base.calibrator = models.Platt().fit(base.predict(past.filter(cut)).withColumn("y", F.col("y")))
        for q in base.predict(rows.filter(F.col("date") == day)).select("fight_id", "y", "p").collect():
            assert got[q["fight_id"]] == (q["y"], pytest.approx(q["p"], abs=1e-6))


def test_sample_validation_watches_protected_state(spark, tmp_path):
    (tmp_path / "ledger.csv").write_text("a,b\n")
    outcome = "array<struct<name:string,price:double>>"
    rows = [("normalized", "matched", "2024-01-01 00:00:00", "2024-01-03 00:00:00", "h2h", [("A", 1.5), ("B", 2.5)], "mma", "fanduel", "Prelims", "cancelled")]
    kind = f"status string, match_status string, observed string, starts string, market_type string, outcomes {outcome}, sport_key string, book string, card_section string, event_status string"
    frame = spark.createDataFrame(rows, kind).withColumns({c: F.col(c).cast("timestamp") for c in ("observed", "starts")})
    protected = {"ledger": f"file://{tmp_path}/ledger.csv", "database": f"file://{tmp_path}/none"}
    good = quotes.validate_sample(spark, lambda: frame, "mma", protected, retention=True)
    assert good["accepted"] and good["protected_unchanged"] and good["digests"]["database"] is None and not good["failed"]
    assert quotes.validate_sample(spark, lambda: frame, "mma", protected)["failed"] == ["raw_retention_permitted_confirmed"]

    def meddling():
        (tmp_path / "ledger.csv").write_text("a,c\n")
        return frame

    bad = quotes.validate_sample(spark, meddling, "mma", protected, retention=True)
    assert not bad["accepted"] and bad["changed"] == ["ledger"]
    begun = quotes.validate_sample(spark, lambda: (tmp_path / "none").write_text("x") and frame, "mma", protected, retention=True)
    assert not begun["accepted"] and begun["changed"] == ["database"]
