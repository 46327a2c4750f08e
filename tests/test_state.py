import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from contestkit.operators import history, ledger
from contestkit.streaming import resolution, state

STATS = ("minutes", "kd", "sl", "sa", "tdl", "tda", "sub", "ctrl")
LONG = "fight_id long, date date, side string, entity long, opponent long, won int, has_stats boolean, opp_has_stats boolean, " + ", ".join(f"{p}{c} double" for p in ("", "opp_") for c in STATS)
OUT = (*history.RECORD, *history.FORM, "days_since_last_fight", *history.LAYOFF, *history.ROLLING, *history.AGAINST, "no_prior_stats")


def bouts(n, seed=1, begin=date(2020, 1, 1)):
    r = random.Random(seed)
    rows, day = [], begin
    for k in range(n):
        day += timedelta(days=r.choice([0, 0, 1, 40]))
        a, b = r.sample(range(8), 2)
        stats = {s: [None if r.random() < 0.05 else float(r.randint(0, 20)) for _ in STATS] for s in "ab"}
        has = {s: r.random() < 0.8 for s in "ab"}
        won = r.randint(0, 1)
        for s, o, e, f, w in (("a", "b", a, b, won), ("b", "a", b, a, 1 - won)):
            rows.append((k, day, s, e, f, w, has[s], has[o], *stats[s], *stats[o]))
    return rows


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def batches_of(rows, n):
    """Cuts rows into batches between days, so that no competitor's day is split."""
    days = sorted({r[1] for r in rows})
    parts = [set(days[k * len(days) // n : (k + 1) * len(days) // n]) for k in range(n)]
    return [[r for r in rows if r[1] in p] for p in parts]


def run(stream, out, base):
    q = stream.writeStream.format("parquet").option("path", f"{base}/{out}").option("checkpointLocation", f"{base}/cp-{out}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def expected(spark, rows):
    long = spark.createDataFrame(rows, LONG)
    return history.rates(history.layoff(history.activity(history.form(history.record(long))))).select("fight_id", "side", *OUT)


def test_stream_equals_batch_after_restarts(rocks, tmp_path):
    spark, rows = rocks, bouts(120)
    for k, part in enumerate(batches_of(rows, 3)):
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, LONG).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        run(state.running_features(spark.readStream.schema(LONG).parquet(f"{tmp_path}/in")), "out", tmp_path)  # a new query each time
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.filter("late").count() == 0
    assert rounded(got.select("fight_id", "side", *OUT).collect()) == rounded(expected(spark, rows).collect())


def test_state_begins_with_a_batch_table(rocks, tmp_path):
    spark, rows = rocks, bouts(120, seed=2)
    first, second = batches_of(rows, 2)
    spark.createDataFrame(second, LONG).write.parquet(f"{tmp_path}/in")
    begun = state.start_state(spark.createDataFrame(first, LONG))
    run(state.running_features(spark.readStream.schema(LONG).parquet(f"{tmp_path}/in"), begun), "out", tmp_path)
    days = {r[1] for r in second}
    want = [r for r in rounded(expected(spark, rows).withColumn("n", F.col("fight_id")).drop("n").collect()) if r[0] in {x[0] for x in second}]
    assert days and rounded(spark.read.parquet(f"{tmp_path}/out").select("fight_id", "side", *OUT).collect()) == want


def test_state_is_one_row_a_competitor(rocks, tmp_path):
    spark, rows = rocks, bouts(120, seed=3)
    first, second = batches_of(rows, 2)
    first, second = [r for r in first if r[3] != 7], [r for r in second if r[3] != 6]  # 7 is new, 6 stays away
    spark.createDataFrame(second, LONG).write.parquet(f"{tmp_path}/in")
    stream = state.running_features(spark.readStream.schema(LONG).parquet(f"{tmp_path}/in"), state.start_state(spark.createDataFrame(first, LONG)))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    kept = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]
    # 7 competitors at first, 7 in the stream, 8 in all: one write each
    assert [(s["numRowsTotal"], s["numRowsUpdated"]) for s in kept] == [(8, 14)]
    new = {r[0] for r in second}
    want = [r for r in rounded(expected(spark, first + second).collect()) if r[0] in new]
    assert want and rounded(spark.read.parquet(f"{tmp_path}/out").select("fight_id", "side", *OUT).collect()) == want


def test_late_rows_change_nothing_and_old_state_goes(rocks, tmp_path):
    spark = rocks
    row = lambda k, d, e: (k, d, "a", e, 99, 1, False, False, *[None] * 16)
    days = [[row(1, date(2020, 1, 1), 1), row(2, date(2020, 1, 9), 2)], [row(3, date(2019, 6, 1), 1)], [row(4, date(2020, 1, 10), 1)], [row(5, date(2024, 1, 1), 2)], [row(6, date(2024, 1, 2), 1), row(7, date(2024, 1, 3), 2)]]
    for part in days:
        spark.createDataFrame(part, LONG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(LONG).parquet(f"{tmp_path}/in")
        run(state.running_features(stream), "kept", tmp_path)
        run(state.running_features(stream, expire_days=400, late="0 days"), "forgotten", tmp_path)
    kept = {r["fight_id"]: (r["prior_fights"], r["late"]) for r in spark.read.parquet(f"{tmp_path}/kept").collect()}
    assert kept == {1: (0, False), 2: (0, False), 3: (1, True), 4: (1, False), 5: (1, False), 6: (2, False), 7: (2, False)}
    forgotten = {r["fight_id"]: r["prior_fights"] for r in spark.read.parquet(f"{tmp_path}/forgotten").collect()}
    assert 3 not in forgotten  # behind the watermark
    # who came back in the batch that moved the watermark still met the state; who came later is new
    assert forgotten[6] == 0 and forgotten[4] == 1 and forgotten[5] == 1 and forgotten[7] == 2


PREDICTIONS = [
    ("p1", date(2024, 1, 1), "Ann", "Bob", 0.7, "pending"), ("p2", date(2024, 1, 1), "Cid", "Dan", 0.4, "pending"), ("p3", date(2024, 1, 5), "Eve", "Fay", 0.6, "pending"), ("p4", date(2024, 1, 9), "Ann", "Cid", 0.5, "error"),
    ("p5", date(2024, 1, 9), "Bob", "Dan", 0.2, "pending"), ("p6", date(2024, 1, 20), "Gus", "Hal", 0.9, "pending"), ("p7", date(2024, 1, 1), "Ann", "Bob", 0.6, "pending"),
]
RESULTS = [
    [("r5", date(2024, 1, 9), "Dan", "Bob", "Dan")],  # before its prediction's batch
    [("r1", date(2024, 1, 1), "BOB", "ann", "Ann"), ("rx", date(2024, 2, 20), "No", "Body", "No")],
    [("r2", date(2024, 1, 1), "Cid", "Dan", "Dan"), ("r3", date(2024, 1, 5), "Eve", "Fay", "Draw")],  # behind the watermark
    [("r3b", date(2024, 1, 5), "Fay", "Eve", "Eve"), ("r1", date(2024, 1, 1), "BOB", "ann", "Ann")],  # a second result, and one sent again
]


def test_resolution_as_a_stream(spark, tmp_path):
    base = f"file://{tmp_path}/r"
    sent = [PREDICTIONS[:5], PREDICTIONS[5:], [], []]
    for k, results in enumerate(RESULTS):
        spark.createDataFrame(sent[k], resolution.PREDICTION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        spark.createDataFrame(results, resolution.RESULT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
        streams = [spark.readStream.schema(kind).parquet(f"{tmp_path}/{n}") for n, kind in (("p", resolution.PREDICTION), ("s", resolution.RESULT))]
        for q in resolution.start(*streams, base):  # new queries each time
            q.awaitTermination(300)
            assert q.exception() is None
        resolution.correct(spark, base, k)
        resolution.correct(spark, base, k) if k == 1 else None  # a repeated run replaces its batch
        came = {r[0]: r for part in RESULTS[: k + 1] for r in part}
        told = spark.createDataFrame([p for part in sent[: k + 1] for p in part], resolution.PREDICTION)
        want = ledger.resolve(told, spark.createDataFrame(list(came.values()), resolution.RESULT).drop("result_id"))
        columns = ["prediction_id", "outcome", "status", "winner", "log_loss", "brier", "correct_prediction", "target_a_win"]
        assert sorted(map(tuple, resolution.resolved(spark, base).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    outcome = {r["prediction_id"]: r["outcome"] for r in resolution.resolved(spark, base).collect()}
    assert outcome == {"p1": "resolved", "p7": "resolved", "p2": "resolved", "p3": "ambiguous", "p4": "error", "p5": "resolved", "p6": "unmatched"}
    joined = spark.read.parquet(f"{base}/matches")
    assert {r["prediction_id"] for r in joined.filter("result_id is null").collect()} >= {"p2", "p3"} and joined.filter("result_id = 'r2'").count() == 0
    assert {r["result_id"] for r in spark.read.parquet(f"{base}/corrections").collect()} >= {"r2", "r3"}
