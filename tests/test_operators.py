import random
import shutil
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from contestkit.functions import numeric as N
from contestkit.functions import parse as P
from contestkit.functions import text as T
from contestkit.operators import experiments, filters, identity, ledger, matchup, metrics, models, quotes, splits
from contestkit.sources import pages, tables
from contestkit.streaming import live


def values(spark, column, *inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k long, x {kind}").orderBy("k").select(column(F.col("x"))).collect()]


def test_text(spark):
    assert values(spark, T.name_key, "  José  ALDO ", None) == ["josé aldo", ""]
    assert values(spark, T.folded_name, "José  O'Neil-St. Pre", None, "A&B") == ["jose oneil st pre", "", "ab"]
    assert values(spark, T.folded_card_name, "A&B") == ["a b"]
    assert values(spark, T.weight_class, "League Women's Flyweight Title Bout", "Light Heavyweight", "Catchweight", "Superfight") == ["Women's Flyweight", "Light Heavyweight", "Catch Weight", None]
    assert values(spark, T.division_limit, "Women's Flyweight", "Light Heavyweight", "Catch Weight") == [125.0, 205.0, None]
    assert values(spark, T.url_slug, "http://a/b/c1", "http://a/b/c2/", "") == ["c1", "c2", None]
    assert values(spark, T.bout_sides, "A One vs. B Two", "A VS B", "alone") == [["A One", "B Two"], ["A", "B"], None]
    assert values(spark, T.resolve_alias, "bobby green", "x") == ["king green", "x"]
    assert values(spark, T.method_name, "U-DEC", "KO/TKO") == ["Decision - Unanimous", "KO/TKO"]
    assert values(spark, T.cells, "a | |b") == [["a", "b"]]
    assert values(spark, lambda c: T.event_slug(c, F.lit("2026-01-02")), "Night 300: A")[0].startswith("night-300-a-2026-01-02-")
    assert T.canonical_json({"b": 1, "a": [1.5]}) == '{"a":[1.5],"b":1}'
    with pytest.raises(ValueError):
        T.canonical_json({"a": float("nan")})


def test_parse(spark):
    assert [tuple(x) for x in values(spark, P.landed_of_attempted, "37 of 102", "junk", None)] == [(37, 102), (0, 0), (0, 0)]
    assert values(spark, P.clock_seconds, "1:30", "x") == [90, 0]
    assert values(spark, P.round_lengths, "3 Rnd (5-5-5)", "No limit") == [[5, 5, 5], [5] * 5]
    assert values(spark, P.height_cm, "5' 11\"", "--") == [180.3, None]
    assert values(spark, P.reach_cm, '72"', "--") == [182.9, None]
    assert values(spark, P.weight_lbs, "155 lbs.", "--") == [155.0, None]
    assert values(spark, P.any_date, "Jan 01, 1990", "January 5, 2020", "2020-01-05", "2020-01-05T10:00:00Z", "nope") == [date(1990, 1, 1), date(2020, 1, 5), date(2020, 1, 5), date(2020, 1, 5), None]
    assert values(spark, P.utc_timestamp, "2020-01-01T00:00:00")[0] is None and values(spark, P.utc_timestamp, "2020-01-01T00:00:00Z")[0] is not None
    assert values(spark, lambda c: P.age_at(c, F.to_date(F.lit("2020-01-01"))), date(1990, 1, 1), date(2021, 1, 1), kind="date") == [30.0, None]
    assert values(spark, lambda c: P.fight_minutes(P.round_lengths(F.lit("(5-5-5)")), F.lit(3), c), "2:30") == [12.5]


def test_numbers(spark):
    assert values(spark, N.american_to_decimal, 150.0, -200.0, 0.0, kind="double") == [2.5, 1.5, None]
    assert values(spark, N.price_error, 2.0, 1.0, float("nan"), float("inf"), None, kind="double") == [None, "not_over_one", "not_finite", "not_finite", "missing"]
    assert values(spark, lambda c: N.ratio(F.lit(1.0), c), 0.0, 2.0, kind="double") == [None, 0.5]


def test_guards(spark):
    assert filters.leaking(["elo_diff", "sig_str_landed"]) == ["sig_str_landed"]
    assert filters.leaking(["winner", "closing_odds"], filters.EXPORT_PATTERNS, filters.EXPORT_ALLOWED) == ["closing_odds"]
    with pytest.raises(ValueError, match="leak"):
        filters.guard(["winner_name"])
    rows = spark.createDataFrame([("1.5", None), ("x", None)], "a string, b string")
    assert filters.available(rows, ["a", "b", "c"]) == (["a"], ["b", "c"])
    with pytest.raises(ValueError, match="'x'"):
        filters.numeric_or_fail(rows, ["a"])
    card = spark.createDataFrame([("2026-01-01", "A", "a"), ("bad", "", "B")], "event_date string, fighter_a string, fighter_b string")
    assert [r["reasons"] for r in filters.row_reasons(card, filters.bout_checks()).collect()] == [["same_name"], ["bad_date", "empty_a"]]
    assert filters.schema_parity(rows, rows.select("b", "a"), "a") == {"only_new": [], "only_old": [], "same_order": False, "keys_only_new": 0, "keys_only_old": 0}


def test_sources(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("Date,Red_Fighter,Blue Fighter,Winner,RedAge,Odds\n2020-01-01,A  One,B Two,Red,30,1.5\n2020-01-02,C,D,D,x,2\n")
    raw = tables.with_row_id(tables.read_csv(spark, f"file://{tmp_path}/raw.csv"))
    out = sorted(tables.adapter("corners")(raw).collect(), key=lambda r: r["source_row_id"])
    assert [(r["source_row_id"], r["fighter_a"], r["winner"], r["age_a"]) for r in out] == [(0, "A One", "A One", 30.0), (1, "C", "D", None)]
    with pytest.raises(ValueError, match="known"):
        tables.adapter("nope")
    wl = spark.createDataFrame([("2020-01-01", "W", "L", 0), ("2020-01-01", "W", "L", 1)], "date string, winner_fighter string, loser_fighter string, source_row_id long")
    assert [(r["fighter_a"], r["winner"]) for r in tables.winners(wl).orderBy("source_row_id").collect()] == [("W", "W"), ("L", "W")]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    path = f"file://{tmp_path}/t"
    assert tables.append_new(rows, path, ("k",)) == 2 and tables.append_new(rows, path, ("k",)) == 2
    with pytest.raises(ValueError):
        tables.append_new(rows, path, ("k",), "error")
    assert spark.read.parquet(tables.promote(rows, f"file://{tmp_path}/p", {"positive": F.col("k") > 0})).count() == 3
    with pytest.raises(ValueError, match="not promoted"):
        tables.promote(rows, f"file://{tmp_path}/p", {"big": F.col("k") > 1})


def test_scraped_files(spark):
    events = spark.createDataFrame([("E1 ", "January 05, 2020")], "EVENT string, DATE string")
    results = spark.createDataFrame([("E1", "A One vs. B Two", "L/W", "League Flyweight Bout", "SUB", "2", "1:30", "3 Rnd (5-5-5)"), ("E1", "C vs. D", "NC/NC", "", "", "1", "0:00", "")], ["EVENT", "BOUT", "OUTCOME", "WEIGHTCLASS", "METHOD", "ROUND", "TIME", "TIME FORMAT"])
    got = tables.convert_results(results, events).orderBy("red_fighter").collect()
    assert [(r["date"], r["winner"], r["weight_class"]) for r in got] == [(date(2020, 1, 5), "Blue", "Flyweight"), (date(2020, 1, 5), "", None)]
    line = lambda r, f, s: ("E1", "A One vs. B Two", r, f, "1", s, "1 of 2", "0", "1:00")
    stats = spark.createDataFrame([line("1", "A One", "20 of 40"), line("2", "A One", "5 of 9"), line("1", "B Two", "3 of 4")], ["EVENT", "BOUT", "ROUND", "FIGHTER", "KD", "SIG.STR.", "TD", "SUB.ATT", "CTRL"])
    wide = tables.convert_stats(stats, results, events)
    (r,) = wide.collect()
    assert (r["total_minutes"], r["red_sig_str_landed"], r["red_kd"], r["blue_sig_str_attempted"], r["red_ctrl_seconds"]) == (6.5, 25, 2, 4, 120)
    fights = spark.createDataFrame([(7, date(2020, 1, 5), 1, 2, "b two", "a one")], "fight_id long, date date, a_id long, b_id long, a_key string, b_key string")
    two = {r["entity"]: r for r in tables.match_stats(wide.withColumn("row_id", F.lit(0)), fights).collect()}
    assert two[2]["sig_str_landed"] == 25 and two[1]["sig_str_landed"] == 3


EVENT = """<h2><span class="b-content__title-highlight"> Event 1 </span></h2><li> Date: January 05, 2020 </li><li>Location: X, Y</li><table><tbody>
<tr data-link="http://x/fight-details/1"><td><i class="b-flag__text">win</i></td><td><a href="http://x/fighter-details/a">A One</a><a href="http://x/fighter-details/b">B Two</a></td><td><p>1</p><p>0</p></td>
<td><p>20</p><p>10</p></td><td><p>1</p><p>0</p></td><td><p>0</p><p>2</p></td><td><p>Flyweight</p></td><td><p>SUB</p><p>Choke</p></td><td><p>2</p></td><td><p>1:30</p></td></tr></tbody></table>"""


def test_pages(spark):
    listing = '<table class="b-statistics__table-events"><a href="http://x/event-details/1"> Event 1 </a><span class="b-statistics__date">January 05, 2020</span></table>'
    assert [pages.classify(x) for x in (None, EVENT, listing, "<p>Checking your browser</p>", "<p>x</p>")] == ["unknown", "event_detail", "completed_events", "browser_challenge", "unknown"]
    df = spark.createDataFrame([("e", EVENT), ("l", listing)], "path string, html string")
    (bout,) = df.filter("path = 'e'").select(pages.listed_bouts("html").alias("b")).first()["b"]
    assert (bout["winner"], bout["strikes"], bout["method"], bout["time"]) == ("A One", "20 | 10", "SUB | Choke", "1:30")
    assert df.filter("path = 'l'").select(pages.listed_events("html").alias("e")).first()["e"][0]["date_text"] == "January 05, 2020"
    assert pages.header(df.filter("path = 'e'")).first()["header"].asDict() == {"title": "Event 1", "date_text": "January 05, 2020", "location": "X, Y"}
    assert {r["page_type"]: r["bouts"] for r in pages.inventory(df).collect()} == {"event_detail": 1, "completed_events": 0}


def test_identity(spark):
    ids = spark.createDataFrame([("s1", "x", 125.0, date(1990, 1, 1)), ("s2", "x", 205.0, date(1960, 1, 1)), ("s3", "y", None, None)], "slug string, name_key string, weight_lbs double, dob date")
    bouts = spark.createDataFrame([(1, "x", date(2010, 1, 1), "Flyweight"), (2, "x", date(2011, 1, 1), None), (3, "x", date(2012, 1, 1), None), (4, "x", date(2000, 1, 1), None), (5, "x", date(1985, 1, 1), None), (6, "y", date(2010, 1, 1), None), (7, "z", date(2010, 1, 1), None)], "ref long, name_key string, date date, weight_class string")
    got = {r["ref"]: (r["slug"], r["rule"]) for r in identity.assign(bouts, ids).collect()}
    assert got == {1: ("s1", "division_weight"), 2: ("s1", "continuity"), 3: ("s1", "continuity"), 4: ("s2", "age"), 5: ("s2", "age"), 6: ("s3", "unique_name"), 7: (None, "unknown_name")}
    names = spark.createDataFrame([("p", "bobby green"), ("p", "john doe"), ("p", "odd"), ("p", "none")], "provider string, name string")
    ents = spark.createDataFrame([(1, "king green"), (2, "john doe jr"), (3, "other")], "entity long, name string")
    reviewed = spark.createDataFrame([("p", "odd", 3)], "provider string, name string, entity long")
    assert {r["name"]: (r["rule"], r["entity"]) for r in identity.provider_match(names, ents, reviewed).collect()} == {"bobby green": ("exact", 1), "john doe": ("suffixless", 2), "odd": ("reviewed", 3), "none": ("unmatched", None)}


def plain_chain(bouts, slugs):
    """Weight, then passes over the bouts until nothing changes: {ref: slug} of one shared name. bouts: (ref, day number, weight slug)."""
    got = {r: s for r, _, s in bouts if s}
    while True:
        before = dict(got)
        for r, day, _ in bouts:
            near = {got[o] for o, other, _ in bouts if o in got and abs(other - day) <= 540}
            if r not in got and len(near) == 1:
                got[r] = near.pop()
        if got == before:
            return got


def test_continuity_against_passes(spark):
    rng = random.Random(5)
    ids = [(f"s{n}{k}", f"n{n}", w, None) for n in range(12) for k, w in enumerate((125.0, 155.0, 205.0))]
    bouts, want = [], {}
    for n in range(12):
        own = []
        for k in range(25):
            kind = rng.choice(["Flyweight", "Lightweight", "Light Heavyweight"] + [None] * 12)
            own.append((100 * n + k, rng.randint(0, 9000), {"Flyweight": f"s{n}0", "Lightweight": f"s{n}1", "Light Heavyweight": f"s{n}2"}.get(kind)))
            bouts.append((own[-1][0], f"n{n}", date(1995, 1, 1) + timedelta(days=own[-1][1]), kind))
        want |= plain_chain(own, [i for i, key, *_ in ids if key == f"n{n}"])
    got = identity.assign(spark.createDataFrame(bouts, "ref long, name_key string, date date, weight_class string"), spark.createDataFrame(ids, "slug string, name_key string, weight_lbs double, dob date"))
    assert {r["ref"]: r["slug"] for r in got.collect() if r["slug"]} == want and len(want) > 60


def test_metrics_and_splits(spark):
    rows = spark.createDataFrame([(0.3 if k % 2 else 0.7, int(k % 3 == 0)) for k in range(30)], "p double, y int")
    pairs = [(r["p"], r["y"]) for r in rows.collect()]
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    assert metrics.auc(rows).first()["auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    assert metrics.auc(rows.filter("y = 1")).first()["auc"] is None
    table = metrics.calibration_table(rows).orderBy("bucket_no").collect()
    assert [r["n"] for r in table] == [0, 0, 15, 0, 0, 0, 15, 0, 0, 0]  # 0.3 lies under the third edge, as 0.1 * 3 does
    assert metrics.best_method({"log_loss": 0.7, "brier": 0.2}, {"log_loss": 0.6, "brier": 0.2}, 299) == "platt"
    assert metrics.best_method({"log_loss": 0.7, "brier": 0.2}, {"log_loss": 0.6, "brier": 0.2}, 300) == "isotonic"
    ranked = splits.noise_band_rank([{"log_loss": 0.600, "brier": 0.3}, {"log_loss": 0.601, "brier": 0.2}, {"log_loss": 0.61, "brier": 0.1}])
    assert [r["log_loss"] for r in ranked] == [0.601, 0.600, 0.61]
    with pytest.raises(ValueError):
        splits.three_way(spark.createDataFrame([(1, date(2020, 1, 1))], "fight_id long, date date"))


def test_quotes(spark):
    from datetime import datetime as dt

    t = lambda h: dt(2026, 1, 1, h)
    row = lambda book, snap, at, a, b, ok=True: (1, book, snap, at, t(12), t(20), a, b, ok)
    q = spark.createDataFrame([row("x", 1, t(1), 2.0, 2.0), row("x", 2, t(5), 1.5, 3.0), row("x", 3, t(13), 9.0, 1.1), row("y", 4, t(6), 2.0, 2.0), row("sharp", 5, t(6), 4.0, 4.0 / 3), row("z", 6, t(6), 2.0, 2.0, False)], "event_id long, book string, snapshot_id long, observed timestamp_ntz, cutoff timestamp_ntz, starts timestamp_ntz, price_a double, price_b double, approved boolean")
    r = quotes.consensus(q, ("sharp",)).first()
    assert (round(r["median_fair"], 6), r["books"], r["coverage_low"], round(r["sharp_fair"], 6)) == (round((2 / 3 + 0.5) / 2, 6), 2, True, 0.25)
    assert r["excluded"] == ["x:observation_after_prediction_cutoff", "z:unapproved_sportsbook"]
    assert quotes.newly(spark.createDataFrame([("a",), ("a",), ("b",)], "selection_id string"), spark.createDataFrame([("b",)], "selection_id string")).collect()[0][0] == "a"


def test_ledger_versions(spark):
    kind = "prediction_id string, event_date string, fighter_a string, fighter_b string, model_version string, status string"
    led = spark.createDataFrame([("1", "d", "A", "B", "m", "pending"), ("2", "d", "C", "D", "m", "resolved")], kind)
    new = spark.createDataFrame([("3", "d", "b", "a", "m", "pending"), ("4", "d", "C", "D", "m", "pending"), ("5", "d", "C", "D", "n", "pending"), ("6", "d", "A", "B", "m", "error")], kind)
    ids = lambda policy: sorted(r[0] for r in ledger.append(led, new, policy)[0].select("prediction_id").collect())
    assert ids("reject") == ["1", "2", "5", "6"] and ids("overwrite_pending") == ["2", "3", "5", "6"] and ids("version") == ["1", "2", "3", "4", "5", "6"]
    history = spark.createDataFrame([(1, date(2020, 1, 1), 1, 2, 1), (2, date(2020, 2, 1), 1, 2, 1)], "fight_id long, date date, a_id long, b_id long, a_won int")
    card = spark.createDataFrame([(0, date(2020, 2, 1), 2, 3)], "row_no long, date date, a_id long, b_id long")
    (r,) = ledger.upcoming(history, card).collect()
    assert (r["fight_id"], r["a_rating"], r["b_rating"]) == (-1_000_001, 1484.0, 1500.0)


def test_models(spark):
    import random

    rng = random.Random(0)
    data = []
    for k in range(400):
        x = rng.gauss(0, 1)
        data.append((k, date(2020, 1, 1 + k // 20), None if k % 17 == 0 else x, rng.gauss(0, 1), int(rng.random() < 1 / (1 + 2.718281828 ** (-2 * x)))))
    rows = splits.three_way(spark.createDataFrame(data, "fight_id long, date date, x double, z double, y int")).cache()
    train = experiments.part(rows, "train")
    c, l1 = 0.05, 0.3
    fit = models.logistic(train, ["x", "z"], "y", c, l1, tol=1e-12, max_iter=500)
    # optimality of C * sum(loss) + l1 |w| + (1 - l1) / 2 w^2 at the fitted weights
    scored = fit.predict(fit.prep.transform(train).drop("features")).select("p", "y", *[((F.coalesce(n, F.lit(fit.prep.medians[n])) - fit.prep.means[n]) / fit.prep.deviations[n]).alias(f"s_{n}") for n in ("x", "z")]).collect()
    for w, n in zip(fit.model.coefficients, ("x", "z"), strict=True):
        slope = c * sum((r["p"] - r["y"]) * r[f"s_{n}"] for r in scored) + (1 - l1) * w
        assert abs(slope + l1 * (1 if w > 0 else -1)) < 1e-3 if w else abs(slope) <= l1 + 1e-3
    found = experiments.calibrate(rows, ["x", "z"], "y", 1.0, 0.0)
    assert found["models"]["platt"]["auc"] > 0.75 and found["best"] == "platt"
    assert experiments.leakage_report(["x"], train, experiments.part(rows, "test")) == {"names_ok": True, "disjoint": True, "in_order": True}
    assert [r["effect"] for r in experiments.ablation(rows, {"good": ["x"], "noise": ["z"]}, "y")][0] == "helpful"
    best = experiments.search(rows.filter("split <> 'test'"), {"both": ["x", "z"], "noise": ["z"]}, "y", [{"c": 1.0, "l1_ratio": 0.0}])
    assert best[0]["config"] == "both"
    played = experiments.replay(rows, ["x"], "y", [date(2020, 1, 15), date(2020, 1, 16)], 100, 60)
    assert played.count() == 40
    assert models.permutation_importance(fit, experiments.part(rows, "test"), "y", ["x"])[0]["importance"] > 0
    blended = experiments.blends(played.withColumn("q", F.lit(0.5)), "p", "q", "y").collect()
    assert len(blended) == 11 and blended[0]["log_loss"] == pytest.approx(0.693147, abs=1e-5)


def test_streaming(spark, tmp_path):
    schema = "entity long, fight_id long, date date, won int"
    rows = [(1, 1, date(2020, 1, 1), 1), (2, 1, date(2020, 1, 1), 0), (1, 2, date(2020, 1, 5), 0), (1, 3, date(2020, 2, 1), 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = live.running_record(stream).writeStream.format("memory").queryName("record").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["entity"], r["fight_id"]): (r["prior_fights"], r["prior_wins"], r["days_since_last_fight"]) for r in spark.table("record").collect()}
    assert got == {(1, 1): (0, 0, None), (2, 1): (0, 0, None), (1, 2): (1, 1, 4), (1, 3): (2, 1, 27)}
    bout = "fight_id long, date date"
    spark.createDataFrame([(1, date(2020, 1, 10))], bout).write.parquet(f"{tmp_path}/history")
    gate = live.gate_late(f"{tmp_path}/history", f"{tmp_path}/ok", f"{tmp_path}/late", bout)
    batch = spark.createDataFrame([(2, date(2020, 1, 9)), (3, date(2020, 1, 10))], bout)
    gate(batch, 0)
    gate(batch, 0)
    stored = lambda name: sorted(r["fight_id"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert stored("ok") == [3] and stored("late") == [2]
    shutil.rmtree(f"{tmp_path}/ok/batch=0")  # the job died before the second write
    gate(batch, 0)
    assert stored("ok") == [3] and stored("late") == [2]
    gate(spark.createDataFrame([(3, date(2020, 1, 10)), (4, date(2020, 1, 12)), (5, date(2020, 1, 10))], bout), 1)
    gate(spark.createDataFrame([(6, date(2020, 1, 11)), (4, date(2020, 1, 12)), (7, date(2020, 1, 12))], bout), 2)
    assert stored("ok") == [3, 4, 5, 7] and stored("late") == [2, 6]


def test_matchup_labels(spark):
    assert values(spark, matchup.dashboard_confidence, 0.8, 0.62, 0.5, kind="double") == ["Very high confidence", "Moderate confidence", "Toss-up"]
    assert values(spark, matchup.ledger_confidence, 0.15, 0.65, 0.5, kind="double") == ["strong", "lean", "toss-up"]
    rows = spark.createDataFrame([("A", None), ("B", None), ("A", 2.0)], "weight_class string, x double")
    assert [r["x_x_a"] for r in matchup.division_interactions(rows, ("x",), ["A"]).collect()] == [None, 0.0, 2.0]
