import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from contestkit.operators import experiments, filters, history, identity, ledger, models, quotes, rating, rules, splits, studies
from contestkit.sources import pages, tables


def test_structure_and_card(spark):
    found = filters.structure(["event_date", "fighter_a", "fighter_b", "winner", "closing_odds"], ("elo_diff",))
    assert found == {"missing_ids": ["event_name"], "missing_features": ["elo_diff"], "results": ["winner"], "markets": ["closing_odds"]}
    rows = [(0, "2026-01-03", "Ann", "Bob"), (1, "2026-01-03", "bob", "ANN"), (2, "2026-01-03", "Ann", "Cid"), (3, "2026-01-03", "Dan", "Eve"), (4, "2026-01-03", "Nobody", "Fay"), (5, "2026-01-03", "Fay", "Twin"), (6, "2026-01-04", "Ann", "Cid"), (7, "x", "Ann", "Cid")]
    card = spark.createDataFrame(rows, "row_index long, event_date string, fighter_a string, fighter_b string")
    names = spark.createDataFrame([(k, n) for k, n in enumerate("ann bob cid dan eve fay twin twin".split())], "entity long, name_key string")
    got = {r["row_index"]: r["reasons"] for r in ledger.judge_card(card, names).collect()}
    assert got == {0: [], 1: ["duplicate"], 2: ["competitor_twice_that_day"], 3: [], 4: ["a_unmatched"], 5: ["b_ambiguous"], 6: [], 7: ["bad_date"]}


def test_guarded_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    base = f"file://{tmp_path}"
    with pytest.raises(ValueError, match="protected"):
        tables.rebuild(rows, f"{base}/official/x", (f"{tmp_path}/official",))
    with pytest.raises(ValueError, match="protected"):
        tables.outside(f"{base}", (f"{tmp_path}/official",))
    assert tables.rebuild(rows, f"{base}/mine", (f"{tmp_path}/official",)).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_only(spark, f"{base}/none")
    target = f"{base}/t"
    assert tables.current(spark, target) is None
    first = tables.promote(rows, target, {"positive": F.col("k") > 0})
    assert tables.current(spark, target) == first
    with pytest.raises(ValueError, match="back to"):
        tables.promote(rows.limit(1), target, {}, lambda df: df.count() == 2)
    assert tables.current(spark, target) == first and spark.read.parquet(first).count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"x": 1}')
    assert tables.load_json(spark, f"{base}/j", "x int").first()["document"]["x"] == 1
    digest = tables.tree_digest(spark, f"{base}/j")
    (tmp_path / "j" / "b.json").write_text("{broken")
    with pytest.raises(ValueError, match="b.json"):
        tables.load_json(spark, f"{base}/j", "x int")
    assert tables.tree_digest(spark, f"{base}/j") != digest and tables.digests(spark, f"{base}/j").count() == 2
    out, text = tables.write_report({"n": 2, "parts": [{"a": 1, "b": None}], "more": {"x": [1, 2]}}, tmp_path / "r", "report")
    assert json.loads(out.read_text())["parts"] == [{"a": 1, "b": None}] and "| a | b |" in text.read_text()


def test_next_action():
    assert [ledger.next_action(*x) for x in ((0, 0, 0), (3, 0, 0), (3, 1, 0))] == ["save_pages", "current", "propose_guarded_apply"]


ROW = """<tr data-link="http://x/fight-details/{k}"><td><p><i class="b-flag__text">win</i></p></td><td><p><a href="http://x/fighter-details/a1">A One</a></p><p><a href="http://x/fighter-details/b2">B Two</a></p></td>
<td><p>1</p><p>0</p></td><td><p>20</p><p>10</p></td><td><p>2</p><p>--</p></td><td><p>0</p></td><td><p>Flyweight</p></td><td><p>SUB</p><p>Choke</p></td><td><p>2</p></td><td><p>1:30</p></td></tr>"""
DETAIL = f'<h2><span class="b-content__title-highlight">Event 1</span></h2><table class="b-fight-details__table"><tbody>{ROW.format(k="f1")}<tr data-link="http://x/fight-details/f2"><td></td></tr></tbody></table>'


def test_page_types_and_details():
    listing = "<table class='b-statistics__table-events'></table>"
    labels = [
        (None, "unknown"), ("Checking your browser", "browser_challenge"), (listing, "completed_events"), ("<!-- saved from x/statistics/events/upcoming -->" + listing, "upcoming_events"), ("<a href='event-details/1'>" * 3, "completed_events"), (DETAIL, "event_detail"),
        ("<i>Stance:</i><a href='fighter-details/1'>", "fighter_detail"), ("<!-- fighter-details/1 -->", "fighter_detail"), ("<a href='event-details/1'>", "events_list"), ("<p>x</p>", "unknown"),
    ]
    assert [pages.classify(p) for p, _ in labels] == [want for _, want in labels]
    one, blocked = pages.event_details(DETAIL)
    assert blocked["blocked"] and blocked["fight_id"] == "f2" and blocked["a"] is None
    assert (one["fight_id"], one["winner"], one["weight_class"], one["method"], one["method_detail"], one["round"], one["minutes"], one["completed"]) == ("f1", "A One", "Flyweight", "Submission", "Choke", 2, 6.5, True)
    assert (one["a"]["fighter_id"], one["a"]["knockdowns"], one["b"]["sig_str_landed"], one["b"]["td_landed"], one["a"]["sub_attempts"]) == ("a1", 1, 10, None, None)


def test_quote_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert quotes.seed(spark, root) == quotes.seed(spark, root) > 11
    good = '{"timestamp":"t","data":[{"id":1,"sport_key":"s","commence_time":"c","home_team":"h","away_team":"a","bookmakers":[]}]}'
    snap = lambda rows: rows.select(F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("snapshot_id"), F.lit("normalized").alias("status"))
    assert quotes.ingest(good, "p", spark, root, snap, dry_run=True)["batch_id"] is None and not tables.there(spark, f"{root}/batches")
    assert quotes.ingest(good, "p", spark, root, snap)["snapshots_inserted"] == 2
    assert quotes.ingest(good, "p", spark, root, snap)["snapshots_inserted"] == 0
    with pytest.raises(ValueError, match="no timestamp"):
        quotes.ingest('{"data":[]}', "p", spark, root, snap)
    batches = [(r["response_status"], r["error_message"]) for r in spark.read.parquet(f"{root}/batches").collect()]
    assert sorted(batches, key=str) == [("failed", "no timestamp"), ("ok", None), ("ok", None)]
    assert spark.read.parquet(f"{root}/payloads").count() == 2
    t = datetime(2026, 1, 1)
    out = "array<struct<name:string,price:double>>"
    market = spark.createDataFrame([("normalized", "matched", "h2h", t, datetime(2026, 1, 3), "book", "mma", "Prelims", "cancelled", [("a", 2.0), ("b", 2.0)])], f"status string, match_status string, market_type string, observed timestamp_ntz, starts timestamp_ntz, book string, sport_key string, card_section string, event_status string, outcomes {out}")
    checks = quotes.sample_checks(market, "mma", retention=True).first().asDict()
    assert len(checks) == 13 and all(checks.values())
    assert not quotes.sample_checks(market, "box", retention=True).first()["accepted"] and not quotes.sample_checks(market.limit(0), "mma", retention=True).first()["accepted"]
    stored = spark.createDataFrame([(1, 10, 20, date(2020, 1, 1), "normalized", "x"), (2, 10, 20, date(2020, 1, 1), "rejected_schema", "x"), (3, 7, 8, date(2020, 1, 1), "normalized", "y")], "snapshot_id long, a_id long, b_id long, day date, status string, batch_id string")
    bouts = spark.createDataFrame([(5, date(2020, 1, 2), 20, 10)], "fight_id long, date date, a_id long, b_id long")
    after, counts = quotes.rematch(stored, bouts)
    assert counts.first().asDict() == {"examined": 3, "matched": 1, "unmatched": 1, "ambiguous": 0, "rejected": 1}
    assert {r["snapshot_id"]: (r["fight_id"], r["same_side"]) for r in after.collect()} == {1: (5, False), 2: (None, None), 3: (None, None)}
    assert quotes.rematch(stored, bouts, "y")[1].first()["examined"] == 1


def test_mappings_and_reports(spark, tmp_path):
    known = spark.createDataFrame([("fighter", 1), ("bout", 2)], "entity_type string, entity long")
    row = lambda kind, e, raw="José X": spark.createDataFrame([("p", kind, raw, e, "me")], "provider string, entity_type string, raw string, entity long, created_by string")
    path = f"file://{tmp_path}/m"
    assert identity.import_mappings(row("fighter", 1), known, path) == 1 and identity.import_mappings(row("fighter", 1, "jose x"), known, path) == 1
    for bad in (row("fighter", 9), row("event", 1)):
        with pytest.raises(ValueError, match="unknown"):
            identity.import_mappings(bad, known, path)
    ids = spark.createDataFrame([("s1", "n"), ("s2", "n"), ("s3", "m")], "slug string, name_key string")
    bouts = spark.createDataFrame([(1, "n"), (2, "n"), (3, "n"), (4, "m")], "ref long, name_key string")
    done = spark.createDataFrame([(1, "s1", "age"), (2, "s1", "age"), (3, None, "unresolved"), (4, "s3", "unique_name")], "ref long, slug string, rule string")
    (r,) = identity.split_report(bouts, done, ids).collect()
    assert (r["name_key"], r["identities"], r["bouts"], r["unresolved"], [tuple(x) for x in r["by_slug"]]) == ("n", 2, 3, 1, [("s1", 2)])
    with pytest.raises(ValueError, match="repeats"):
        history.one_to_one(bouts, bouts.union(bouts), "ref")


def test_ranges_and_leagues(spark, monkeypatch):
    monkeypatch.setattr(history, "RANGE", 20)
    rng = random.Random(3)
    rows = [("m" if k % 3 else "n", date(2020, 1, 1 + rng.choice([0, 0, 0, 1, 2, 20])), k, rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "model string, date date, fight_id long, x double")
    got = {r["fight_id"]: r["x_7"] for r in history.trailing(df, {"x": F.col("x")}, 7).collect()}
    assert len(got) == 300
    for name in "mn":
        own = sorted((d, k, x) for m, d, k, x in rows if m == name)
        for at, (_, k, _) in enumerate(own):
            want = sum(x for *_, x in own[at - 6 : at + 1]) / 7 if at >= 6 else None
            assert got[k] == want or got[k] == pytest.approx(want)
    bouts = spark.createDataFrame([(1, 5, 6), (2, 6, 7), (3, 7, 8), (4, 8, 9), (5, 20, 21), (6, 22, 21), (7, 30, 30)], "fight_id long, a_id long, b_id long")
    assert {r["fight_id"]: r["league"] for r in rating.with_leagues(bouts).collect()} == {1: 5, 2: 5, 3: 5, 4: 5, 5: 20, 6: 20, 7: 30}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    data = []
    for k in range(500):
        x = rng.gauss(0, 1)
        data.append((k, date(2020, 1, 1 + k // 20), x, rng.gauss(0, 1), None if k % 9 == 0 else abs(rng.gauss(0, 1)), rng.choice(["A", "B"]), int(rng.random() < 1 / (1 + 2.718281828 ** (-2 * x)))))
    df = spark.createDataFrame(data, "fight_id long, date date, x_diff double, z_diff double, w_diff double, weight_class string, y int")
    return splits.three_way(df.coalesce(1)).cache()


def test_artifacts_and_groups(rows, tmp_path):
    every = [c for g in models.FEATURE_GROUPS.values() for c in g]
    models.check_groups(every)
    assert models.columns_of(["age", "elo"], every) == ["elo_diff", "age_diff"]
    with pytest.raises(ValueError, match="in none"):
        models.check_groups([*every, "more"])
    with pytest.raises(ValueError, match="unknown"):
        models.columns_of(["nope"], every)
    train, test = experiments.part(rows, "train"), experiments.part(rows, "test")
    fit = models.logistic(train, ["x_diff", "z_diff"], "y")
    fit.calibrator = models.Platt().fit(fit.predict(experiments.part(rows, "calibration")).withColumn("y", F.col("y")))
    version = models.save(fit, f"file://{tmp_path}/m", "v1")
    again, manifest = models.load(f"file://{tmp_path}/m", ["x_diff", "z_diff"])
    assert manifest["feature_schema_version"] == version and manifest["calibration_version"] == "platt"
    ps = [sorted(r["p"] for r in m.predict(test).select("p").collect()) for m in (fit, again)]
    assert ps[0] == pytest.approx(ps[1])
    with pytest.raises(ValueError, match="artifact"):
        models.load(f"file://{tmp_path}/m", ["z_diff", "x_diff"])
    steps = models.Isotonic([0.1, 0.5], [0.2, 0.8]).apply(test.select(F.explode(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.9), F.lit(None).cast("double"))).alias("p")).limit(4))
    assert [r["p"] for r in steps.collect()] == pytest.approx([0.2, 0.5, 0.8, None])
    if "xgboost" not in models.boosters():
        with pytest.raises(ModuleNotFoundError):
            models.external_boosted(train, ["x_diff"], "y")


def test_studies(rows):
    pretest, test = rows.filter("split <> 'test'"), experiments.part(rows, "test")
    found = studies.layoff_study(rows.withColumn("bucket", F.when(F.col("w_diff") > 1, "long").otherwise("short")), ["z_diff"], {"more": ["x_diff"]}, "y", "bucket")
    assert found["recommendation"] == "confirm" and set(found["models"]["more"]["by_bucket"]) == {"long", "short"}
    audit = studies.feature_audit(rows, ["x_diff", "z_diff", "w_diff"], "y")
    assert audit["leaking"] == [] and audit["features"][0]["feature"] == "x_diff" and all(s["train_only"] for s in audit["scaling"])
    linear = lambda *cols: lambda part: models.logistic(part, list(cols), "y", 1.0, 0.0)
    sure = studies.confirmation(pretest, test, {"official": linear("z_diff"), "both": linear("x_diff", "z_diff")}, "official", "y")
    assert sure["best"] == "both" and sure["promote"] and sure["summaries"]["both"]["folds_won"] == 5 and sure["stability"]["both"]["always"] == 2
    mixed = studies.interaction_study(pretest, ["x_diff", "z_diff"], {"x": ("x_diff",)}, "y", 1.0, 0.0)
    assert sorted(mixed["divisions"]) == ["A", "B"] and mixed["candidates"]["x"]["n_folds"] == 5
    windows = splits.folds(pretest, splits.CONFIRMATION_FOLDS)
    checks = studies.leakage_checks(windows, test, ["x_diff"])
    assert all(checks.values()) and not studies.leakage_checks(windows, pretest, ["winner"])["names_ok"]
    assert len(studies.points(studies.GRID)) == 24 and len(studies.points(studies.COARSE)) == 32
    near = studies.around({"rate": 0.03, "leaves": 3, "least_leaf": 20, "l2": 0.0})
    assert len(near) == 3 * 2 * 3 * 2


def test_nonlinear_and_sanity(rows):
    pretest, test = rows.filter("split <> 'test'"), experiments.part(rows, "test")
    one = [{"rate": 0.1, "leaves": 3, "least_leaf": 100, "l2": 0.0}]
    out = studies.nonlinear_study(pretest, test, ["x_diff", "z_diff"], "y", one, 1.0, 0.0, rounds=3)
    assert out["replace_now"] is False and not out["nonlinear_promotable"] and len(out["blend"]["means"]) == 11 and set(out["final"]) == {"linear", "blend", out["best"]}
    turned = studies.orientation(experiments.part(rows, "test").withColumn("p", F.lit(0.9) - 0.8 * F.col("y")), "y")
    assert not turned["ok"]
    missing = {r["feature"]: r for r in studies.missingness(rows, ["x_diff", "w_diff"])}
    assert missing["x_diff"]["spread"] == 0 and missing["w_diff"]["train"] > 0
    assert studies.parity({"a": rows, "b": rows.orderBy("fight_id")}, "y")["aligned"] and not studies.parity({"a": rows, "b": test}, "y")["aligned"]


def test_rules():
    assert [rules.effect(x) for x in (0.003, -0.003, 0.002)] == ["helpful", "harmful", "neutral"]
    assert rules.ablation_verdict(0.65, {"a": 0.64, "b": 0.649}) == {"beats_official": ["a"], "keep": "official"}
    f = lambda loss, own=False: {"test_log_loss": loss, "official_features": own}
    assert rules.replacement(0.65, [f(0.66), f(0.649), f(0.65), f(0.60)]) is None and rules.replacement(0.65, [f(0.66)] * 3 + [f(0.60, True)])["test_log_loss"] == 0.60
    assert [rules.weight_class_verdict(*x) for x in ((0.66, 0.65, False), (0.65, 0.65, True), (0.65, 0.65, False))] == ["robust_drop", "zeroed_by_penalty", "inconclusive"]
    assert rules.include_interactions(0.0, 4, ["x"]) and not rules.include_interactions(0.01, 5, [])
    m = lambda name, loss, **k: {"name": name, "log_loss": loss, "brier": 0.2, "test_log_loss": loss, "test_brier": 0.2, "folds_won": 3, "nonzero_interactions": 5} | k
    done = rules.interaction_criteria(m("s", 0.64), m("o", 0.66), m("c", 0.65), True)
    assert done["pass"] and done["replace_now"] is False
    assert not rules.interaction_criteria(m("s", 0.6495, nonzero_interactions=31), m("o", 0.66), m("c", 0.65), True)["criteria"]["not_too_complex"]
    assert rules.nonlinear_promotable(0.003, 4, 0.64, 0.64, True) and not rules.blend_promotable(0.64, 0.641, 0.66, 0.6, 0.7, True)
    assert rules.result_is_real({"a": (0.65, 0.65005)}, {"x": False}, False) and not rules.result_is_real({"a": (0.65, 0.6502)}, {}, False)
    assert rules.conjunction({"a": True, "b": False}) == (False, ["b"])
    assert rules.listed([("a", "2020-01-01"), ("b", None), ("c", "2021-01-01")], "2020-06-01", 1) == ["b"]


def test_registry(spark):
    venues = {
        "prediction_market": ("kalshi", "polymarket"), "exchange": ("betfair_ex", "betfair_exchange", "matchbook", "smarkets"), "peer_to_peer": ("sporttrade", "prophet_exchange"),
        "daily_fantasy": ("prizepicks", "underdog", "underdog_fantasy", "sleeper", "sleeper_picks"), "sweepstakes": ("fliff",), "unknown": ("DraftKings Sportsbook", "theScore Bet", "", None),
    }
    keys = {k: v for v, own in venues.items() for k in own} | dict.fromkeys((" DraftKings ", "thescore_bet", "ESPNbet", "hard_rock_bet", "circa"), "sportsbook")
    rows = spark.createDataFrame([(k,) for k in keys], "provider_key string")
    got = {r["provider_key"]: r for r in quotes.resolved(rows, quotes.registry(spark)).collect()}
    assert {k: r["venue_type"] for k, r in got.items()} == keys
    assert all((r["book"] is None and not r["approved"] and r["source_reason"]) for r in got.values() if r["venue_type"] != "sportsbook")
    assert got["kalshi"]["source_reason"] == "venue type prediction_market is prohibited"
    assert (got["ESPNbet"]["book"], got["thescore_bet"]["book"], got[" DraftKings "]["book"]) == ("thescore_bet", "thescore_bet", "draftkings")
    assert not got["circa"]["approved"] and got["hard_rock_bet"]["approved"] and not got["hard_rock_bet"]["broad"]
    again = {r["provider_key"]: r for r in quotes.resolved(rows, quotes.registry(spark, overrides=("circa",))).collect()}
    assert again["circa"]["approved"] and again["circa"]["source_reason"] is None and not again["kalshi"]["approved"]


def test_page_types_of_saved_and_named_pages():
    listing = "<table class='b-statistics__table-events'></table>"
    saved = "<!-- saved from url=(0056)http://x/statistics/events/{} -->"
    assert pages.classify(saved.format("completed") + "<a href='x/statistics/events/upcoming'>" + listing) == "completed_events"
    assert pages.classify("<p>Checking your browser</p>" + DETAIL, "event_a1.html") == "browser_challenge"
    assert pages.classify(DETAIL + "Stance: record: fighter-details/a", "event_a1.html") == "event_detail" == pages.classify(DETAIL + "Stance:")
    assert pages.classify("Record: 20-3-0 STANCE: Orthodox fighter-details/self") == "fighter_detail" == pages.classify("stance: x")
    assert pages.classify("<b class='b-content__title-highlight'></b> fight-details/1 stance:") == "event_detail"
    assert pages.classify("plain", "event_a1.html") == "unknown"


def test_interaction_criteria_without_test_figures():
    m = lambda name, loss, **k: {"name": name, "log_loss": loss, "brier": 0.2, "test_log_loss": None, "test_brier": None, "folds_won": 3, "nonzero_interactions": 5} | k
    of = lambda *x: rules.interaction_criteria(*x)["criteria"]
    assert rules.interaction_criteria(m("s", 0.64), m("o", 0.66), m("c", 0.65), True)["pass"]
    assert not of(m("s", 0.65), m("o", 0.66), m("c", 0.65), True)["beats_or_is_challenger"] and of(m("c", 0.65), m("o", 0.66), m("c", 0.65), True)["beats_or_is_challenger"]
    worse = of(m("s", 0.64, test_log_loss=0.67, test_brier=0.2015), m("o", 0.66, test_log_loss=0.66, test_brier=0.2), m("c", 0.65), False)
    assert not worse["test_consistent"] and not worse["calibration_not_worse"] and not worse["leakage_ok"]
    assert of(m("s", 0.64, test_log_loss=0.651), m("o", 0.66, test_log_loss=0.66), m("c", 0.65, test_log_loss=0.65), True)["test_consistent"]
    assert not of(m("s", 0.64, test_log_loss=0.653), m("o", 0.66, test_log_loss=0.66), m("c", 0.65, test_log_loss=0.65), True)["test_consistent"]
