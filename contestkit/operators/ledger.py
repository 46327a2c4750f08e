"""Prediction ledger: append with a duplicate policy, resolution, monitoring, card view (INC-02 to INC-04, INC-06, INC-07, INC-10, JOIN-11 to JOIN-13, JOIN-17, SRT-09, SRV-01, SRV-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.functions.numeric import brier, clip, log_loss
from contestkit.functions.parse import any_date
from contestkit.functions.text import folded_name, name_key, pair_key
from contestkit.operators.filters import judge_input
from contestkit.operators.history import AGAINST, FORM, LAYOFF, RECORD, ROLLING, activity, form, layoff, rates, record, to_bouts, trailing
from contestkit.operators.identity import lookup
from contestkit.operators.matchup import matchup
from contestkit.operators.metrics import auc, evaluate
from contestkit.operators.rating import elo_by_league
from contestkit.session import cut

#: First number of made-up bouts for cards to come; they count down.
SYNTHETIC_ID = -1_000_001


def fight_key() -> Column:
    """Date and unordered pair of names."""
    return F.concat_ws("|", F.col("event_date").cast("string"), F.array_join(pair_key(name_key(F.col("fighter_a")), name_key(F.col("fighter_b"))), "|"))


def append(ledger: DataFrame, new: DataFrame, policy: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(ledger after the append, decision per new row). policy: reject, overwrite_pending or version.

    A duplicate has the key and model_version of an active (pending or resolved) row; the batch does not matter. Error
    rows are always appended. Rows of one batch are not compared with each other.
    """
    keyed, fresh = ledger.withColumn("k", fight_key()), new.withColumn("k", fight_key())
    active = keyed.filter(F.col("status").isin("pending", "resolved")).groupBy("k", "model_version").agg(F.bool_or(F.col("status") == "pending").alias("has_pending"))
    joined = fresh.join(active, ["k", "model_version"], "left")
    known = F.col("has_pending").isNotNull() & (F.col("status") != "error")
    decision = F.when(~known, "accepted")
    if policy == "overwrite_pending":
        decision = decision.when(F.col("has_pending"), "overwrites_pending")
    if policy == "version":
        decision = decision.when(known, "versioned")
    decided = joined.withColumn("decision", decision.otherwise("rejected_duplicate"))
    kept = keyed
    if policy == "overwrite_pending":
        over = decided.filter("decision = 'overwrites_pending'").select("k", "model_version").distinct()
        kept = keyed.filter("status <> 'pending' or status is null").unionByName(keyed.filter("status = 'pending'").join(over, ["k", "model_version"], "left_anti").select(*keyed.columns))
    taken = decided.filter("decision <> 'rejected_duplicate'").select(*ledger.columns)
    return kept.select(*ledger.columns).unionByName(taken), decided.select("prediction_id", "decision")


def resolve(ledger: DataFrame, results: DataFrame, overwrite: bool = False) -> DataFrame:
    """Matches results (event_date, fighter_a, fighter_b, winner) in either order, and scores pending rows.

    Adds outcome: resolved, skipped, error, unmatched, ambiguous or unknown_winner.
    """
    return judged(ledger.withColumn("k", fight_key()).join(found_results(results.withColumn("k", fight_key())), "k", "left"), ledger.columns, overwrite)


def found_results(results: DataFrame) -> DataFrame:
    """Results by key k: how many there are, and the winner of one."""
    return results.groupBy("k").agg(F.count("*").alias("found"), F.first(name_key(F.col("winner"))).alias("winner_key"), F.first("winner").alias("result_winner"))


def judged(joined: DataFrame, columns: list[str], overwrite: bool = False) -> DataFrame:
    """Ledger rows (of these columns) with what ``found_results`` tells of their key, scored; adds outcome."""
    target = F.when(F.col("winner_key") == name_key(F.col("fighter_a")), 1).when(F.col("winner_key") == name_key(F.col("fighter_b")), 0)
    outcome = F.when(F.col("status") == "error", "error").when((F.col("status") == "resolved") & F.lit(not overwrite), "skipped").when(F.col("found").isNull(), "unmatched").when(F.col("found") > 1, "ambiguous").when(target.isNull(), "unknown_winner").otherwise("resolved")
    p = F.col("predicted_probability_a")
    done = F.col("outcome") == "resolved"
    new = {
        "target_a_win": target, "winner": F.col("result_winner"), "log_loss": log_loss(p, target), "brier": brier(p, target),
        "correct_prediction": ((p >= 0.5) == (target == 1)).cast("int"), "status": F.lit("resolved"),
    }
    out = joined.withColumn("outcome", outcome)
    old = lambda c: F.col(c) if c in columns else F.lit(None)
    return out.withColumns({c: F.when(done, v).otherwise(old(c)) for c, v in new.items()}).drop("k", "found", "winner_key", "result_winner")


def unmatched_results(ledger: DataFrame, results: DataFrame) -> DataFrame:
    return results.withColumn("k", fight_key()).join(ledger.withColumn("k", fight_key()).select("k"), "k", "left_anti").drop("k")


def monitor(resolved: DataFrame, by: str) -> DataFrame:
    """Log loss, Brier score and accuracy by event, month or year; few rows are marked (INC-10, AGG-12)."""
    n = F.count("*")
    return resolved.groupBy(by).agg(n.alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg("correct_prediction").alias("accuracy"), F.when(n < 50, "insufficient_sample").when(n < 100, "small_sample").otherwise("ok").alias("status"))


#: Resolved predictions from which on figures are shown and stable, periods are told apart and an area under the curve is given. Fixed values.
LEAST_RESOLVED, STABLE, LEAST_FOR_PERIODS, LEAST_FOR_AUC = 50, 100, 30, 20
SHORT = "insufficient_sample"


def sample_level(n: int) -> str:
    """How far figures over n resolved predictions can be trusted."""
    return "too_noisy" if n < LEAST_RESOLVED else "preliminary" if n < STABLE else "usable"


def live_report(ledger: DataFrame, sizes: tuple[int, ...] = (50, 100)) -> dict:
    """The report on a live ledger (INC-10): counts, level of the sample, overall figures, by event, month and year, and rolling windows.

    ledger: event_date, event_name, seq (order of the append), status, target_a_win, predicted_probability_a, model_version. All gates go by the number of
    resolved rows of the whole ledger: a part below its gate is ``insufficient_sample``. The rows are read once, then stored.
    """
    p, y = clip(F.col("predicted_probability_a")), F.col("target_a_win").cast("int")
    stored = cut(ledger.select("event_date", "event_name", "seq", "status", F.coalesce("model_version", F.lit("")).alias("model"), p.alias("p"), y.alias("y")))
    counts = {r["status"]: r["count"] for r in stored.groupBy("status").count().collect()}  # a few statuses
    rows = stored.filter("status = 'resolved'").withColumns({"log_loss": log_loss(F.col("p"), F.col("y")), "hit": ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")})
    n = counts.get("resolved", 0)
    events = lambda df: df.select("event_date", "event_name").distinct().count()
    out = {"total": sum(counts.values()), "pending": counts.get("pending", 0), "resolved": n, "errors": counts.get("error", 0), "events": events(stored), "resolved_events": events(rows), "level": sample_level(n)}
    if not n:
        return out | {"overall": None}
    overall = evaluate(rows).first().asDict()
    overall["auc"] = auc(rows).first()["auc"] if n >= LEAST_FOR_AUC else None
    periods = {"month": F.date_format("event_date", "yyyy-MM"), "year": F.date_format("event_date", "yyyy")}
    out |= {"overall": overall, "by_event": evaluate(rows, ("event_date", "event_name"))}
    out |= {f"by_{name}": evaluate(rows.withColumn(name, c), (name,)) if n >= LEAST_FOR_PERIODS else SHORT for name, c in periods.items()}
    return out | {"rolling": rolling(rows, sizes) if n >= LEAST_RESOLVED else SHORT}


def rolling(rows: DataFrame, sizes: tuple[int, ...] = (50, 100)) -> DataFrame:
    """Log loss and accuracy of the last so many resolved predictions (event_date, seq, log_loss, hit), over all models; null until there are so many."""
    out = rows.withColumn("all", F.lit(True))
    for size in sizes:
        out = trailing(out, {"log_loss": F.col("log_loss"), "accuracy": F.col("hit")}, size, ("event_date", "seq"), "all")
    return out.drop("all")


def judge_card(card: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds each side's entity and all reasons why a bout of a card cannot be built (FLT-11, JOIN-10, INC-02).

    card: row_index, event_date, fighter_a, fighter_b. entities: entity, name_key (folded). To the reasons of ``judge_input`` come a side that no or
    several entities match, and one that an earlier bout of the day, itself in order, has already.
    """
    judged = judge_input(card, folded_name)
    for s in "ab":
        found = lookup(judged.withColumn("key", folded_name(F.col(f"fighter_{s}"))), entities.select("entity", F.col("name_key").alias("key")), "key")
        judged = found.withColumnsRenamed({"entity": f"{s}_id", "match_status": f"{s}_status"}).drop("key")
    told = [F.when(F.col(f"{s}_status") != "matched", F.concat(F.lit(f"{s}_"), F.col(f"{s}_status"))) for s in "ab"]
    judged = judged.withColumn("reasons", F.concat("reasons", F.array_compact(F.array(*told)))).withColumn("date", any_date(F.col("event_date")))
    # bouts of one day's card are judged in order: a bout that fails leaves its competitors free. A card has a few dozen bouts.
    order = F.array_sort(F.collect_list(F.struct("row_index", "a_id", "b_id", (F.size("reasons") == 0).alias("fit"))))
    start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<bigint>").alias("twice"))

    def step(done: Column, x: Column) -> Column:
        clash = F.array_contains(done["taken"], x["a_id"]) | F.array_contains(done["taken"], x["b_id"])
        taken = F.when(x["fit"] & ~clash, F.concat(done["taken"], F.array(x["a_id"], x["b_id"]))).otherwise(done["taken"])
        twice = F.when(x["fit"] & clash, F.concat(done["twice"], F.array(x["row_index"]))).otherwise(done["twice"])
        return F.struct(taken.alias("taken"), twice.alias("twice"))

    twice = judged.groupBy("date").agg(F.aggregate(order, start, step)["twice"].alias("rows")).select(F.explode("rows").alias("row_index")).withColumn("twice", F.lit(True))
    marked = judged.join(twice, "row_index", "left")
    return marked.withColumn("reasons", F.when(F.col("twice"), F.array_append("reasons", F.lit("competitor_twice_that_day"))).otherwise(F.col("reasons"))).drop("twice")


def upcoming(history: DataFrame, card: DataFrame, k: float = 32.0, start: float = 1500.0, snapshots: DataFrame | None = None) -> DataFrame:
    """Ratings before a card: history strictly before each card's day, and made-up bouts with numbers from -1,000,001 down (INC-02).

    history: fight_id, date, a_id, b_id, a_won. card: date, a_id, b_id, row_no (from 0). A side's rating is the one after its last bout before the card's day: with stored
    ``snapshots`` of all of history (as ``elo`` gives them) a pass over the card's competitors' rows finds it, without them all bouts are rated first.
    """
    out = card.select((F.lit(SYNTHETIC_ID) - F.col("row_no")).alias("fight_id"), "date", "a_id", "b_id")
    wanted = out.select(F.explode(F.array("a_id", "b_id")).alias("entity"), F.col("date").alias("card_day")).distinct()
    rated = elo_by_league(history, k, start) if snapshots is None else snapshots
    long = rated.select(F.explode(F.array(*[F.struct(F.col(f"{s}_id").alias("entity"), F.struct("date", "fight_id").alias("at"), F.col(f"{s}_post").alias("rating")) for s in "ab"])).alias("r")).select("r.*")
    last = long.join(wanted, "entity").filter(F.col("at.date") < F.col("card_day")).groupBy("entity", "card_day").agg(F.max_by("rating", "at").alias("rating"))
    for s in "ab":
        out = out.join(last.select(F.col("entity").alias(f"{s}_id"), F.col("card_day").alias("date"), F.col("rating").alias(f"{s}_rating")), [f"{s}_id", "date"], "left")
    out = out.fillna(start, ["a_rating", "b_rating"])
    return out.select("fight_id", "date", "a_id", "b_id", "a_rating", "b_rating", (1 / (1 + F.pow(F.lit(10.0), (F.col("b_rating") - F.col("a_rating")) / 400.0))).alias("a_expected"))


def upcoming_features(appearances: DataFrame, history: DataFrame, card: DataFrame, k: float = 32.0, start: float = 1500.0, snapshots: DataFrame | None = None) -> DataFrame:
    """All features of a card's bouts (INC-02, SET-04): record, form, layoff, rates, matchup projections and ratings, and the last day used.

    appearances: two rows a bout, as ``history.features`` takes them; history and card as ``upcoming`` does. The card's bouts are appended as rows without result
    or statistics and the same windows run over both. They are the last of their day and each day's card sees history
    before it only, so cards of several days are windowed apart.
    """
    days = card.select("date").distinct().withColumnRenamed("date", "card_day")
    rows = card.select((F.lit(SYNTHETIC_ID) - F.col("row_no")).alias("fight_id"), "date", "a_id", "b_id")
    side = lambda s, o: F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("entity"), F.col(f"{o}_id").alias("opponent"))
    made = rows.select("fight_id", "date", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("r")).select("fight_id", "date", "r.*").withColumns({"won": F.lit(0), "has_stats": F.lit(False), "opp_has_stats": F.lit(False)})
    # only bouts of the card's competitors matter, once for each later card day
    named = made.select("entity", F.col("date").alias("card_day")).distinct()
    earlier = appearances.join(named, "entity").filter(F.col("date") < F.col("card_day"))
    both = earlier.unionByName(made.withColumn("card_day", F.col("date")), allowMissingColumns=True)
    both = both.withColumn("own", F.col("entity")).withColumn("entity", F.struct("own", "card_day"))  # a window a competitor and card day
    known = rates(layoff(activity(form(record(both))))).withColumn("entity", F.col("own")).filter(F.col("fight_id") <= SYNTHETIC_ID)
    wide = matchup(to_bouts(known, (*RECORD, *FORM, "days_since_last_fight", *LAYOFF, *ROLLING, *AGAINST, "no_prior_stats"))).drop("a_won", "a_id", "b_id", "date")
    used = history.join(F.broadcast(days), F.col("date") < F.col("card_day")).groupBy("card_day").agg(F.max("date").alias("last_day_used"))  # the days of a card
    return upcoming(history, card, k, start, snapshots).join(wide, "fight_id").join(used.withColumnRenamed("card_day", "date"), "date", "left")


#: Sections of a card, the first shown first. Fixed values.
SECTIONS = ("main_event", "main_card", "prelims", "early_prelims")


def section_rank(section: Column) -> Column:
    """Position of a card's section; unknown ones come last (SRT-09)."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SECTIONS)), F.lower(F.trim(section))), F.lit(0)), F.lit(len(SECTIONS) + 1)).cast("int")


def with_weight_class(ledger: DataFrame, features: DataFrame) -> DataFrame:
    """Adds the weight class of the first feature row (row_index) of a bout's key (JOIN-13)."""
    first = features.withColumn("k", fight_key()).groupBy("k").agg(F.min_by("weight_class", "row_index").alias("weight_class"))
    return ledger.drop("weight_class").withColumn("k", fight_key()).join(first, "k", "left").drop("k")


def timeline(bouts: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """One competitor's bouts in order, with the side it was on (SRV-04). bouts: date, fight_id, fighter_a, fighter_b and the columns."""
    a, b = name_key(F.col("fighter_a")) == name_key(F.lit(name)), name_key(F.col("fighter_b")) == name_key(F.lit(name))
    return bouts.filter(a | b).select("date", "fight_id", F.when(a, "a").otherwise("b").alias("side"), *columns).orderBy("date", "fight_id")


def card_view(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per event: bouts with or without a frozen prediction, nested and in order; status frozen, partial or unavailable.

    Bouts go by section, if the manifest tells it, then order, then names (SRT-09). A full outer join on the bout's key: the manifest is the inventory, predictions without an entry are kept.
    """
    m, p = manifest.withColumn("k", fight_key()), ledger.withColumn("k", fight_key())
    ranked = "card_section" in manifest.columns
    a = m.select("k", *([section_rank(F.col("card_section")).alias("rank")] if ranked else []), F.col("event_date").alias("m_date"), F.col("event_name").alias("m_event"), "bout_order", F.col("fighter_a").alias("m_a"), F.col("fighter_b").alias("m_b"))
    b = p.select("k", F.col("event_date").alias("p_date"), F.col("event_name").alias("p_event"), F.col("fighter_a").alias("p_a"), F.col("fighter_b").alias("p_b"), "predicted_probability_a", "prediction_batch_id", "prediction_timestamp_utc")
    row = a.join(b, "k", "full_outer").select(
        F.coalesce("m_date", "p_date").alias("event_date"), F.coalesce("m_event", "p_event").alias("event_name"),
        F.struct(*([F.coalesce("rank", F.lit(len(SECTIONS) + 1)).alias("section_rank")] if ranked else []), F.coalesce("bout_order", F.lit(1_000_000)).alias("bout_order"), F.coalesce("m_a", "p_a").alias("fighter_a"), F.coalesce("m_b", "p_b").alias("fighter_b"), F.when(name_key(F.coalesce("m_a", "p_a")) == name_key(F.coalesce("p_a", "m_a")), F.col("predicted_probability_a")).otherwise(1 - F.col("predicted_probability_a")).alias("probability_a")).alias("bout"),
        "prediction_batch_id", "prediction_timestamp_utc",
    )
    there = F.count("bout.probability_a")
    return row.groupBy("event_date", "event_name").agg(F.array_sort(F.collect_list("bout")).alias("bouts"), F.min("prediction_timestamp_utc").alias("first_timestamp"), F.array_sort(F.collect_set("prediction_batch_id")).alias("batches"), F.when(there == 0, "unavailable").when(there == F.count("*"), "frozen").otherwise("partial").alias("status"))


def apply_plan(history: DataFrame, event: DataFrame) -> DataFrame:
    """Decision on adding an event's bouts: blocked if before the last stored day, warned if on it (INC-05, INC-06)."""
    last = history.agg(F.max("date").alias("last_date"))
    known = history.select("date", pair_key(F.col("a_id"), F.col("b_id")).alias("pair")).distinct().withColumn("stored", F.lit(True))
    joined = event.withColumn("pair", pair_key(F.col("a_id"), F.col("b_id"))).join(known, ["date", "pair"], "left").crossJoin(F.broadcast(last))  # one row
    decision = F.when(F.col("stored"), "already_stored").when(F.col("date") < F.col("last_date"), "blocked_late").when(F.col("date") == F.col("last_date"), "append_same_day").otherwise("append")
    return joined.select(*event.columns, decision.alias("decision"))


def next_action(pages: int, missing: int, stale: int) -> str:
    """What an audit of fetched pages asks for: pages, nothing, or a guarded apply."""
    return "save_pages" if not pages else "current" if not missing and not stale else "propose_guarded_apply"


def compare(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched events (url, name_key, bouts) against stored ones: by URL, else by name; missing, stale, ambiguous or current (JOIN-17, INC-07)."""
    by_url = stored.filter("url is not null").groupBy("url").agg(F.max("bouts").alias("url_bouts"))
    by_name = stored.groupBy("name_key").agg(F.count("*").alias("names"), F.max("bouts").alias("name_bouts"))
    joined = fetched.join(by_url, "url", "left").join(by_name, "name_key", "left")
    held = F.coalesce("url_bouts", F.when(F.col("names") == 1, F.col("name_bouts")))
    status = F.when(F.col("url_bouts").isNull() & (F.col("names") > 1), "ambiguous").when(held.isNull(), "missing").when(held < F.col("bouts"), "stale").otherwise("current")
    return joined.select("url", "name_key", "bouts", held.alias("stored_bouts"), status.alias("status"))
