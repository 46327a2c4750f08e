"""Bookmaker prices: ingest, flattening, bout matching and as-of consensus (ODD, FLT-19, FLT-20, IDN-10, IDN-11, JOIN-14, JOIN-18)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestkit.functions.numeric import fair_share, implied, price_error
from contestkit.functions.parse import days_around, utc_timestamp
from contestkit.functions.text import pair_key, prefixed_id
from contestkit.operators.filters import first_reason
from contestkit.sources.tables import append_new, archive_key, there, tree_digest

OUTCOME = "array<struct<name:string,price:double>>"
MARKET = f"array<struct<key:string,last_update:string,id:string,outcomes:{OUTCOME}>>"
EVENT = f"array<struct<id:string,sport_key:string,sport_title:string,commence_time:string,home_team:string,away_team:string,status:string,bookmakers:array<struct<key:string,title:string,last_update:string,markets:{MARKET}>>>>"
#: Schema of a provider's historical payload; the current one is the bare array.
PAYLOAD = f"timestamp string, previous_timestamp string, next_timestamp string, data {EVENT}"

#: key, venue, approved, in the broad consensus, sharp reference, provider's keys. Fixed values.
BOOKS = (
    ("draftkings", "sportsbook", True, True, False, ("draftkings",)),
    ("fanduel", "sportsbook", True, True, False, ("fanduel", "fanduel_us")),
    ("betmgm", "sportsbook", True, True, False, ("betmgm",)),
    ("caesars", "sportsbook", True, True, False, ("caesars", "williamhill_us")),
    ("fanatics", "sportsbook", True, True, False, ("fanatics", "fanatics_us", "pointsbetus")),
    ("betrivers", "sportsbook", True, True, False, ("betrivers", "betrivers_us", "sugarhouse")),
    ("thescore_bet", "sportsbook", True, True, False, ("thescorebet", "espnbet")),
    ("pinnacle", "sportsbook", True, False, True, ("pinnacle",)),
    ("hard_rock_bet", "sportsbook", True, False, False, ("hardrockbet", "hard_rock_bet")),
    ("bet365", "sportsbook", False, False, False, ("bet365", "bet365_us")),
    ("circa", "sportsbook", False, False, False, ("circa", "circasports")),
)


#: Sources that are no sportsbooks, by venue type. Fixed values.
EXCLUDED = (
    ("prediction_market", ("kalshi", "polymarket")),
    ("exchange", ("betfair_ex", "betfair_exchange", "matchbook", "smarkets")),
    ("peer_to_peer", ("sporttrade", "prophet_exchange")),
    ("daily_fantasy", ("prizepicks", "underdog", "underdog_fantasy", "sleeper", "sleeper_picks")),
    ("sweepstakes", ("fliff",)),
)


def source_key(raw: Column) -> Column:
    """A provider's key as the registry has it: without outer blanks, in lower case; display names mean nothing."""
    return F.lower(F.trim(raw))


def registry(spark: SparkSession, overrides: tuple[str, ...] = ()) -> DataFrame:
    """One row per provider key, canonical keys and excluded sources included; a fixed dimension of a few rows (ODD-01).

    ``overrides`` are canonical keys of books that count as approved although they are pending. Excluded sources have a venue type and no book.
    """
    listed = [(alias, key, venue, ok or key in overrides, broad, sharp) for key, venue, ok, broad, sharp, aliases in BOOKS for alias in dict.fromkeys((key, *aliases))]
    barred = [(key, None, venue, False, False, False) for venue, keys in EXCLUDED for key in keys]
    return spark.createDataFrame(listed + barred, "provider_key string, book string, venue_type string, approved boolean, broad boolean, sharp boolean")


def resolved(rows: DataFrame, books: DataFrame) -> DataFrame:
    """``rows`` (provider_key) with book, venue_type (``unknown`` without an entry), approved, broad, sharp and ``source_reason``, which tells why it is not approved."""
    known = books.withColumnRenamed("provider_key", "_key")
    joined = rows.join(F.broadcast(known), source_key(F.col("provider_key")) == F.col("_key"), "left").drop("_key")  # a fixed dimension
    venue = F.coalesce("venue_type", F.lit("unknown"))
    reason = F.when(venue == "unknown", "unknown provider source").when(venue != "sportsbook", F.concat(F.lit("venue type "), venue, F.lit(" is prohibited"))).when(~F.col("approved"), "sportsbook is pending provider confirmation and is not approved")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("approved", "broad", "sharp")}
    return joined.withColumns({"source_reason": reason, "venue_type": venue, **flags})


def flatten(events: DataFrame) -> DataFrame:
    """One row a market from nested events (column ``data``, and the wrapper's ``timestamp``), with its outcomes kept nested.

    A market's time falls back to its book's and then the wrapper's.
    """
    e = events.select("timestamp", F.explode_outer("data").alias("e"))
    b = e.select("timestamp", "e", F.explode_outer("e.bookmakers").alias("b"))
    m = b.select("timestamp", "e", "b", F.explode_outer("b.markets").alias("m"))
    observed, starts = utc_timestamp(F.coalesce("m.last_update", "b.last_update", "timestamp")), utc_timestamp(F.col("e.commence_time"))
    market_id = F.coalesce("m.id", F.concat_ws(":", "e.id", "b.key", "m.key"))
    return m.select(F.col("e.id").alias("event_id"), F.col("b.key").alias("provider_key"), market_id.alias("market_id"), F.col("m.key").alias("market_type"), observed.alias("observed"), starts.alias("starts"), F.lower("e.status").alias("event_status"), F.col("m.outcomes").alias("outcomes"), (observed < starts).alias("pre_fight"))


def normalized(markets: DataFrame, books: DataFrame) -> DataFrame:
    """Adds the book's registry entry and status: the first failed check, else normalized (FLT-20). Pending books that an override approves come with ``registry``."""
    joined = resolved(markets, books)
    status = first_reason({
        "rejected_schema": F.col("outcomes").isNull(),
        "rejected_invalid_timestamp": F.col("observed").isNull() | F.col("starts").isNull(),
        "rejected_unsupported_market": F.coalesce(F.col("market_type") != "h2h", F.lit(True)),
        "rejected_cancelled_bout": F.coalesce(F.col("event_status").isin("cancelled", "canceled"), F.lit(False)),
        "rejected_unknown": F.col("venue_type") == "unknown",
        "rejected_prohibited_venue": F.col("venue_type") != "sportsbook",
        "rejected_unapproved_sportsbook": ~F.col("approved"),
        "rejected_live_market": ~F.col("pre_fight"),
        "rejected_incomplete_market": F.size("outcomes") != 2,
        "rejected_invalid_odds": F.exists("outcomes", lambda o: price_error(o["price"]).isNotNull()),
    })
    return joined.withColumn("status", F.coalesce(status, F.lit("normalized"))).withColumn("snapshot_id", prefixed_id("snap_", 32, F.col("event_id"), F.col("market_id"), F.col("provider_key"), F.col("observed")))


def match_bouts(snapshots: DataFrame, bouts: DataFrame) -> DataFrame:
    """Snapshots (snapshot_id, a_id, b_id, day) to bouts of the unordered pair within a day, the same day preferred.

    Each snapshot has three days, so the range join is an equi join. Result: match_status, fight_id, same_side.
    """
    wanted = snapshots.select("snapshot_id", "a_id", "day", pair_key(F.col("a_id"), F.col("b_id")).alias("pair"), F.explode(days_around(F.col("day"))).alias("date"))
    there = bouts.select("fight_id", "date", pair_key(F.col("a_id"), F.col("b_id")).alias("pair"), F.col("a_id").alias("bout_a"))
    met = wanted.join(there, ["date", "pair"]).groupBy("snapshot_id").agg(
        F.count(F.when(F.col("date") == F.col("day"), 1)).alias("exact"), F.count("*").alias("near"), F.min(F.when(F.col("date") == F.col("day"), F.struct("fight_id", (F.col("a_id") == F.col("bout_a")).alias("same")))).alias("on_day"), F.min(F.struct("fight_id", (F.col("a_id") == F.col("bout_a")).alias("same"))).alias("any_day")
    )
    best = F.when(F.col("exact") > 0, F.col("on_day")).otherwise(F.col("any_day"))
    n = F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("near"))
    joined = snapshots.join(met, "snapshot_id", "left")
    status = F.when(F.col("near").isNull(), "unmatched").when(n == 1, "matched").otherwise("ambiguous")
    return joined.select("snapshot_id", status.alias("match_status"), F.when(n == 1, best["fight_id"]).alias("fight_id"), F.when(n == 1, best["same"]).alias("same_side"))


#: Fields that each event of a payload must have. Fixed values.
EVENT_FIELDS = ("id", "sport_key", "commence_time", "home_team", "away_team", "bookmakers")


def payload_errors(payloads: DataFrame, historical: bool = True) -> DataFrame:
    """Adds errors to JSON texts (column ``payload``): a wrong shape, or required fields that an event lacks (ODD-02).

    A field that is there and null is no error. A text that is no JSON is ``invalid_json``.
    """
    events = F.get_json_object("payload", "$.data") if historical else F.col("payload")
    each = F.from_json(events, "array<string>")

    def lacking(event: Column, at: Column) -> Column:
        place = F.concat(F.lit("event["), at.cast("string"), F.lit("]"))
        keys = F.json_object_keys(event)
        return F.when(keys.isNull(), F.array(F.concat(place, F.lit(" is no object")))).otherwise(F.array_compact(F.array(*[F.when(~F.array_contains(keys, f), F.concat(place, F.lit(f" lacks {f}"))) for f in EVENT_FIELDS])))

    listed = F.json_array_length(events).isNotNull()
    shape = F.when(F.try_parse_json("payload").isNull(), "invalid_json").when(~listed, "events are no list")
    head = [F.when(~F.array_contains(F.json_object_keys("payload"), "timestamp"), "no timestamp")] if historical else []
    found = F.when(listed, F.flatten(F.transform(each, lacking)))
    return payloads.withColumn("errors", F.concat(F.array_compact(F.array(shape, *head)), F.coalesce(found, F.array().cast("array<string>"))))


def exclusions(max_age_hours: float | None = None) -> dict[str, Column]:
    """Why a quote (approved, observed, cutoff, starts, price_a, price_b) cannot be used, in order: the part of FLT-19 about times and prices."""
    checks = {"unapproved_sportsbook": ~F.col("approved")} | _times(max_age_hours)
    return checks | {"invalid_odds": price_error(F.col("price_a")).isNotNull() | price_error(F.col("price_b")).isNotNull()}


def _times(max_age_hours: float | None) -> dict[str, Column]:
    checks = {
        "observation_after_prediction_cutoff": F.col("observed") > F.col("cutoff"),
        "observation_at_or_after_scheduled_start": F.col("observed") >= F.col("starts"),
    }
    if max_age_hours is not None:
        age = (F.unix_seconds(F.col("cutoff").cast("timestamp")) - F.unix_seconds(F.col("observed").cast("timestamp"))) / 3600.0
        checks["snapshot_stale"] = age > max_age_hours
    return checks


def source_reason(eligible: tuple[str, ...] | None = None, overrides: tuple[str, ...] = (), max_age_hours: float | None = None) -> Column:
    """The first of the fifteen reasons why a stored snapshot cannot serve a bout's side, else null (FLT-19).

    Columns: venue_type, book (null if unknown), approved, status, match_status, market_type, pre_fight, observed, cutoff, starts, entity and
    opponent (whose probability is sought), and outcomes, an array of (entity, opponent, valid, oriented, price).
    """
    own = lambda e, o: F.filter("outcomes", lambda x: (x["entity"] == F.col(e)) & (x["opponent"] == F.col(o)))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    checks = {
        "venue_type": no(F.col("venue_type") == "sportsbook"),
        "unapproved_or_unknown_sportsbook": F.col("book").isNull(),
        "unapproved_sportsbook": no(F.col("approved")) & ~(F.col("book").isin(*overrides) if overrides else F.lit(False)),
        "not_in_requested_eligible_set": ~F.col("book").isin(*eligible) if eligible is not None else F.lit(False),
        "status": no(F.col("status") == "normalized"),
        "match_status": no(F.col("match_status") == "matched"),
        "unsupported_market": no(F.col("market_type") == "h2h"),
        "live_or_post_start": no(F.col("pre_fight")),
        **_times(max_age_hours),
        "incomplete_or_multiway_market": no(F.size("outcomes") == 2),
        "fighter_orientation_mismatch": (F.size(own("entity", "opponent")) != 1) | (F.size(own("opponent", "entity")) != 1),
        "invalid_outcome": F.exists("outcomes", lambda x: no(x["valid"]) | no(x["oriented"])),
        "invalid_odds": F.exists("outcomes", lambda x: x["price"].isNull()),
    }
    told = {"venue_type": F.concat(F.lit("venue_type_"), F.coalesce("venue_type", F.lit("None")), F.lit("_prohibited")), "status": F.coalesce("status", F.lit("None")), "match_status": F.concat(F.lit("match_status_"), F.coalesce("match_status", F.lit("None")))}
    reason = first_reason(checks)
    out = F.when(reason.isNull(), F.lit(None).cast("string"))
    for name, text in told.items():
        out = out.when(reason == name, text)
    return out.otherwise(reason)


def side_consensus(snapshots: DataFrame, eligible: tuple[str, ...] | None = None, overrides: tuple[str, ...] = (), max_age_hours: float | None = None, sharp: tuple[str, ...] = (), include_sharp: bool = False, least_books: int = 3) -> DataFrame:
    """Consensus for each (fight_id, entity, cutoff) over stored snapshots (columns of ``source_reason``, fight_id, snapshot_id).

    The side's price and its opponent's come from the outcomes; what cannot be used is told by book, unknown books by ``provider_key``.
    """
    price = lambda e: F.get(F.filter("outcomes", lambda x: x["entity"] == F.col(e)), 0)["price"]
    named = snapshots.withColumn("told", source_reason(eligible, overrides, max_age_hours)).withColumns({"price_a": price("entity"), "price_b": price("opponent"), "book": F.coalesce("book", "provider_key", F.lit("unknown")), "event_id": F.struct("fight_id", "entity", "cutoff")})
    out = _consensus(named.withColumnRenamed("told", "reason"), sharp, include_sharp, least_books)
    return out.select("event_id.*", *[c for c in out.columns if c != "event_id"])


def consensus(quotes: DataFrame, sharp: tuple[str, ...] = (), include_sharp: bool = False, max_age_hours: float | None = None, least_books: int = 3) -> DataFrame:
    """As-of consensus per event over the newest usable quote of each book.

    quotes: event_id, book, snapshot_id, observed, cutoff, starts, price_a, price_b, approved. Two aggregations on
    nested keys: newest quote per (event, book) as a partial maximum, then statistics of the fair probabilities. Reasons
    gather over all quotes of a book, also if another of its quotes is used.
    """
    return _consensus(quotes.withColumn("reason", first_reason(exclusions(max_age_hours))), sharp, include_sharp, least_books)


def _consensus(judged: DataFrame, sharp: tuple[str, ...], include_sharp: bool, least_books: int) -> DataFrame:
    fair = fair_share(implied(F.col("price_a")), implied(F.col("price_b")))
    usable = F.when(F.col("reason").isNull(), F.struct("observed", "snapshot_id", fair.alias("fair"), (implied(F.col("price_a")) + implied(F.col("price_b"))).alias("overround")))
    newest = judged.groupBy("event_id", "book").agg(F.max(usable).alias("q"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    is_sharp = F.col("book").isin(*sharp) if sharp else F.lit(False)
    counts = F.col("q").isNotNull() & (F.lit(include_sharp) | ~is_sharp)
    p = F.when(counts, F.col("q.fair"))
    out = newest.groupBy("event_id").agg(
        F.median(p).alias("median_fair"), F.avg(p).alias("mean_fair"), F.min(p).alias("min_fair"), F.max(p).alias("max_fair"), F.stddev_pop(p).alias("sd_fair"), F.count(p).alias("books"),
        F.min(F.when(counts, F.col("q.observed"))).alias("oldest"), F.max(F.when(counts, F.col("q.observed"))).alias("newest"), F.max(F.when(is_sharp, F.col("q.fair"))).alias("sharp_fair"),
        F.array_sort(F.collect_set(F.when(F.size("reasons") > 0, F.concat_ws(":", "book", F.array_join("reasons", "+"))))).alias("excluded"),
    )
    return out.withColumns({"range_fair": F.col("max_fair") - F.col("min_fair"), "coverage_low": F.col("books") < least_books, "sharp_minus_broad": F.col("sharp_fair") - F.col("median_fair")})


def newly(selections: DataFrame, stored: DataFrame, key: str = "selection_id") -> DataFrame:
    """Rows whose key is not stored yet, once each: append them (ODD-08, INC-08)."""
    return selections.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def mark_duplicates(snapshots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Later copies within a payload become rejected_duplicate (IDN-11)."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("snapshot_id"))
    return snapshots.withColumn("status", F.when(nth > 1, "rejected_duplicate").otherwise(F.col("status")))


def orient(snapshots: DataFrame, matched: DataFrame) -> DataFrame:
    """Puts what ``match_bouts`` found on the snapshots: match_status, fight_id and whether A is the bout's A (IDN-10, ODD-06)."""
    return snapshots.drop("match_status", "fight_id", "same_side").join(matched, "snapshot_id", "left").fillna("unmatched", ["match_status"])


def rematch(stored: DataFrame, bouts: DataFrame, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(all snapshots with renewed matches, counts by status) for the stored ones, or those of one batch (ODD-06).

    stored: snapshot_id, a_id, b_id, day, status, batch_id. Rejected snapshots keep their status and match nothing. The result is a new
    version of the table; nothing is changed in place.
    """
    mine = F.lit(True) if batch is None else F.coalesce(F.col("batch_id") == batch, F.lit(False))
    chosen = stored.filter(mine)
    usable = chosen.filter("status = 'normalized'")
    renewed = orient(usable, match_bouts(usable, bouts)).unionByName(chosen.filter("status <> 'normalized' or status is null").drop("match_status", "fight_id", "same_side").withColumns({"match_status": F.col("status"), "fight_id": F.lit(None).cast("long"), "same_side": F.lit(None).cast("boolean")}))
    kept = stored.filter(~mine)
    counts = renewed.agg(F.count("*").alias("examined"), *[F.count_if(F.col("match_status") == s).alias(s) for s in ("matched", "unmatched", "ambiguous")], F.count_if(F.col("match_status").startswith("rejected_")).alias("rejected"))
    return (kept.unionByName(renewed, allowMissingColumns=True) if batch else renewed), counts


def ingest(payload: str, provider: str, spark: SparkSession, root: str, normalize: Callable[[DataFrame], DataFrame], historical: bool = True, dry_run: bool = False) -> dict:
    """Archives a payload by its content, normalizes it and appends its snapshots under a batch number (ODD-05).

    Tables below ``root``: payloads, snapshots and batches, all append-only. A payload that breaks the structure, or on which ``normalize``
    (payload rows to snapshots with snapshot_id and status) fails, leaves a batch marked failed with the message, and the error is
    raised; the archive keeps it. Running a payload again adds no snapshot twice. A dry run writes nothing.
    """
    rows = spark.createDataFrame([(payload,)], "payload string")
    key = rows.select(archive_key(F.col("payload"))).first()[0]
    batch = f"batch_{hashlib.sha256(f'{provider}|{key}'.encode()).hexdigest()[:24]}"
    note = lambda status, error, n: spark.createDataFrame([(batch, provider, key, status, error, n)], "batch_id string, provider string, payload_hash string, response_status string, error_message string, snapshots long")
    if not dry_run:
        append_new(rows.withColumn("payload_hash", F.lit(key)), f"{root}/payloads", ("payload_hash",))
    try:
        if wrong := payload_errors(rows, historical).first()["errors"]:
            raise ValueError("; ".join(wrong))
        snapshots = normalize(rows).withColumn("batch_id", F.lit(batch))
        seen = {r["status"]: r["count"] for r in snapshots.groupBy("status").count().collect()}
    except Exception as e:
        if not dry_run:
            note("failed", str(e), 0).write.mode("append").parquet(f"{root}/batches")
        raise
    total = sum(seen.values())
    inserted = 0
    if not dry_run:
        table = f"{root}/snapshots"
        before = spark.read.parquet(table).count() if there(spark, table) else 0
        inserted = append_new(snapshots, table, ("snapshot_id",)) - before
        note("ok", None, total).write.mode("append").parquet(f"{root}/batches")
    return {"batch_id": None if dry_run else batch, "payload_hash": key, "snapshots_seen": total, "snapshots_inserted": inserted, "by_status": seen, "dry_run": dry_run}


#: The checks of a provider's sample that it must pass. Fixed values.
REQUIRED_CHECKS = (
    "valid_json_structure", "observation_timestamps_present", "scheduled_timestamps_present", "historical_query_timestamp_present", "complete_two_sided_moneyline_present",
    "canonical_identity_sufficient", "classification_supported", "raw_retention_permitted_confirmed", "historical_24h_cutoff_reconstructable",
)


def sample_checks(markets: DataFrame, sport: str, structure_ok: bool = True, query_time: bool = True, retention: bool = False) -> DataFrame:
    """Twelve booleans about a provider's sample and whether it is accepted, one row (ODD-09).

    markets: the columns of ``normalized`` with match_status, sport_key and card_section. A day before the start can be rebuilt if some usable market was
    observed by then.
    """
    good = F.col("status") == "normalized"
    matched = good & (F.col("match_status") == "matched")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    two_way = (F.col("market_type") == "h2h") & (F.size("outcomes") == 2) & ~F.exists("outcomes", lambda o: price_error(o["price"]).isNotNull())
    checks = {
        "valid_json_structure": F.lit(structure_ok),
        "observation_timestamps_present": every(F.col("observed").isNotNull()),
        "scheduled_timestamps_present": every(F.col("starts").isNotNull()),
        "historical_query_timestamp_present": F.lit(query_time),
        "complete_two_sided_moneyline_present": some(two_way),
        "canonical_identity_sufficient": some(matched) & ~some(good & (F.col("match_status") == "ambiguous")),
        "classification_supported": some(matched) & every(~matched | (F.col("sport_key") == sport)),
        "target_sportsbook_keys_identifiable": some(good & F.col("book").isNotNull()),
        "preliminary_bouts_demonstrated": some(F.lower("card_section").isin("prelims", "preliminary", "early_prelims", "early prelims")),
        "replacement_or_cancellation_behavior_demonstrated": some(F.col("event_status").isin("cancelled", "canceled", "postponed")),
        "raw_retention_permitted_confirmed": F.lit(retention),
        "historical_24h_cutoff_reconstructable": some(good & (F.col("observed") <= F.col("starts") - F.expr("interval 24 hours"))),
    }
    row = markets.agg(*[c.alias(n) for n, c in checks.items()])
    return row.withColumn("accepted", reduce(lambda a, b: a & b, [F.col(n) for n in REQUIRED_CHECKS]))


def validate_sample(spark: SparkSession, markets: Callable[[], DataFrame], sport: str, protected: dict[str, str], **flags: bool) -> dict:
    """``sample_checks`` of a provider's sample with proof that nothing protected changed (ODD-09).

    The files below each protected path are digested before the sample is read and after it is judged; a change, also one of a path that was not there, makes
    ``accepted`` false. The report names what failed.
    """
    state = lambda: {name: tree_digest(spark, path) if there(spark, path, "binaryFile") else None for name, path in protected.items()}
    before = state()
    checks = sample_checks(markets(), sport, **flags).first().asDict()
    after = state()
    changed = sorted(n for n in before if before[n] != after[n])
    failed = [n for n in REQUIRED_CHECKS if not checks[n]]
    return checks | {"accepted": checks["accepted"] and not changed, "failed": failed, "protected_unchanged": not changed, "changed": changed, "digests": before}


#: Tables of the store and their keys (ODD-10). Fixed values.
STORE = {"books": ("provider_key",), "payloads": ("payload_hash",), "batches": ("batch_id",), "snapshots": ("snapshot_id",), "mappings": ("provider", "entity_type", "raw")}


def seed(spark: SparkSession, root: str) -> int:
    """Begins a store below ``root``: the registry's rows that it lacks (ODD-10); may be run again. The number of rows there."""
    return append_new(registry(spark), f"{root}/books", STORE["books"])
