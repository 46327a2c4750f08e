"""Guarded apply of one event's bouts to a versioned table of rated bouts (INC-05, SNK-05, SNK-06).

The table's rows are ratings' snapshots, so a bout and its ratings are one commit. An event adds its own rows: ratings begin with the newest stored ones of
its competitors, nothing stored is replayed or written again. A card has a few dozen bouts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestkit.functions.text import name_key, pair_key, url_slug
from contestkit.operators.identity import guarded_resolve
from contestkit.operators.rating import K, SNAPSHOT, START, elo
from contestkit.session import cut
from contestkit.sources.versioned import Manifest, Store

EVENT = "page_type string, title string, date date, event_id string"
BOUTS = "row_index int, fight_key string, a_name string, a_url string, b_name string, b_url string, result string, minutes double, a_won int"


@dataclass
class Plan:
    """What an apply would do: fields that the event lacks, blocks of the event, and bouts with decision and reasons; ``sides`` are the resolved competitors."""

    version: Manifest | None
    missing: list[str]
    blocks: list[str]
    bouts: DataFrame
    sides: DataFrame
    decisions: dict[str, int]

    @property
    def safe(self) -> bool:
        return not self.missing and not self.blocks and not self.decisions.get("blocked", 0)

    @property
    def n_new(self) -> int:
        return sum(n for d, n in self.decisions.items() if d.startswith("append"))


def newest_ratings(stored: DataFrame, entities: DataFrame, before: Column | None = None) -> DataFrame:
    """(entity, rating) after the last stored bout of each of the given entities (a card's), before a day if one is given: one pass with a partial maximum, no replay."""
    rows = stored if before is None else stored.filter(before)
    sides = F.array(*[F.struct(F.col(f"{s}_id").alias("entity"), F.col(f"{s}_post").alias("rating")) for s in "ab"])
    long = rows.select(F.struct("date", "fight_id").alias("at"), F.explode(sides).alias("r")).select("at", "r.*")
    return long.join(F.broadcast(entities.select("entity").distinct()), "entity", "left_semi").groupBy("entity").agg(F.max_by("rating", "at").alias("rating"))  # a card's competitors


def resolve_sides(bouts: DataFrame, entities: DataFrame, highest: int) -> DataFrame:
    """(row_index, side, name_key, slug, action, entity) of both sides: by URL, else by an unambiguous name, else a new number in order of appearance; blocked otherwise."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_name").alias("name"), F.col(f"{s}_url").alias("url"))
    rows = bouts.select("row_index", F.explode(F.array(side("a"), side("b"))).alias("r")).select("row_index", "r.side", name_key(F.col("r.name")).alias("name_key"), url_slug(F.col("r.url")).alias("slug"))
    lacking = F.coalesce(F.length("name_key") == 0, F.lit(True)) | F.coalesce(F.length("slug") == 0, F.lit(True))
    rows = rows.withColumn("lacking", lacking)
    found = guarded_resolve(rows.filter(~lacking).select(F.col("slug").alias("ref"), "slug", "name_key").distinct(), entities).drop("ref")
    # one name of two new addresses, or one address of two names, is not told apart by guessing
    per_name = found.groupBy("name_key").agg(F.countDistinct("slug").alias("slugs_of_name"))
    per_slug = found.groupBy("slug").agg(F.countDistinct("name_key").alias("names_of_slug"))
    joined = rows.join(found, ["slug", "name_key"], "left").join(per_name, "name_key", "left").join(per_slug, "slug", "left")
    clash = (F.col("action") != "existing_by_url") & ((F.col("slugs_of_name") > 1) | (F.col("names_of_slug") > 1))
    action = F.when(F.col("lacking"), "blocked_missing_required_fields").when(clash, "blocked_ambiguous_in_event").otherwise(F.col("action"))
    joined = joined.withColumn("action", action)
    first = joined.filter("action = 'new'").groupBy("slug").agg(F.min(F.struct("row_index", "side")).alias("first"))
    numbers = first.select("slug", (F.row_number().over(Window.orderBy("first")) + F.lit(highest)).alias("number"))  # a card's newcomers
    out = joined.join(numbers, "slug", "left")
    return out.select("row_index", "side", "name_key", "slug", "action", F.coalesce("entity", F.col("number").cast("long")).alias("entity"))


def plan(store: Store, event: DataFrame, bouts: DataFrame, entities: DataFrame, excluded: tuple[str, ...] = ()) -> Plan:
    """Judges an event (``EVENT``, one row) and its bouts (``BOUTS``) against the newest version and the known competitors (entity, slug, name_key).

    The event must have its page's type, title, date and id, and a bout with both sides; it must not lie before the last stored day. A bout is blocked if a side
    has no link or is not told for sure, if it is undecided, its length is unknown, its sides are one, or its key is excluded; a pair that is stored on that day, or twice on
    the card, is already there. On the last stored day bouts are appended with a warning (``append_same_day``).
    """
    version = store.manifest()
    spark = store.spark
    stored = store.read(version.number) if version else spark.createDataFrame([], SNAPSHOT)
    told = event.select(*[c.split()[0] for c in EVENT.split(", ")]).first()
    checks = {"page_type": told and told["page_type"] == "event_detail", "title": told and told["title"], "date": told and told["date"], "event_id": told and told["event_id"]}
    missing = [n for n, ok in checks.items() if not ok]
    bouts = cut(bouts)
    usable = bouts.filter(" and ".join(f"length({s}_{c}) > 0" for s in "ab" for c in ("name", "url")))
    if not usable.take(1):
        missing.append("bouts")
    row = stored.agg(F.max("date").alias("last"), F.max(F.greatest("a_id", "b_id")).alias("highest")).first()
    known = entities.agg(F.max("entity")).first()[0]
    sides = cut(resolve_sides(bouts, entities, max(row["highest"] or 0, known or 0)))
    day = told["date"] if told else None
    blocks = [f"event of {day} lies before the last stored day {row['last']}"] if day and row["last"] and day < row["last"] else []
    wide = bouts
    for s in "ab":
        own = sides.filter(F.col("side") == s).select("row_index", F.col("entity").alias(f"{s}_id"), F.col("action").alias(f"{s}_action"))
        wide = wide.join(own, "row_index")
    pair = pair_key(F.col("a_id"), F.col("b_id"))
    there = stored.filter(F.col("date") == F.lit(day)).select(pair.alias("pair"), F.lit(True).alias("stored")).distinct()  # a day's bouts
    wide = wide.withColumn("pair", pair).join(F.broadcast(there), "pair", "left")
    again = F.row_number().over(Window.partitionBy("pair").orderBy("row_index")) > 1
    reasons = F.array_compact(F.array(
        *[F.when(F.col(f"{s}_action").startswith("blocked"), F.concat(F.lit(f"{s}_"), F.col(f"{s}_action"))) for s in "ab"],
        F.when(~F.coalesce(F.col("result") == "win", F.lit(False)) | F.col("a_won").isNull(), "undecided"), F.when(F.col("minutes").isNull(), "no_length"), F.when(F.col("a_id") == F.col("b_id"), "same_sides"),
        F.when(F.col("fight_key").isin(*excluded), "excluded") if excluded else F.lit(None).cast("string"),
    ))
    same_day = F.lit(bool(day and row["last"] and day == row["last"]))
    decision = F.when(F.size("reasons") > 0, "blocked").when(F.col("stored") | F.col("again"), "already_stored").when(same_day, "append_same_day").otherwise("append")
    judged = cut(wide.withColumns({"reasons": reasons, "again": again}).withColumn("decision", decision).drop("pair", "stored", "again"))
    decisions = {r["decision"]: r["count"] for r in judged.groupBy("decision").count().collect()}
    return Plan(version, missing, blocks, judged, sides, decisions)


def rated(store: Store, ready: Plan, event: DataFrame, k: float = K, start: float = START) -> DataFrame:
    """The new bouts' snapshots: numbers after the highest stored one in the card's order, ratings from the newest stored ones."""
    spark = store.spark
    stored = store.read(ready.version.number) if ready.version else spark.createDataFrame([], SNAPSHOT)
    highest = stored.agg(F.max("fight_id")).first()[0] or 0
    day = event.select("date").first()["date"]
    new = ready.bouts.filter(F.col("decision").startswith("append"))
    numbered = new.select((F.row_number().over(Window.orderBy("row_index")) + F.lit(highest)).cast("long").alias("fight_id"), F.lit(day).alias("date"), "a_id", "b_id", F.col("a_won").cast("int").alias("a_won"))  # a card
    known = newest_ratings(stored, numbered.select(F.explode(F.array("a_id", "b_id")).alias("entity")))
    return elo(numbered, k, start, initial={r["entity"]: r["rating"] for r in known.collect()})  # a card's competitors


def apply_event(store: Store, event: DataFrame, bouts: DataFrame, entities: DataFrame, excluded: tuple[str, ...] = (), dry_run: bool = True, attempts: int = 3, k: float = K, start: float = START) -> dict:
    """Plans, and unless it is a dry run appends the event's bouts with their ratings as one version.

    Nothing is applied if a field is missing or anything is blocked. If another writer commits in between, the event is planned anew on what is there then. The
    report holds the plan, the version and the new competitors (slug, name_key, entity), which the caller may register.
    """
    from contestkit.sources.versioned import Conflict

    for left in range(attempts, 0, -1):
        ready = plan(store, event, bouts, entities, excluded)
        report = {"decisions": ready.decisions, "missing": ready.missing, "blocks": ready.blocks, "safe": ready.safe, "applied": 0, "dry_run": dry_run, "plan": ready}
        if dry_run:
            return report
        if not ready.safe:
            raise ValueError(f"nothing applied: missing {ready.missing}, {ready.blocks or ready.decisions}")
        if not ready.n_new:
            return report
        rows = cut(rated(store, ready, event, k, start))
        folder = store.stage(rows)
        if folder.rows != ready.n_new:
            raise ValueError(f"nothing applied: {folder.rows} rows were stored for {ready.n_new} bouts")
        try:
            done = store.commit(ready.version, (*(ready.version.folders if ready.version else ()), folder), rows.schema, "event")
        except Conflict:
            if left == 1:
                raise
            continue
        newcomers = ready.sides.filter("action = 'new'").select("slug", "name_key", "entity").distinct()
        return report | {"applied": ready.n_new, "version": done.number, "newcomers": newcomers, "ratings": store.read(done.number).join(F.broadcast(rows.select("fight_id")), "fight_id", "left_semi")}  # a card
    raise AssertionError
