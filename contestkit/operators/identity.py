"""Entity resolution (IDN-01 to IDN-12, JOIN-07 to JOIN-10, JOIN-16)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestkit.functions.parse import any_date, height_cm, reach_cm, weight_lbs
from contestkit.functions.text import display_name, division_limit, folded_name, name_key, resolve_alias, url_slug, without_suffix
from contestkit.operators.history import keep_first
from contestkit.sources.tables import append_new

CONTINUITY_DAYS = 540
#: New keys that a task ranks, about.
RANKED_TOGETHER = 10_000
PLAUSIBLE_AGE = (18.0, 45.0)


def load(raw: DataFrame) -> DataFrame:
    """Evidence per source identity; the first row of a slug counts. raw: FIGHTER, HEIGHT, WEIGHT, REACH, DOB, URL, row_id."""
    parsed = raw.select(
        url_slug(F.col("URL")).alias("slug"), display_name(F.col("FIGHTER")).alias("raw_name"), name_key(F.col("FIGHTER")).alias("name_key"), weight_lbs(F.col("WEIGHT")).alias("weight_lbs"),
        any_date(F.col("DOB")).alias("dob"), height_cm(F.col("HEIGHT")).alias("height_cm"), reach_cm(F.col("REACH")).alias("reach_cm"), "row_id",
    )
    return keep_first(parsed.filter("slug is not null"), ("slug",), ("row_id",)).drop("row_id")


def register(identities: DataFrame, entities: DataFrame) -> DataFrame:
    """Links identities (slug, name_key) to entities (entity, name_key, slug or null): status linked, ambiguous, unresolved or unlinked.

    A known slug links first; then a name that one identity and one entity share. Same-name identities are
    ambiguous; several entities of the name leave it unresolved.
    """
    known = entities.filter("slug is not null").groupBy("slug").agg(F.min("entity").alias("by_slug"))
    named = entities.groupBy("name_key").agg(F.count("*").alias("entities"), F.min("entity").alias("by_name"))
    twins = identities.groupBy("name_key").agg(F.count("*").alias("identities"))
    joined = identities.join(known, "slug", "left").join(named, "name_key", "left").join(twins, "name_key")
    status = F.when(F.col("by_slug").isNotNull(), "linked").when(F.col("identities") > 1, "ambiguous").when(F.col("entities") == 1, "linked").when(F.col("entities") > 1, "unresolved").otherwise("unlinked")
    entity = F.when(F.col("by_slug").isNotNull(), F.col("by_slug")).when(status == "linked", F.col("by_name"))
    return joined.select("slug", "name_key", status.alias("status"), entity.alias("entity"))


def unclaimed(entities: DataFrame, identities: DataFrame) -> DataFrame:
    """Entities that no identity owns (JOIN-07)."""
    return entities.join(identities.filter("entity is not null").select("entity"), "entity", "left_anti")


def assign(bouts: DataFrame, identities: DataFrame) -> DataFrame:
    """(ref, slug or null, rule) of bout sides (ref, name_key, date, weight_class).

    Names with one identity are joined. For names that several share, evidence is taken in turn: a unique division
    weight; career continuity within 540 days of an assigned bout, until nothing changes; a unique plausible
    age. Otherwise nothing is guessed. Candidates are counted by name and weight and by name and day before they meet the bouts, so no bout is
    paired with each of its candidates; only the continuity of one shared name, in the order of refs, is followed row by row.
    """
    twins = identities.groupBy("name_key").agg(F.count("*").alias("n"), F.min("slug").alias("only"))
    marked = bouts.join(twins, "name_key", "left")
    single = marked.filter("n is null or n = 1").select("ref", F.col("only").alias("slug"), F.when(F.col("n") == 1, "unique_name").otherwise("unknown_name").alias("rule"))
    many = marked.filter("n > 1").select("ref", "name_key", "date", division_limit(F.col("weight_class")).alias("lbs"))
    candidates = identities.join(twins.filter("n > 1").select("name_key"), "name_key").select("name_key", "slug", "weight_lbs", "dob")
    of_weight = candidates.groupBy("name_key", F.col("weight_lbs").alias("lbs")).agg(F.when(F.count("*") == 1, F.min("slug")).alias("by_weight"))
    judged = many.join(of_weight, ["name_key", "lbs"], "left").join(of_age(many, candidates), ["name_key", "date"], "left")
    begun = judged.filter("by_weight is not null").select("name_key").distinct()  # without an assigned bout nothing carries over
    followed = judged.filter("date is not null").join(begun, "name_key", "left_semi").select("ref", "name_key", "date", "by_weight")
    chained = with_spells(followed).groupBy("name_key", "spell").applyInPandas(_by_continuity, "ref long, by_chain string")
    first = F.coalesce("by_weight", "by_chain", "by_age")
    rule = F.when(F.col("by_weight").isNotNull(), "division_weight").when(F.col("by_chain").isNotNull(), "continuity").when(F.col("by_age").isNotNull(), "age").otherwise("unresolved")
    return single.unionByName(judged.join(chained, "ref", "left").select("ref", first.alias("slug"), rule.alias("rule")))


def of_age(bouts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name_key, date, by_age) of each name and day of the bouts: the only candidate of a plausible age then.

    Ages are a range of birthdays: candidates born up to its ends are counted in one window a name, over days and not over bouts or pairs.
    """
    youngest, oldest = math.ceil(PLAUSIBLE_AGE[0] * 365.25), math.floor(PLAUSIBLE_AGE[1] * 365.25)  # days, as ``signed_age`` counts
    born = candidates.filter("dob is not null").groupBy("name_key", F.col("dob").alias("day")).agg(F.count("*").alias("n"), F.min("slug").alias("slug"))
    end = lambda last, days: F.struct(F.lit(last).alias("last"), F.date_sub("date", days).alias("day"))
    ends = bouts.filter("date is not null").select("name_key", "date").distinct().select("name_key", "date", F.explode(F.array(end(True, youngest), end(False, oldest + 1))).alias("e"))
    by_day = Window.partitionBy("name_key").orderBy("day")
    both = born.unionByName(ends.select("name_key", "date", "e.*"), allowMissingColumns=True)
    seen = both.withColumns({"up_to": F.coalesce(F.sum("n").over(by_day), F.lit(0)), "newest": F.last("slug", ignorenulls=True).over(by_day)}).filter("date is not null")
    inside = F.sum(F.when(F.col("last"), F.col("up_to")).otherwise(-F.col("up_to")))
    return seen.groupBy("name_key", "date").agg(F.when(inside == 1, F.max(F.when(F.col("last"), F.col("newest")))).alias("by_age"))


def with_spells(bouts: DataFrame) -> DataFrame:
    """Adds spell: the bouts of a name between gaps longer than ``CONTINUITY_DAYS``, across which nothing carries over. Undated bouts are a spell of their own."""
    by_day = Window.partitionBy("name_key").orderBy("date", "ref")
    begins = F.coalesce((F.datediff("date", F.lag("date").over(by_day)) > CONTINUITY_DAYS).cast("int"), F.when(F.col("date").isNull(), 0).otherwise(F.when(F.lag("date").over(by_day).isNull(), 1).otherwise(0)))
    return bouts.withColumn("begins", begins).withColumn("spell", F.sum("begins").over(by_day)).drop("begins")


class _Open:
    """Open bouts in order of days. Each sight of an identity passes over the bouts that have it already, and those that are done with, in near-constant time."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.after = list(range(n + 1))  # next bout that is not done with
        self.unmarked: dict[int, dict[int, int]] = {}  # by identity: next bout without it

    def _follow(self, links: list[int] | dict[int, int], k: int) -> int:
        at = k
        while (to := links[at] if isinstance(links, list) else links.get(at, at)) != at:
            at = to
        while k != at:
            following = links[k] if isinstance(links, list) else links.get(k, k)
            links[k], k = at, following
        return at

    def close(self, k: int) -> None:
        self.after[k] = k + 1

    def mark(self, bit: int, k: int) -> None:
        self.unmarked[bit][k] = k + 1

    def next(self, bit: int, k: int) -> int:
        """The first open bout from k on that lacks the identity; n if there is none."""
        links = self.unmarked.setdefault(bit, {})
        while True:
            k = self._follow(links, k)
            open_ = self._follow(self.after, min(k, self.n))
            if open_ <= k:
                return k
            links[k] = open_
            k = open_


def _by_continuity(name: pd.DataFrame) -> pd.DataFrame:
    """(ref, by_chain) of bouts of one shared name (ref, date, by_weight): the only identity with a bout near enough.

    An assigned bout brings its identity to the open ones within reach, in the order of refs; those that were passed already wait for the next round. A bout
    counts the identities that reached it: with two it can never be told any more, and is closed. So each bout is touched three times at most, and the rest is
    near-linear.
    """
    name = name.sort_values("ref", ignore_index=True)
    by_day = name["date"].dropna().sort_values(kind="stable")
    days, refs = by_day.to_numpy().astype("datetime64[D]"), by_day.index.to_numpy()
    slugs = {s: k for k, s in enumerate(sorted(name["by_weight"].dropna().unique()))}
    ordered = list(slugs)
    given = name["by_weight"].notna().to_numpy()
    reached: list[int | None] = [None] * len(name)
    chosen: list[str | None] = [None] * len(name)
    place = {int(k): at for at, k in enumerate(refs)}
    low, high = (np.searchsorted(days, days + shift, side) for shift, side in ((-CONTINUITY_DAYS, "left"), (CONTINUITY_DAYS, "right")))
    bouts = _Open(len(refs))
    for at, k in enumerate(refs.tolist()):
        if given[k]:
            bouts.close(at)
    now: list[int] = []
    later: list[int] = []

    def spread(at: int, slug: int, passed: int) -> None:
        other = bouts.next(slug, int(low[at]))
        while other < high[at]:
            k = int(refs[other])
            bouts.mark(slug, other)
            if reached[k] is None:
                reached[k] = slug
                heapq.heappush(now if k > passed else later, k)
            else:
                reached[k] = -1
                bouts.close(other)
            other = bouts.next(slug, other)

    for k in np.flatnonzero(given).tolist():
        if k in place:
            spread(place[k], slugs[name.at[k, "by_weight"]], -1)
    while now or later:
        if not now:
            now, later = later, now
        k = heapq.heappop(now)
        if reached[k] is not None and reached[k] >= 0:
            chosen[k] = ordered[reached[k]]
            bouts.close(place[k])
            spread(place[k], reached[k], k)
    return pd.DataFrame({"ref": name["ref"], "by_chain": chosen})


def numbered(sides: DataFrame, known: DataFrame) -> DataFrame:
    """Entity numbers by first appearance (IDN-05). sides: (ref, side, key); known: (key, entity) keep their number.

    Keys are ranked by their first (ref, side), a before b. Ranges of refs are counted and summed up first, so that
    each range is ranked on its own.
    """
    first = sides.groupBy("key").agg(F.min(F.struct("ref", "side")).alias("first")).join(known, "key", "left")
    new = first.filter("entity is null")
    low, high, n = new.agg(F.min("first.ref"), F.max("first.ref"), F.count("*")).first()
    if not n:
        return first.select("key", "entity")
    width = max(1, (high - low + 1) // max(1, n // RANKED_TOGETHER))
    placed = new.withColumn("part", F.expr(f"(first.ref - {low}) div {width}"))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    highest = known.agg(F.coalesce(F.max("entity"), F.lit(0)).alias("highest"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    ranked = placed.withColumn("nth", nth).join(before, "part").crossJoin(F.broadcast(highest))  # one row
    return first.filter("entity is not null").select("key", "entity").unionByName(ranked.select("key", (F.col("highest") + F.col("before") + F.col("nth")).alias("entity")))


def lookup(rows: DataFrame, entities: DataFrame, key: str = "name_key") -> DataFrame:
    """Adds status (unmatched, matched, ambiguous) and entity by exact key (JOIN-10, IDN-12)."""
    grouped = entities.groupBy(F.col(key).alias("of")).agg(F.count("*").alias("found"), F.min("entity").alias("entity"))
    joined = rows.join(grouped, F.col(key) == F.col("of"), "left").drop("of")
    status = F.when(F.coalesce("found", F.lit(0)) == 0, "unmatched").when(F.col("found") == 1, "matched").otherwise("ambiguous")
    return joined.withColumn("match_status", status).withColumn("entity", F.when(F.col("found") == 1, F.col("entity"))).drop("found")


def provider_match(names: DataFrame, entities: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Provider names (provider, name) to entities (entity, name): reviewed mapping, else alias or exact name, else a unique name without suffix.

    Three equi joins in order of priority; names are folded keys.
    """
    keyed = names.withColumn("key", resolve_alias(F.col("name"))).withColumn("short", without_suffix(resolve_alias(F.col("name"))))
    mapped = reviewed.groupBy("provider", "name").agg(F.max("entity").alias("reviewed"))
    group = lambda c, n: entities.groupBy(c.alias(n)).agg(F.count("*").alias(f"{n}_n"), F.min("entity").alias(f"{n}_entity"))
    joined = keyed.join(mapped, ["provider", "name"], "left").join(group(F.col("name"), "key"), "key", "left").join(group(without_suffix(F.col("name")), "short"), "short", "left")
    rule = F.when(F.col("reviewed").isNotNull(), "reviewed").when(F.col("key_n") == 1, "exact").when(F.col("key_n") > 1, "ambiguous").when(F.col("short_n") == 1, "suffixless").when(F.col("short_n") > 1, "ambiguous").otherwise("unmatched")
    entity = F.when(rule == "reviewed", F.col("reviewed")).when(rule == "exact", F.col("key_entity")).when(rule == "suffixless", F.col("short_entity"))
    return joined.select("provider", "name", rule.alias("rule"), entity.alias("entity"))


def guarded_resolve(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(ref, slug, name_key) against (entity, slug, name_key): existing, new or blocked (IDN-07)."""
    by_slug = entities.filter("slug is not null").groupBy(F.col("slug").alias("s")).agg(F.count("*").alias("slugs"), F.min("entity").alias("of_slug"))
    by_name = entities.groupBy(F.col("name_key").alias("k")).agg(F.count("*").alias("names"), F.min("entity").alias("of_name"))
    joined = rows.join(by_slug, F.col("slug") == F.col("s"), "left").join(by_name, F.col("name_key") == F.col("k"), "left")
    action = F.when(F.col("slugs") == 1, "existing_by_url").when(F.col("slugs") > 1, "blocked_ambiguous_url").when(F.col("names") > 1, "blocked_ambiguous_name").when(F.col("names") == 1, "existing_by_name").otherwise("new")
    return joined.select("ref", "slug", "name_key", action.alias("action"), F.when(action == "existing_by_url", F.col("of_slug")).when(action == "existing_by_name", F.col("of_name")).alias("entity"))


def fill_details(entities: DataFrame, details: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Fill-only join by slug, then by an unambiguous name (SRC-10, JOIN-09). A present value never changes."""
    one = details.groupBy("slug").agg(*[F.min(c).alias(f"s_{c}") for c in columns])
    named = details.groupBy("name_key").agg(F.count("*").alias("n"), *[F.min(c).alias(f"n_{c}") for c in columns]).filter("n = 1")
    owners = entities.groupBy("name_key").agg(F.count("*").alias("owners"))
    joined = entities.join(one, "slug", "left").join(named, "name_key", "left").join(owners, "name_key", "left")
    by_name = lambda c: F.when(F.col("owners") == 1, F.col(f"n_{c}"))
    return joined.withColumns({c: F.coalesce(c, f"s_{c}", by_name(c)) for c in columns}).select(*entities.columns)


def report(assigned: DataFrame) -> DataFrame:
    """Sides and identities by rule (IDN-06)."""
    return assigned.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("slug").alias("slugs"))


def split_report(bouts: DataFrame, assigned: DataFrame, identities: DataFrame) -> DataFrame:
    """Each shared name: its identities, bouts of each, and those that nothing settles (IDN-06). bouts: ref, name_key; assigned: ``assign``'s."""
    shared = identities.groupBy("name_key").agg(F.countDistinct("slug").alias("identities")).filter("identities > 1")
    named = bouts.select("ref", "name_key").join(assigned, "ref").join(shared, "name_key")
    per = named.groupBy("name_key", "identities", "slug").agg(F.count("*").alias("bouts"))
    each = F.array_sort(F.collect_list(F.when(F.col("slug").isNotNull(), F.struct("slug", "bouts"))))  # the namesakes of one name
    return per.groupBy("name_key", "identities").agg(F.sum("bouts").alias("bouts"), F.coalesce(F.sum(F.when(F.col("slug").isNull(), F.col("bouts"))), F.lit(0)).alias("unresolved"), each.alias("by_slug"))


#: What a reviewed mapping may be about. Fixed values.
MAPPED = ("fighter", "bout")


def import_mappings(new: DataFrame, known: DataFrame, path: str) -> int:
    """Appends reviewed mappings (provider, entity_type, raw, entity, created_by) to the table there (IDN-08); a pair that is mapped stays as it is.

    known: (entity_type, entity) of what exists. A mapping to anything else, or of another type, is an error and nothing is written.
    """
    keyed = new.withColumn("raw", folded_name(F.col("raw"))).withColumn("method", F.lit("reviewed"))
    if kinds := [r[0] for r in keyed.filter(~F.col("entity_type").isin(*MAPPED)).select("entity_type").distinct().take(3)]:
        raise ValueError(f"unknown entity types {kinds}")
    if missing := [tuple(r) for r in keyed.join(known, ["entity_type", "entity"], "left_anti").select("entity_type", "entity").take(3)]:
        raise ValueError(f"unknown entities {missing}")
    return append_new(keyed, path, ("provider", "entity_type", "raw"))
