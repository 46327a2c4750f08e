"""Queries for sources, functions, guards, identities, cards, quotes and preprocessing, each beside the SQL that must give the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestkit.functions import numeric as N
from contestkit.functions import parse as P
from contestkit.functions import text as T
from contestkit.operators import filters, history, identity, ledger, matchup, metrics, models, quotes, rating
from contestkit.plans import bindings as B
from contestkit.plans.queries import APPS, ELO_SQL, LAYOFF_LONG, RATES_LONG, RECORD_LONG, query, sides
from contestkit.session import table
from contestkit.sources import tables


def pick(values: tuple[str | None, ...], at: Column) -> Column:
    """The value at a column's remainder."""
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


def picked(values: tuple[str | None, ...], at: str) -> str:
    shown = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[cast(({at}) % {len(values)} as int) + 1]"


LABELS = ("League Women's Flyweight Title Bout", "Light Heavyweight", "Catchweight Bout", "Superfight", "Women's Strawweight", "super heavyweight bout", "Open Weight", None, "Heavyweight Bout", "Welterweight")
_CLASS = "case " + " ".join(f"when lower(label) like '%{n.lower()}%' then {{w}}'{'Catch Weight' if n == 'Catchweight' else n}'" for n in T.WEIGHT_CLASSES) + " end"


@query(
    f"""with l as (select p_partkey, {picked(LABELS, 'p_partkey')} as label from part), c as (select *, {_CLASS.format(w="case when lower(label) like '%women%' then 'Women''s ' else '' end || ")} as weight_class from l)
select p_partkey, weight_class, case regexp_replace(lower(weight_class), '^women''s ', '') {" ".join(f"when '{k}' then {v}::double" for k, v in T.DIVISION_LIMITS.items())} end as lbs, trim(regexp_replace(lower(weight_class), '[^a-z0-9]+', '_', 'g'), '_') as column_name from c"""
)
def weight_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11 to STR-13: class of a bout's text, its limit and its column's name."""
    label = pick(LABELS, F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", T.weight_class(label).alias("weight_class"))
    return rows.select("p_partkey", "weight_class", T.division_limit(F.col("weight_class")).alias("lbs"), T.division_column(F.col("weight_class")).alias("column_name"))


METHODS = ("U-DEC", "S-DEC ", "M-DEC", "SUB", "KO/TKO", "DQ", " Overturned")


@query(
    f"""with l as (select s_suppkey as k, s_name, {picked(METHODS, 's_suppkey')} as m, date '2020-01-01' + cast(s_suppkey as int) as d from supplier),
b as (select *, s_name || case when k % 3 = 0 then ' vs. ' when k % 3 = 1 then ' VS ' else ' and ' end || 'B ' || k as bout, 'Night ' || k || ': ' || s_name as event, 'a' || k || ' | | b |' as cell from l)
select k, case trim(m) {" ".join(f"when '{a}' then '{b}'" for a, b in T.METHODS.items())} else trim(m) end as method, ['a' || k, 'b'] as cells, case when k % 3 < 2 then s_name end as side_a, case when k % 3 < 2 then 'B ' || k end as side_b,
 'night-' || k || '-supplier-' || substr(s_name, 10) || '-' || d || '-' || substr(sha256(d || '|' || 'night ' || k || ' supplier ' || substr(s_name, 10)), 1, 8) as slug, lower(trim(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))) as event_key from b"""
)
def labels_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14 to STR-17, STR-06: methods, cells, the sides of a bout and an event's slug."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    between = F.when(k % 3 == 0, " vs. ").when(k % 3 == 1, " VS ").otherwise(" and ")
    sides_ = T.bout_sides(F.concat(name, between, F.lit("B "), k))
    day = F.date_add(F.lit(date(2020, 1, 1)), k.cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("k"), T.method_name(pick(METHODS, k)).alias("method"), T.cells(F.concat(F.lit("a"), k, F.lit(" | | b |"))).alias("cells"), sides_[0].alias("side_a"), sides_[1].alias("side_b"),
        T.event_slug(F.concat(F.lit("Night "), k, F.lit(": "), name), day).alias("slug"), T.event_key(name).alias("event_key"),
    )


@query(
    """with l as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as d, l_quantity, l_discount, l_tax, l_extendedprice from lineitem)
select l_orderkey, l_linenumber, 1 / (1 + power(10.0::double, (l_quantity * 20 - 1000 * l_discount) / 400)) as expected, case when l_discount > 0 then l_tax / l_discount end as ratio, ln(1 + l_quantity) as log_days,
 greatest(1e-6, least(1 - 1e-6, 0.3 * l_discount + 0.7 * l_tax * 20)) as blended, date_diff('day', date '1970-06-01', d) / 365.25 as signed_age, cast(date_diff('day', date '1998-01-01', d) as int) as days_since, strftime(d, '%Y-%m') as month, strftime(d, '%Y') as year,
 strftime(d, '%Y-%m-%dT00:00:00Z') as utc, greatest(l_linenumber - 1, 0) * 5.0 + 75 / 60.0 as minutes from l"""
)
def numbers_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-01, NUM-02, NUM-06, NUM-11, DAT-02 to DAT-04, DAT-07, PRS-05."""
    c, d = F.col, F.col("l_shipdate").cast("date")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", N.expected_score(1000 * c("l_discount"), c("l_quantity") * 20).alias("expected"), N.ratio(c("l_tax"), c("l_discount")).alias("ratio"), N.log_days(c("l_quantity")).alias("log_days"),
        N.blend(0.3, c("l_discount"), c("l_tax") * 20).alias("blended"), P.signed_age(F.lit(date(1970, 6, 1)), d).alias("signed_age"), P.days_since(d, F.lit(date(1998, 1, 1))).alias("days_since"), P.month_of(d).alias("month"), P.year_of(d).alias("year"),
        P.utc_text(P.utc_timestamp(stamp)).alias("utc"), P.fight_minutes_of_fives(c("l_linenumber"), F.lit("1:15")).alias("minutes"),
    )


@query(
    "with e as (select event_type, count(*) as n from events group by 1) select 'features-' || count(*) || 'f-' || substr(sha1(string_agg(event_type, '|' order by event_type)), 1, 8) as version, '{' || string_agg('\"' || event_type || '\":' || n, ',' order by event_type) || '}' as as_json from e"
)
def schema_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-02, JSN-01: the version of a list of features, and canonical JSON, of an event type's counts."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    one = counts.agg(F.collect_list(F.struct("event_type", F.col("n").cast("string").alias("n"))).alias("c"))  # a dimension
    names = F.array_sort(F.transform("c", lambda x: x["event_type"]))
    payload = F.concat(F.lit("{"), F.array_join(F.transform("c", lambda x: F.concat(F.lit('"'), x["event_type"], F.lit('": '), x["n"])), ", "), F.lit("}"))
    return one.select(T.schema_version_of(names, "features").alias("version"), T.canonical_payload(payload).alias("as_json"))


CARD_SQL = """card as (select event_id as row_index, case when event_id % 19 = 0 then 'soon' else strftime(ts, '%Y-%m-%d') end as event_date, case when event_id % 23 = 0 then ' ' else 'User ' || (user_id % 25) end as fa, case when event_id % 29 = 0 then '' else 'USER  ' || (event_id % 25) end as fb from events),
keyed as (select *, trim(lower(fa)) as a, trim(regexp_replace(lower(fb), '\\s+', ' ', 'g')) as b from card),
own as (select *, [event_date = 'soon', a = '', b = '', a = b and a <> ''] as bad from keyed),
marked as (select *, case when {fit} then event_date || '|' || least(a, b) || '|' || greatest(a, b) end as bout from own),
firsts as (select bout, min(row_index) as first_row from marked where bout is not null group by 1)"""
REASONS_SQL = """select row_index, array_to_string(list_filter([case when bad[1] then 'bad_date' end, case when bad[2] then 'empty_a' end, case when bad[3] then 'empty_b' end, case when bad[4] then 'same_name' end, case when first_row < row_index then 'duplicate' end], lambda x: x is not null), ',') as reasons, first_row from marked left join firsts using (bout)"""


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("row_index"), F.when(i % 19 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("event_date"), F.when(i % 23 == 0, " ").otherwise(F.concat(F.lit("User "), F.col("user_id") % 25)).alias("fighter_a"), F.when(i % 29 == 0, "").otherwise(F.concat(F.lit("USER  "), i % 25)).alias("fighter_b")
    )


@query(f"with {CARD_SQL.format(fit='not bad[2] and not bad[3]')} {REASONS_SQL}")
def input_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10: all reasons against each row of a prediction input."""
    return filters.judge_input(_card(spark, sf_dir), strict=False).select("row_index", F.array_join("reasons", ",").alias("reasons"), "first_row")


@query(f"with {CARD_SQL.format(fit='not bad[1] and not bad[2] and not bad[3] and not bad[4]')} {REASONS_SQL}")
def matchup_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: all reasons against each bout of a card, by folded names."""
    return filters.judge_input(_card(spark, sf_dir), T.folded_name).select("row_index", F.array_join("reasons", ",").alias("reasons"), "first_row")


@query(
    """with r as (select l_orderkey, l_linenumber, case when l_linenumber = 3 then null when l_linenumber = 4 then 'nan'::double else l_discount * 10 end as p, case when l_returnflag = 'A' then 1 - l_discount * 10 else l_tax end as q, case when l_linestatus = 'F' then l_quantity > 25 end as wa from lineitem)
select l_orderkey, l_linenumber, case when p is null or isnan(p) or p < 0 or p > 1 or q < 0 or q > 1 then 'not_a_probability' when abs(p + q - 1) > 1e-6 then 'not_complementary' when wa <> (p >= q) then 'winner_differs' end as error from r"""
)
def probability_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14: what is wrong with stored probabilities and their winner."""
    c = F.col
    p = F.when(c("l_linenumber") == 4, F.lit(float("nan"))).when(c("l_linenumber") != 3, c("l_discount") * 10)
    q = F.when(c("l_returnflag") == "A", 1 - c("l_discount") * 10).otherwise(c("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", filters.valid_probabilities(p, q, F.when(c("l_linestatus") == "F", c("l_quantity") > 25)).alias("error"))


STATUSES = ("Completed", " cancelled ", "SCHEDULED", None, "draw", "Postponed", "pending")


@query(
    f"""with o as (select o_orderkey as k, {picked(STATUSES, 'o_orderkey')} as s, o_totalprice from orders) select k, coalesce(lower(trim(s)), 'completed') not in ('cancelled', 'canceled', 'scheduled', 'upcoming', 'postponed', 'synthetic', 'incomplete', 'pending') as completed,
 coalesce(s = 'pending', false) and k % 3 = 0 and k % 4 <> 0 and k % 5 <> 0 as shown from o"""
)
def row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, FLT-13: bouts that took place, and ledger rows that may be shown."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), pick(STATUSES, k).alias("status"), F.when(k % 4 == 0, "1").otherwise("nan").alias("target_a_win"), F.lit(" ").alias("winner"), F.lit(None).cast("string").alias("resolved_timestamp_utc"), F.lit("live_forward").alias("prediction_mode"),
        F.when(k % 3 == 0, "Official-Frozen-1").otherwise("trial").alias("prediction_batch_id"), F.when(k % 5 != 0, "m").alias("model_version"), F.lit("f").alias("feature_schema_version"),
    )
    shown = filters.pending(rows).select("k", F.lit(True).alias("shown"))
    return rows.select("k", filters.completed(F.col("status")).alias("completed")).join(shown, "k", "left").fillna(False, ["shown"])


@query(
    """with e as (select *, case when event_type = 'error' then null else value end as v, case when event_id % 50 = 0 then 'inf'::double else value end as w, cast(value > 50 as int) as y from events)
select 'v' as feature, count(*) as n, avg(y) as target_mean, avg(cast(v is null as int)) as missing_rate, count(case when isinf(v) then 1 end) as infinite from e union all select 'w', count(*), avg(y), avg(cast(w is null as int)), count(case when isinf(w) then 1 end) from e"""
)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: missing and infinite values and the target's mean."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("v"), F.when(F.col("event_id") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("w"), (F.col("value") > 50).cast("int").alias("y"))
    return filters.quality_report(e, ("v", "w"), "y").select("feature", "n", "target_mean", "missing_rate", "infinite")


@query(
    """with r as (select cast(ts as date) as date, event_type as event, user_id as fight_id from events), c as (select date, event, count(*) as found, count(*) - count(distinct fight_id) as repeated_ids from r group by all), x as (select cast(ts as date) as date, case when user_id % 40 = 0 then 'gone' else event_type end as event, count(*) as n from events group by all)
select x.date, x.event, x.n, coalesce(found, 0) as found, coalesce(repeated_ids, 0) as repeated_ids, coalesce(found, 0) = x.n and coalesce(repeated_ids, 0) = 0 as ok from x left join c using (date, event)"""
)
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, AGG-18: stated counts of events against those found; repeated ids are told apart."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("event"), F.col("user_id").alias("fight_id"))
    stated = e.withColumn("event", F.when(F.col("fight_id") % 40 == 0, "gone").otherwise(F.col("event"))).groupBy("date", "event").agg(F.count("*").alias("n"))
    return filters.expected_events(e, stated).select("date", "event", "n", "found", "repeated_ids", "ok")


@query(
    """with p as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 170.0 + o_orderkey % 20 end as height, case when o_orderkey % 4 = 0 then 'x' else '' || (160 + o_orderkey % 30) end as static_height, case when o_orderkey % 5 = 0 then 30.5 end as age, case when o_orderkey % 7 > 0 then date '1985-03-01' end as born, cast(o_orderdate as date) as d from orders)
select k, coalesce(height, try_cast(static_height as double)) as height, coalesce(age, round(date_diff('day', born, d) / 365.25, 2)) as age from p"""
)
def physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03, PRJ-04: a bout's own value, else the competitor's; the bout's age, else by date of birth."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 3 == 0, 170.0 + k % 20).alias("height"), F.when(k % 4 == 0, "x").otherwise((160 + k % 30).cast("string")).alias("static_height"), F.when(k % 5 == 0, 30.5).alias("age"), F.when(k % 7 > 0, F.lit(date(1985, 3, 1))).alias("born"), F.col("o_orderdate").cast("date").alias("d")
    )
    return matchup.coalesce_physical(rows, ("height",)).select("k", "height", matchup.age_or_born(F.col("age"), F.col("born"), F.col("d")).alias("age"))


# --- sources -------------------------------------------------------------------------------------------------------


@query(
    """select event_id as source_row_id, strftime(ts, '%Y-%m-%d') as date, 'User ' || user_id as fighter_a, 'Other ' || (event_id % 40) as fighter_b, case when event_type = 'view' then 'User ' || user_id when event_type = 'click' then 'Other ' || (event_id % 40) when event_type = 'error' then '' else event_type end as winner,
 case when event_id % 9 > 0 then value end as age_a from events"""
)
def corner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02 to SRC-04, SRC-06: columns found by their spellings, corners resolved to names."""
    e = table(spark, sf_dir, "events")
    winner = F.when(F.col("event_type") == "view", " RED").when(F.col("event_type") == "click", "blue").when(F.col("event_type") != "error", F.col("event_type"))
    raw = e.select(
        F.col("event_id").alias("source_row_id"), F.date_format("ts", "yyyy-MM-dd").alias("Event_Date"), F.concat(F.lit(" User  "), "user_id").alias("Red Fighter"), F.concat(F.lit("Other "), F.col("event_id") % 40).alias("b_fighter"), winner.alias("Winner"), F.when(F.col("event_id") % 9 > 0, F.col("value").cast("string")).otherwise("-").alias("RedAge")
    )
    return tables.adapter("converted")(raw).select("source_row_id", "date", "fighter_a", "fighter_b", "winner", "age_a")


@query("select event_id as source_row_id, case when event_id % 2 = 0 then 'User ' || user_id else 'Other ' || (event_id % 40) end as fighter_a, case when event_id % 2 = 0 then 'Other ' || (event_id % 40) else 'User ' || user_id end as fighter_b, 'User ' || user_id as winner from events")
def winner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: the winner is side A on even rows."""
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_row_id"), F.col("ts").cast("string").alias("date"), F.concat(F.lit("User "), "user_id").alias("Winner_Fighter"), F.concat(F.lit("Other "), F.col("event_id") % 40).alias("loser fighter"))
    return tables.winners(raw).select("source_row_id", "fighter_a", "fighter_b", "winner")


OUTCOMES = ("W/L", "L/W", "NC/NC", "D/D")


@query(
    f"""select cast(o_orderdate as date) as date, 'E' || o_orderkey as event, 'P' || l_partkey as red_fighter, 'S' || l_suppkey as blue_fighter, case {picked(OUTCOMES, 'l_linenumber')} when 'W/L' then 'Red' when 'L/W' then 'Blue' else '' end as winner, '' || l_linenumber as round from lineitem join orders on o_orderkey = l_orderkey where l_linenumber <> 5"""
)
def converted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: scraped results with their event's day; texts without two sides are left out."""
    c = F.col
    events = table(spark, sf_dir, "orders").select(F.concat(F.lit("E"), "o_orderkey", F.lit(" ")).alias("EVENT"), F.date_format("o_orderdate", "MMMM dd, yyyy").alias("DATE"))
    bout = F.concat(F.lit("P"), "l_partkey", F.when(c("l_linenumber") == 5, " and ").otherwise(" vs. "), F.lit("S"), "l_suppkey")
    results = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("E"), "l_orderkey").alias("EVENT"), bout.alias("BOUT"), pick(OUTCOMES, c("l_linenumber")).alias("OUTCOME"), F.lit("Flyweight").alias("WEIGHTCLASS"), F.lit("SUB").alias("METHOD"), c("l_linenumber").cast("string").alias("ROUND"))
    return tables.convert_results(results, events).select("date", "event", "red_fighter", "blue_fighter", "winner", "round")


SCRAPED_SQL = """rounds as (select l_orderkey as k, l_linenumber % 2 as s, sum(l_linenumber % 2) as kd, sum(cast(l_quantity as int)) as landed, sum(cast(l_quantity as int) + 5) as tried, sum(l_suppkey % 4) as td, sum(60 + l_linenumber) as ctrl from lineitem group by 1, 2),
wide as (select r.k, cast(o_orderdate as date) as date, 'R' || r.k as red_fighter, 'B' || r.k as blue_fighter, 5.0 * (r.k % 3) + 90 / 60.0 as minutes, r.kd as red_kd, r.landed as red_landed, r.tried as red_tried, b.landed as blue_landed, b.td as blue_td, b.ctrl as blue_ctrl from rounds r join rounds b on b.k = r.k and b.s = 0 join orders on o_orderkey = r.k where r.s = 1)"""


def _wide_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col, table(spark, sf_dir, "orders")
    events = o.select(F.concat(F.lit("E"), "o_orderkey").alias("EVENT"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATE"))
    bout = lambda k: F.concat(F.lit("R"), k, F.lit(" vs. B"), k)
    results = o.select(F.concat(F.lit("E"), "o_orderkey").alias("EVENT"), bout(c("o_orderkey")).alias("BOUT"), (c("o_orderkey") % 3 + 1).cast("string").alias("ROUND"), F.lit("1:30").alias("TIME"), F.lit("5 Rnd (5-5-5-5-5)").alias("TIME FORMAT"))
    q = c("l_quantity").cast("int")
    stats = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("E"), "l_orderkey").alias("EVENT"), bout(c("l_orderkey")).alias("BOUT"), F.concat(F.when(c("l_linenumber") % 2 == 1, "r").otherwise("b"), "l_orderkey").alias("FIGHTER"), (c("l_linenumber") % 2).cast("string").alias("KD"), F.concat(q, F.lit(" of "), q + 5).alias("SIG.STR."),
        F.concat(c("l_suppkey") % 4, F.lit(" of 9")).alias("TD"), F.lit("x").alias("SUB.ATT"), F.concat(F.lit("1:0"), c("l_linenumber")).alias("CTRL"),
    )
    return tables.convert_stats(stats, results, events)


@query(f"with {SCRAPED_SQL} select date, red_fighter, blue_fighter, minutes as total_minutes, red_kd::double as red_kd, red_landed, red_tried, blue_landed, blue_td, blue_ctrl from wide")
def scraped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, AGG-02: rounds summed to a wide row a bout; both corners must be there."""
    long = ("red_sig_str_landed", "red_sig_str_attempted", "blue_sig_str_landed", "blue_td_landed", "blue_ctrl_seconds")
    return _wide_stats(spark, sf_dir).select("date", "red_fighter", "blue_fighter", "total_minutes", "red_kd", *[F.col(a).alias(b) for a, b in zip(long, ("red_landed", "red_tried", "blue_landed", "blue_td", "blue_ctrl"), strict=True)])


@query(
    f"""with {SCRAPED_SQL}, f as (select o_orderkey as fight_id, cast(o_orderdate as date) as date, o_orderkey * 2 as a_id, o_orderkey * 2 + 1 as b_id, case when o_orderkey % 2 = 0 then 'r' else 'b' end || o_orderkey as a_key, case when o_orderkey % 2 = 0 then 'b' else 'r' end || o_orderkey as b_key from orders)
select fight_id, case when a_key like 'r%' then a_id else b_id end as entity, minutes, red_landed::double as landed from wide join f on fight_id = k union all select fight_id, case when a_key like 'b%' then a_id else b_id end, minutes, blue_landed::double from wide join f on fight_id = k"""
)
def matched_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, JOIN-03, JOIN-04: wide rows to the two sides of their bout, corners swapped where they must be."""
    k = F.col("o_orderkey")
    name = lambda x, y: F.concat(F.when(k % 2 == 0, x).otherwise(y), k)
    fights = table(spark, sf_dir, "orders").select(k.alias("fight_id"), F.col("o_orderdate").cast("date").alias("date"), (k * 2).alias("a_id"), (k * 2 + 1).alias("b_id"), name("r", "b").alias("a_key"), name("b", "r").alias("b_key"))
    rows = _wide_stats(spark, sf_dir).withColumn("row_id", F.lit(0))
    return tables.match_stats(rows, fights).select("fight_id", "entity", "minutes", F.col("sig_str_landed").alias("landed"))


# --- identities ----------------------------------------------------------------------------------------------------


@query(
    """with r as (select o_orderkey as row_id, 'c' || o_custkey as slug, lower('Name ' || (o_custkey % 90)) as name_key, 150.0 + o_orderkey % 20 as weight_lbs, cast(o_orderdate as date) as dob, round((5 * 12 + o_orderkey % 12) * 2.54, 1) as height_cm from orders where o_custkey % 17 <> 0),
f as (select *, row_number() over (partition by slug order by row_id) as n from r) select slug, name_key, weight_lbs, dob, height_cm from f where n = 1"""
)
def loaded_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-01: evidence of each source identity, the first row of a slug; rows without a link have none."""
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        k.alias("row_id"), F.concat(F.lit("Name  "), F.col("o_custkey") % 90).alias("FIGHTER"), F.concat(F.lit("5' "), k % 12, F.lit('"')).alias("HEIGHT"), F.concat((150 + k % 20).cast("string"), F.lit(" lbs.")).alias("WEIGHT"), F.lit("--").alias("REACH"), F.date_format("o_orderdate", "MMM dd, yyyy").alias("DOB"),
        F.when(F.col("o_custkey") % 17 != 0, F.concat(F.lit("http://x/d/c"), F.col("o_custkey"), F.lit("/"))).otherwise("").alias("URL"),
    )
    return identity.load(raw).select("slug", "name_key", "weight_lbs", "dob", "height_cm")


@query(
    """with r as (select c_custkey as ref, case when c_custkey % 2 = 0 then 's' || (c_custkey % 70) end as slug, 'n' || (c_custkey % 110) as name_key from customer), e as (select s_suppkey as entity, case when s_suppkey % 3 = 0 then 's' || (s_suppkey % 60) end as slug, 'n' || (s_suppkey % 45) as name_key from supplier),
s as (select slug, count(*) as n, min(entity) as e from e where slug is not null group by 1), k as (select name_key, count(*) as n, min(entity) as e from e group by 1), j as (select r.*, s.n as sn, s.e as se, k.n as kn, k.e as ke from r left join s using (slug) left join k on k.name_key = r.name_key)
select ref, case when sn = 1 then 'existing_by_url' when sn > 1 then 'blocked_ambiguous_url' when kn > 1 then 'blocked_ambiguous_name' when kn = 1 then 'existing_by_name' else 'new' end as action, case when sn = 1 then se when sn is null and kn = 1 then ke end as entity from j"""
)
def guarded_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-07, AGG-03: by unique link, then by unique name; what is ambiguous is blocked."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "customer").select(c.alias("ref"), F.when(c % 2 == 0, F.concat(F.lit("s"), c % 70)).alias("slug"), F.concat(F.lit("n"), c % 110).alias("name_key"))
    ents = table(spark, sf_dir, "supplier").select(s.alias("entity"), F.when(s % 3 == 0, F.concat(F.lit("s"), s % 60)).alias("slug"), F.concat(F.lit("n"), s % 45).alias("name_key"))
    return identity.guarded_resolve(rows, ents).select("ref", "action", "entity")


@query(
    """with n as (select c_custkey as k, case when c_custkey = 7 then 'bobby green' else 'name ' || (c_custkey % 130) || case c_custkey % 4 when 0 then ' jr' when 1 then ' iii' else '' end end as name from customer), e as (select s_suppkey as entity, case when s_suppkey = 3 then 'king green' else 'name ' || (s_suppkey % 90) || case when s_suppkey % 5 = 0 then ' jr' else '' end end as name from supplier),
r as (select name, max(k) as reviewed from n where k % 37 = 0 group by 1), x as (select name, count(*) as c, min(entity) as e from e group by 1), y as (select regexp_replace(name, ' (jr|iii)$', '') as s, count(*) as c, min(entity) as e from e group by 1),
j as (select distinct n.name, reviewed, x.c as xc, x.e as xe, y.c as yc, y.e as ye from n left join r using (name) left join x on x.name = case when n.name = 'bobby green' then 'king green' else n.name end left join y on y.s = regexp_replace(case when n.name = 'bobby green' then 'king green' else n.name end, ' (jr|iii)$', ''))
select name, case when reviewed is not null then 'reviewed' when xc = 1 then 'exact' when xc > 1 then 'ambiguous' when yc = 1 then 'suffixless' when yc > 1 then 'ambiguous' else 'unmatched' end as rule, case when reviewed is not null then reviewed when xc = 1 then xe when xc is null and yc = 1 then ye end as entity from j"""
)
def provider_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-09, JOIN-16, STR-07, STR-08: reviewed mapping, alias or exact name, unique name without its suffix."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    named = F.when(c == 7, "bobby green").otherwise(F.concat(F.lit("name "), c % 130, F.when(c % 4 == 0, " jr").when(c % 4 == 1, " iii").otherwise("")))
    names = table(spark, sf_dir, "customer").select(F.lit("p").alias("provider"), named.alias("name"), c.alias("k"))
    ents = table(spark, sf_dir, "supplier").select(s.alias("entity"), F.when(s == 3, "king green").otherwise(F.concat(F.lit("name "), s % 90, F.when(s % 5 == 0, " jr").otherwise(""))).alias("name"))
    reviewed = names.filter("k % 37 = 0").select("provider", "name", F.col("k").alias("entity"))
    return identity.provider_match(names.select("provider", "name").distinct(), ents, reviewed).select("name", "rule", "entity")


@query(
    """with e as (select s_suppkey as entity, 's' || s_suppkey as slug, 'n' || (s_suppkey % 80) as name_key, case when s_suppkey % 4 = 0 then 1.0 end as height from supplier), d as (select 's' || (c_custkey * 3) as slug, 'n' || (c_custkey % 400) as name_key, c_acctbal as height from customer),
o as (select slug, min(height) as h from d group by 1), m as (select name_key, min(height) as h from d group by 1 having count(*) = 1), w as (select name_key, count(*) as c from e group by 1)
select entity, coalesce(e.height, o.h, case when w.c = 1 then m.h end) as height from e left join o using (slug) left join m on m.name_key = e.name_key left join w on w.name_key = e.name_key"""
)
def filled_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, JOIN-09: missing values by link, then by an unambiguous name; present ones never change."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    ents = table(spark, sf_dir, "supplier").select(s.alias("entity"), F.concat(F.lit("s"), s).alias("slug"), F.concat(F.lit("n"), s % 80).alias("name_key"), F.when(s % 4 == 0, 1.0).alias("height"))
    details = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), c * 3).alias("slug"), F.concat(F.lit("n"), c % 400).alias("name_key"), F.col("c_acctbal").alias("height"))
    return identity.fill_details(ents, details, ("height",)).select("entity", "height")


@query(
    f"with {B.BOUTS_SQL}, s as (select 's' || a_id as slug, date from bouts union all select 's' || b_id, date from bouts), o as (select 's' || c_custkey as slug, date '2024-01-15' as f, date '2024-01-16' as l from customer), n as (select slug, min(date) as f, max(date) as l from s group by 1) select coalesce(n.slug, o.slug) as slug, least(n.f, o.f) as first_seen, greatest(n.l, o.l) as last_seen from n full outer join o on o.slug = n.slug"
)
def first_and_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-16: the days between which a slug was seen, widened by what was stored."""
    b = B.bouts(spark, sf_dir)
    days = b.select("date", F.explode(F.array("a_id", "b_id")).alias("e")).select(F.concat(F.lit("s"), "e").alias("slug"), "date")
    stored = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("slug"), F.lit(date(2024, 1, 15)).alias("first_seen"), F.lit(date(2024, 1, 16)).alias("last_seen"))
    return history.seen(days, stored)


@query(
    """with s as (select l_orderkey * 10 + l_linenumber as snapshot_id, l_orderkey as event_id, l_suppkey % 3 as book from lineitem), n as (select *, row_number() over (partition by event_id, book order by snapshot_id) as k from s) select snapshot_id, case when k > 1 then 'rejected_duplicate' else 'normalized' end as status from n"""
)
def payload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-11: later copies within a payload."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("snapshot_id"), F.col("l_orderkey").alias("event_id"), (F.col("l_suppkey") % 3).alias("book"), F.lit("normalized").alias("status"))
    return quotes.mark_duplicates(rows, ("event_id", "book")).select("snapshot_id", "status")


NAMESAKES_SQL = """ids as (select 's' || s_suppkey as slug, 'n' || (s_suppkey % 40) as name_key from supplier), sides as (select o_orderkey as ref, 'n' || (o_orderkey % 45) as name_key, case when o_orderkey % 4 > 0 then 's' || (o_orderkey % 45 + 40 * (o_orderkey % 2)) end as slug from orders)"""


def _namesakes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, k = F.col("s_suppkey"), F.col("o_orderkey")
    ids = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s).alias("slug"), F.concat(F.lit("n"), s % 40).alias("name_key"), (115.0 + s % 3 * 10).alias("weight_lbs"), F.lit(date(1960, 1, 1)).alias("dob"), s.alias("k"))
    sides_ = table(spark, sf_dir, "orders").select(k.alias("ref"), F.concat(F.lit("n"), k % 45).alias("name_key"), F.col("o_orderdate").cast("date").alias("date"), pick(("Strawweight", "Flyweight", None, None), k).alias("weight_class"), F.when(k % 4 > 0, F.concat(F.lit("s"), k % 45 + 40 * (k % 2))).alias("slug"))
    return ids, sides_


@query(
    f"""with {NAMESAKES_SQL}, m as (select name_key, count(distinct slug) as identities from ids group by 1 having count(distinct slug) > 1), p as (select name_key, identities, slug, count(*) as n from sides join m using (name_key) group by all)
select name_key, identities, cast(sum(n) as bigint) as bouts, cast(coalesce(sum(case when slug is null then n end), 0) as bigint) as unresolved, coalesce(string_agg(slug || ':' || n, ',' order by slug) filter (slug is not null), '') as by_slug from p group by 1, 2"""
)
def namesake_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-06: bouts of each identity that shares a name, and those that nothing settles."""
    ids, sides_ = _namesakes(spark, sf_dir)
    done = sides_.select("ref", "slug", F.lit("x").alias("rule"))
    out = identity.split_report(sides_, done, ids)
    return out.withColumn("by_slug", F.array_join(F.transform("by_slug", lambda x: F.concat(x["slug"], F.lit(":"), x["bouts"])), ","))


@query()
def assigned_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-03, IDN-04: sides of all bouts to identities. Chains of continuity depend on the order of assignments; the tests follow them pass by pass."""
    ids, sides_ = _namesakes(spark, sf_dir)
    return identity.assign(sides_.drop("slug"), ids.drop("k"))


# --- cards and ledgers ---------------------------------------------------------------------------------------------

CARD_DAY = date(2024, 1, 20)
NEW_CARD_SQL = f"""card as (select c_custkey as row_no, c_custkey as a_id, c_custkey + 1000000 as b_id from customer), made as (select -1000001 - row_no as fight_id, date '{CARD_DAY}' as date, 'a' as side, a_id as entity, b_id as opponent from card union all select -1000001 - row_no, date '{CARD_DAY}', 'b', b_id, a_id from card)"""
_EARLIER = f"select * from apps0 where date < date '{CARD_DAY}' union all by name select *, 0 as won, false as has_stats, false as opp_has_stats from made"
_WANTED = (*history.RECORD, *history.FORM, "days_since_last_fight", "layoff_days", "long_layoff", "sig_strikes_landed_per_min", "control_time_per_15", "takedown_defense", "no_prior_stats")


def _new_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"), F.lit(CARD_DAY).alias("date"), F.col("c_custkey").alias("a_id"), (F.col("c_custkey") + 1_000_000).alias("b_id"))


@query(
    f"""with {APPS.replace("apps as", "apps0 as", 1)}, {NEW_CARD_SQL}, apps as ({_EARLIER}), {RECORD_LONG}, {LAYOFF_LONG}, {RATES_LONG},
known as (select r.fight_id, r.side, {", ".join(f"{t}.{c}" for t, cs in (("r", (*history.RECORD, *history.FORM)), ("l", ("days_since_last_fight", "layoff_days", "long_layoff")), ("q", _WANTED[-4:])) for c in cs)} from rec2 r join lay2 l on l.fight_id = r.fight_id and l.side = r.side join rates q on q.fight_id = r.fight_id and q.side = r.side where r.fight_id < 0)
select fight_id, {sides(_WANTED)} from known group by fight_id"""
)
def upcoming_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-02, SET-04: history, form, layoff and rates of a card's bouts, from bouts strictly before its day."""
    out = ledger.upcoming_features(B.appearances(spark, sf_dir), B.bouts(spark, sf_dir), _new_card(spark, sf_dir))
    return out.select("fight_id", *[f"{c}_{s}" for c in _WANTED for s in ("a", "b", "diff")])


@query(
    ELO_SQL
    + f""", {NEW_CARD_SQL}, long as (select date, fight_id, a_id as entity, a_pre + 32 * (a_won - e) as rating from snap union all select date, fight_id, b_id, b_pre + 32 * ((1 - a_won) - (1 - e)) from snap), last as (select entity, rating, row_number() over (partition by entity order by date desc, fight_id desc) as n from long where date < date '{CARD_DAY}')
select -1000001 - row_no as fight_id, coalesce(rating, 1500.0) as a_rating, 1500.0::double as b_rating, 1 / (1 + power(10.0::double, (1500.0 - coalesce(rating, 1500.0)) / 400)) as a_expected from card left join last on entity = a_id and n = 1"""
)
def upcoming_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-02: ratings before a card's day."""
    return ledger.upcoming(B.bouts(spark, sf_dir), _new_card(spark, sf_dir)).select("fight_id", "a_rating", "b_rating", "a_expected")


@query(
    f"""with {B.BOUTS_SQL}, k as (select fight_id, date || '|' || least(a_id::varchar, b_id::varchar) || '|' || greatest(a_id::varchar, b_id::varchar) as k, {picked(LABELS[:4], 'fight_id')} as wc from bouts), f as (select k, arg_min(wc, fight_id) as wc from k where wc is not null group by k) select fight_id, f.wc as weight_class from k join f using (k)"""
)
def ledger_weight_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13: the weight class of the first feature row of a bout's key."""
    text = lambda c: F.col(c).cast("string")
    b = B.bouts(spark, sf_dir).select("fight_id", F.col("date").alias("event_date"), text("a_id").alias("fighter_a"), text("b_id").alias("fighter_b"))
    features = b.select("event_date", F.col("fighter_b").alias("fighter_a"), F.col("fighter_a").alias("fighter_b"), F.col("fight_id").alias("row_index"), pick(LABELS[:4], F.col("fight_id")).alias("weight_class"))
    return ledger.with_weight_class(b, features).select("fight_id", "weight_class")


@query(
    f"""with {B.BOUTS_SQL}, r as (select strftime(date, '%Y-%m') as month, a_won, (a_id % 10 + 0.5) / 10 as p from bouts) select month, count(*) as n, avg(case when a_won = 1 then -ln(p) else -ln(1 - p) end) as log_loss, avg((p - a_won) * (p - a_won)) as brier, avg(cast(cast(p >= 0.5 as int) = a_won as int)) as accuracy,
 case when count(*) < 50 then 'insufficient_sample' when count(*) < 100 then 'small_sample' else 'ok' end as status from r group by 1"""
)
def live_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-10: figures of resolved predictions by month."""
    p, y = (F.col("a_id") % 10 + 0.5) / 10, F.col("a_won")
    rows = B.bouts(spark, sf_dir).select(P.month_of(F.col("date")).alias("month"), N.log_loss(p, y).alias("log_loss"), N.brier(p, y).alias("brier"), ((p >= 0.5).cast("int") == y).cast("int").alias("correct_prediction"))
    return ledger.monitor(rows, "month")


@query(f"with {B.BOUTS_SQL}, m as (select min(a_id) as one from bouts) select date, fight_id, case when a_id = one then 'a' else 'b' end as side, a_won from bouts, m where a_id = one or b_id = one")
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV-04: one competitor's bouts."""
    b = B.bouts(spark, sf_dir)
    one = b.agg(F.min("a_id")).first()[0]
    named = b.withColumns({"fighter_a": F.concat(F.lit("U "), "a_id"), "fighter_b": F.concat(F.lit("U "), "b_id")})
    return ledger.timeline(named, f"u {one}", ("a_won",))


_LANES = "lanes as (select fight_id, date, a_id * 2 + fight_id % 2 as a_id, b_id * 2 + fight_id % 2 as b_id, a_won from bouts)"


@query(ELO_SQL.replace("o as (select *, row_number() over (order by date, fight_id) as n from bouts)", f"{_LANES}, o as (select *, row_number() over (order by date, fight_id) as n from lanes)") + " select fight_id, a_id, b_id, a_pre, b_pre from snap")
def elo_by_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: ratings of two leagues that never meet, each replayed on its own, as one replay of all would give them."""
    lane = F.col("fight_id") % 2
    b = B.bouts(spark, sf_dir).withColumns({"a_id": F.col("a_id") * 2 + lane, "b_id": F.col("b_id") * 2 + lane})
    return rating.elo(rating.with_leagues(b), component="league").select("fight_id", "a_id", "b_id", "a_pre", "b_pre")


# --- quotes --------------------------------------------------------------------------------------------------------

SNAPSHOT_SQL = """snaps as (select l_orderkey * 10 + l_linenumber as snapshot_id, l_orderkey as fight_id, l_orderkey * 2 as entity, l_orderkey * 2 + 1 as opponent, ['sportsbook', 'exchange', 'sportsbook', 'sportsbook'][l_suppkey % 4 + 1] as venue_type, case when l_suppkey % 7 > 0 then 'book' || (l_suppkey % 7) end as book, l_suppkey % 9 > 0 as approved,
 case when l_partkey % 11 = 0 then 'rejected_schema' else 'normalized' end as status, case l_partkey % 13 when 0 then 'ambiguous' when 1 then 'unmatched' else 'matched' end as match_status, case when l_partkey % 17 = 0 then 'totals' else 'h2h' end as market_type, l_partkey % 19 > 0 as pre_fight,
 l_shipdate as observed, cast(cast(o_orderdate as date) + 60 as timestamp) as cutoff, cast(cast(o_orderdate as date) + 55 as timestamp) as starts, l_partkey % 23 as turn, l_partkey % 29 as flaw, 1 + l_quantity / 25.0 as pa, 1 + 25.0 / l_quantity as pb from lineitem join orders on o_orderkey = l_orderkey),
judged as (select *, case when venue_type <> 'sportsbook' then 'venue_type_' || venue_type || '_prohibited' when book is null then 'unapproved_or_unknown_sportsbook' when not approved and book <> 'book2' then 'unapproved_sportsbook' when book = 'book6' then 'not_in_requested_eligible_set' when status <> 'normalized' then status
 when match_status <> 'matched' then 'match_status_' || match_status when market_type <> 'h2h' then 'unsupported_market' when not pre_fight then 'live_or_post_start' when observed > cutoff then 'observation_after_prediction_cutoff' when observed >= starts then 'observation_at_or_after_scheduled_start' when epoch(cutoff) - epoch(observed) > 50 * 24 * 3600 then 'snapshot_stale'
 when turn = 0 then 'incomplete_or_multiway_market' when turn = 1 then 'fighter_orientation_mismatch' when flaw in (0, 1) then 'invalid_outcome' when flaw = 2 then 'invalid_odds' end as reason from snaps)"""
ELIGIBLE = ("book1", "book2", "book3", "book4", "book5")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    turn, flaw, a, b = c("l_partkey") % 23, c("l_partkey") % 29, c("l_orderkey") * 2, c("l_orderkey") * 2 + 1
    outcome = lambda e, o, p: F.struct(e.alias("entity"), o.alias("opponent"), (flaw != 0).alias("valid"), (flaw != 1).alias("oriented"), F.when(flaw != 2, p).alias("price"))
    one, two = outcome(a, b, 1 + c("l_quantity") / 25.0), outcome(b, a, 1 + 25.0 / c("l_quantity"))
    day = c("o_orderdate").cast("date")
    return rows.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("snapshot_id"), c("l_orderkey").alias("fight_id"), a.alias("entity"), b.alias("opponent"), pick(("sportsbook", "exchange", "sportsbook", "sportsbook"), c("l_suppkey")).alias("venue_type"), F.when(c("l_suppkey") % 7 > 0, F.concat(F.lit("book"), c("l_suppkey") % 7)).alias("book"), F.lit("raw").alias("provider_key"),
        (c("l_suppkey") % 9 > 0).alias("approved"), F.when(c("l_partkey") % 11 == 0, "rejected_schema").otherwise("normalized").alias("status"), F.when(c("l_partkey") % 13 == 0, "ambiguous").when(c("l_partkey") % 13 == 1, "unmatched").otherwise("matched").alias("match_status"), F.when(c("l_partkey") % 17 == 0, "totals").otherwise("h2h").alias("market_type"),
        (c("l_partkey") % 19 > 0).alias("pre_fight"), c("l_shipdate").alias("observed"), F.date_add(day, 60).cast("timestamp_ntz").alias("cutoff"), F.date_add(day, 55).cast("timestamp_ntz").alias("starts"), F.when(turn == 0, F.array(one)).when(turn == 1, F.array(one, one)).otherwise(F.array(two, one)).alias("outcomes"),
    )


@query(f"with {SNAPSHOT_SQL} select snapshot_id, reason from judged")
def quote_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19: the first of fifteen reasons against each stored snapshot."""
    return _snapshots(spark, sf_dir).select("snapshot_id", quotes.source_reason(ELIGIBLE, ("book2",), 50 * 24.0).alias("reason"))


@query(
    f"""with {SNAPSHOT_SQL}, named as (select *, coalesce(book, 'raw') as b, (1 / pa) / (1 / pa + 1 / pb) as fair from judged), w as (select fight_id, b, arg_max(fair, (observed, snapshot_id)) filter (reason is null) as fair, string_agg(distinct reason, '+' order by reason) as reasons from named group by 1, 2)
select fight_id, fight_id * 2 as entity, median(fair) as median_fair, avg(fair) as mean_fair, min(fair) as min_fair, max(fair) as max_fair, count(fair) as books, count(fair) < 3 as coverage_low, coalesce(string_agg(b || ':' || reasons, ';' order by b || ':' || reasons), '') as excluded from w group by fight_id"""
)
def side_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-18, AGG-16, AGG-17, ODD-07, FLT-19: consensus for a bout's side over the books that can serve."""
    out = quotes.side_consensus(_snapshots(spark, sf_dir), ELIGIBLE, ("book2",), 50 * 24.0)
    return out.select("fight_id", "entity", "median_fair", "mean_fair", "min_fair", "max_fair", "books", "coverage_low", F.array_join("excluded", ";").alias("excluded"))


def broken_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, payload): the orders of each customer as a provider's payload, broken by their own values."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    known = [("id", key.cast("string")), ("sport_key", F.lit('"s"')), ("commence_time", F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"'))), ("home_team", F.when(status == "P", "null").otherwise('"h"')), ("away_team", F.lit('"a"')), ("bookmakers", F.lit("[]"))]
    gone = {"commence_time": status == "F", "bookmakers": key % 5 == 0, "id": key % 11 == 0}
    fields = [F.when(~gone.get(n, F.lit(False)), F.concat(F.lit(f'"{n}": '), v)) for n, v in known]
    event = F.when(key % 13 == 0, key.cast("string")).otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ", "), F.lit("}")))
    each = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", event.alias("event")).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "event"))), lambda e: e["event"]), ",").alias("events"))
    whole = lambda mark, close="]}": F.concat(F.lit("{" + mark + '"data":['), "events", F.lit(close))
    k = F.col("k")
    return each.select("k", F.when(k % 7 == 0, F.concat(F.lit('{"timestamp":"t","data":{"one":['), "events", F.lit("]}}"))).when(k % 17 == 0, whole('"timestamp":"t",', "]")).when(k % 3 == 0, whole("")).otherwise(whole('"timestamp":"t",')).alias("payload"))


@query(
    """with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as nth from orders),
e as (select o_custkey as k, o_orderkey, case when o_orderkey % 13 = 0 then 'event[' || nth || '] is no object' else array_to_string(list_filter([case when o_orderkey % 11 = 0 then 'event[' || nth || '] lacks id' end, case when o_orderstatus = 'F' then 'event[' || nth || '] lacks commence_time' end, case when o_orderkey % 5 = 0 then 'event[' || nth || '] lacks bookmakers' end], lambda x: x is not null), ';') end as told from o),
g as (select k, array_to_string(list_filter(list(told order by o_orderkey), lambda x: x <> ''), ';') as told from e group by k)
select k, case when k % 7 = 0 then 'events are no list' when k % 17 = 0 then 'invalid_json' when k % 3 = 0 then 'no timestamp' || case when told <> '' then ';' || told else '' end else told end as errors from g"""
)
def payload_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ODD-02: what is wrong with payloads made of customers' orders."""
    return quotes.payload_errors(broken_payloads(spark, sf_dir)).select("k", F.array_join("errors", ";").alias("errors"))


@query(
    """with s as (select 's' || (l_orderkey % 5000) as selection_id from lineitem), t as (select distinct 's' || (o_custkey * 2) as selection_id from orders) select distinct selection_id from s where selection_id not in (select selection_id from t)"""
)
def new_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ODD-08, INC-08: keys that are not stored yet, once each."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_orderkey") % 5000).alias("selection_id"))
    stored = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") * 2).alias("selection_id")).distinct()
    return quotes.newly(rows, stored)


_REMATCH = "case when fight_id % 10 = 0 then 'rejected_live_market' else 'normalized' end"


@query(
    f"""with {B.BOUTS_SQL}, p as (select date, least(a_id, b_id) as x, greatest(a_id, b_id) as y, count(*) as n from bouts group by all), s as (select fight_id, date, least(a_id, b_id) as x, greatest(a_id, b_id) as y, {_REMATCH} as status from bouts)
select count(*) as examined, count(case when status = 'normalized' and n = 1 then 1 end) as matched, 0::bigint as unmatched, count(case when status = 'normalized' and n > 1 then 1 end) as ambiguous, count(case when status <> 'normalized' then 1 end) as rejected from s join p using (date, x, y)"""
)
def rematched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ODD-06, JOIN-14, IDN-10: stored snapshots matched again; rejected ones stay so."""
    b = B.bouts(spark, sf_dir)
    stored = b.select(F.col("fight_id").alias("snapshot_id"), F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.col("date").alias("day"), F.when(F.col("fight_id") % 10 == 0, "rejected_live_market").otherwise("normalized").alias("status"), F.lit("x").alias("batch_id"))
    return quotes.rematch(stored, b)[1]


@query(f"with {APPS}, {RATES_LONG} select fight_id, (max(case when side = 'a' then entity end) - max(case when side = 'b' then entity end)) * (max(case when side = 'a' then sig_strikes_landed_per_min end) + max(case when side = 'b' then sig_strikes_landed_per_min end)) / 2 as reach_volume_interaction from rates group by fight_id")
def reach_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02: the compound of reach and volume."""
    wide = history.to_bouts(history.rates(B.appearances(spark, sf_dir)), (*history.ROLLING, *history.AGAINST, "no_prior_stats"), diffs=False)
    return matchup.matchup(wide.withColumn("reach_diff", F.col("a_id") - F.col("b_id"))).select("fight_id", "reach_volume_interaction")


# --- preprocessing and folds ---------------------------------------------------------------------------------------

KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    "with e as (select event_id, case when event_id % 7 = 0 then null else value end as x, case when event_id % 11 = 0 then null else event_type end as c from events), f as (select median(x) as med from e), g as (select *, coalesce(x, med) as xf from e, f), h as (select avg(xf) as m, stddev_pop(xf) as s from g), t as (select c, count(*) as n from e where c is not null group by 1), top as (select c from t order by n desc, c limit 1)"
    + " select event_id, (xf - m) / s as x, "
    + ", ".join(f"cast(coalesce(g.c, top.c) = '{k}' as int)::double as is_{k}" for k in KINDS)
    + " from g, h, top"
)
def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-01 to ML-03, ML-13: median and deviation of the fitting rows, most frequent category, one column a category."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("c"))
    prep = models.Preprocessor(["x"], "c").fit(e)
    out = prep.transform(e).select("event_id", vector_to_array("features").alias("v"))
    at = {n: k for k, n in enumerate(prep.names)}
    return out.select("event_id", F.col("v")[0].alias("x"), *[(F.col("v")[at[f"c={k}"]] if f"c={k}" in at else F.lit(0.0)).alias(f"is_{k}") for k in KINDS])


FOLD_SQL = "r as (select l_returnflag || l_linestatus as name, l_linenumber as fold, avg(l_discount * 10) as log_loss from lineitem group by 1, 2)"


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_linenumber").alias("fold")).agg(F.avg(F.col("l_discount") * 10).alias("log_loss"))


@query(
    f"""with {FOLD_SQL}, a as (select fold, log_loss as base from r where name = 'AF') select name, count(*) as n_folds, avg(log_loss) as log_loss, stddev_pop(log_loss) as log_loss_sd, avg(base - log_loss) as gain, count(case when log_loss < base then 1 end) as folds_won from r left join a using (fold) group by name"""
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, JOIN-19: candidates over folds, each fold against the anchor's."""
    return metrics.fold_summary(_folds(spark, sf_dir), "AF")


@query(
    """with c as (select strftime(l_shipdate, '%Y-%m') as feature, l_linenumber as fold, case when l_linenumber = 7 then 0 else avg(l_discount) - 0.05 end as coefficient from lineitem group by 1, 2)
select feature, avg(coefficient) as mean, stddev_pop(coefficient) as sd, count(case when coefficient <> 0 then 1 end) as nonzero, min(coefficient) < 0 and max(coefficient) > 0 as sign_flip from c group by feature"""
)
def coefficient_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: sparsity and signs of coefficients over folds."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("feature"), F.col("l_linenumber").alias("fold")).agg((F.avg("l_discount") - 0.05).alias("c"))
    return metrics.stability(rows.select("feature", "fold", F.when(F.col("fold") == 7, 0.0).otherwise(F.col("c")).alias("coefficient")))


@query(f"with {APPS}, {RECORD_LONG}, {LAYOFF_LONG} select r.fight_id, {sides(('prior_fights',)).replace('side =', 'r.side =')}, max(case when l.side = 'a' then layoff_days end) as layoff_days_a from rec2 r join lay2 l on l.fight_id = r.fight_id and l.side = r.side group by r.fight_id")
def joined_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-05: two feature tables of one row a bout, put together one to one."""
    long = B.appearances(spark, sf_dir).select("fight_id", "date", "side", "entity", "opponent", "won")
    base = history.to_bouts(history.record(long), ("prior_fights",)).select("fight_id", "prior_fights_a", "prior_fights_b", "prior_fights_diff")
    more = history.to_bouts(history.layoff(long), ("layoff_days",)).select("fight_id", "layoff_days_a")
    return history.one_to_one(base, more)


@query(f"with {B.BOUTS_SQL} select date as event_date, 'E' || fight_id as event_name, 'U' || a_id as fighter_a, 'U' || b_id as fighter_b, a_id - b_id as gap from bouts")
def prediction_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08: results are left behind."""
    rows = B.bouts(spark, sf_dir).withColumns({"event": F.concat(F.lit("E"), "fight_id"), "fighter_a": F.concat(F.lit("U"), "a_id"), "fighter_b": F.concat(F.lit("U"), "b_id"), "gap": F.col("a_id") - F.col("b_id")})
    return matchup.prediction_input(rows, ["gap"])
