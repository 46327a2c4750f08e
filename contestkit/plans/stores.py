"""Queries for sources, sinks, streams and fitted models, each beside the SQL that must give the same rows. Tables are written to the shared folder and read again."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestkit.functions.text import canonical_column
from contestkit.operators import applying, batch, filters, history, ledger, models, rating, splits
from contestkit.plans import bindings as B
from contestkit.plans.queries import APPS, LAYOFF_LONG, RECORD_LONG, query
from contestkit.session import cut, fresh, table
from contestkit.sources import pages, tables, versioned
from contestkit.streaming import state

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
_NAMES_SQL = "names as (" + " union all ".join(f"select '{t}' as source, column_name as name from (describe select * from {t})" for t in TABLES) + ")"


def _columns(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    return [(t, c) for t in TABLES for c in table(spark, sf_dir, t).columns]


# --- guards and validation -------------------------------------------------------------------------------------------

#: What a derived column's name may begin or end with.
MADE = ("", "avg_", "post_", "winner_", "_odds", "_book", "_rate", "Result_")


def _any_like(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({column}), '{p}')" for p in parts) + ")"


@query(
    f"with {_NAMES_SQL}, made as (select distinct case when starts_with(m, '_') then name || m else m || name end as name from names cross join (select unnest([{', '.join(repr(m) for m in MADE)}]) as m))"
    + f" select name, {_any_like('name', filters.EXPORT_PATTERNS)} and name not in ('winner', 'fighter_a_won', 'method', 'round') as export_leak, {_any_like('name', filters.MODEL_PATTERNS)} as model_leak, {_any_like('name', filters.MARKET_TOKENS)} as market from made"
)
def column_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06, FLT-07, FLT-18: which columns of the tables, and names made of them, each guard refuses."""
    names = sorted({c + m if m.startswith("_") else m + c for _, c in _columns(spark, sf_dir) for m in MADE})
    found = {"export_leak": set(filters.leaking(names, filters.EXPORT_PATTERNS, filters.EXPORT_ALLOWED)), "model_leak": set(filters.leaking(names)), "market": set(filters.market_names(names))}
    return spark.createDataFrame([(n, *(n in found[g] for g in ("export_leak", "model_leak", "market"))) for n in names], "name string, export_leak boolean, model_leak boolean, market boolean")


@query(f"with {_NAMES_SQL} select source, name, replace(replace(lower(trim(name)), '_', ''), ' ', '') as canonical from names")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: canonical forms of the tables' columns."""
    return spark.createDataFrame([(t, c, canonical_column(c)) for t, c in _columns(spark, sf_dir)], "source string, name string, canonical string")


@query(
    """with p as (select c_custkey, case when o_orderstatus = 'Z' then 1.0 end as never, case when o_orderkey % 7 = 0 then o_totalprice end as seldom, o_totalprice as always from orders join customer on o_custkey = c_custkey)
select 'never' as name, count(never) > 0 as usable from p union all select 'seldom', count(seldom) > 0 from p union all select 'always', count(always) > 0 from p union all select 'absent', false"""
)
def usable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08: wanted columns that are there and not null throughout."""
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "Z", 1.0).alias("never"), F.when(F.col("o_orderkey") % 7 == 0, price).alias("seldom"), price.alias("always"))
    usable, skipped = filters.available(rows, ["never", "seldom", "always", "absent"])
    return spark.createDataFrame([(c, True) for c in usable] + [(c, False) for c in skipped], "name string, usable boolean")


@query("select o_orderkey, cast(o_totalprice as double) as price, case when o_orderkey % 5 > 0 then o_orderkey / 4.0 end as share from orders")
def coerced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09: numbers from text; nulls stay."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), F.col("o_totalprice").cast("string")).alias("price"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") / 4.0).cast("string")).alias("share"))
    return filters.numeric_or_fail(rows, ["price", "share"])


@query(
    """with a as (select * from (describe select * from orders)), b as (select column_name from (describe select * from lineitem)),
old as (select distinct l_orderkey as k from lineitem), new as (select o_orderkey as k from orders)
select 'only_new' as kind, count(*) as n from a where replace(column_name, 'o_', 'l_') not in (select column_name from b) union all select 'only_old', count(*) from b where column_name not in (select replace(column_name, 'o_', 'l_') from a)
 union all select 'keys_only_new', count(*) from new where k not in (select k from old) union all select 'keys_only_old', count(*) from old where k not in (select k from new)"""
)
def schema_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, SET-02: columns and keys that one of two tables lacks."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey"])
    found = filters.schema_parity(orders.toDF(*[c.replace("o_", "l_", 1) for c in orders.columns]), lines, "l_orderkey")
    return spark.createDataFrame([(k, v if isinstance(v, int) else len(v)) for k, v in found.items() if k != "same_order"], "kind string, n long")


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("""select o_orderkey::varchar as key, o_orderpriority as name, case when o_orderkey % 3 > 0 then 'a, "b" ' || o_custkey end as note from orders""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SRC-01: written as CSV, nulls as empty cells, and read again as text."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit('a, "b" '), "o_custkey")).alias("note"))
    path = fresh(spark, "csv")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path)


@query("select o_custkey as customer, min(o_orderkey) as first_order from orders where o_orderkey % 2 = 0 group by 1 union all select o_custkey, min(o_orderkey) from orders where o_custkey not in (select o_custkey from orders where o_orderkey % 2 = 0) group by 1")
def appended_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, SNK-05, SRC-12: keys that are stored stay as they are, new ones are appended; read only."""
    first = lambda rows: rows.groupBy(F.col("o_custkey").alias("customer")).agg(F.min("o_orderkey").alias("first_order"))
    orders, path = table(spark, sf_dir, "orders"), fresh(spark, "appended")
    tables.append_new(first(orders.filter("o_orderkey % 2 = 0")), path, ("customer",))
    tables.append_new(first(orders), path, ("customer",))
    return tables.read_only(spark, path)


@query("select o_orderstatus, count(*) as n, sum(o_totalprice) as total from orders group by o_orderstatus")
def promoted_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06, SNK-07: rows promoted over an older version, and one that fails its check, which is not seen."""
    orders, target = table(spark, sf_dir, "orders"), fresh(spark, "promoted")
    rows = lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    tables.promote(rows(orders.filter("o_custkey % 2 = 0")), target, {"some": F.col("n") > 0})
    staged = tables.rebuild(rows(orders), f"{target}-staged", (target,))
    tables.promote(staged, target, {"some": F.col("n") > 0})
    try:
        tables.promote(staged.limit(1), target, {"none": F.col("n") < 0})
    except ValueError:
        return spark.read.schema(staged.schema).parquet(tables.current(spark, target))
    raise AssertionError("a version that fails its check was promoted")


@query("""select distinct '{"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}' as payload, sha256('{"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}') as payload_hash from orders""")
def archived_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, INC-08: payloads archived twice, with keys in either order; each content is there once."""
    orders, path = table(spark, sf_dir, "orders"), fresh(spark, "archive")
    ordered = F.concat(F.lit('{"customer":'), "o_custkey", F.lit(',"status":"'), "o_orderstatus", F.lit('"}'))
    turned = F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('", "customer": '), "o_custkey", F.lit("}"))
    tables.archive(orders.select(ordered.alias("payload")), path)
    tables.archive(orders.select(turned.alias("payload")), path)
    return spark.read.parquet(path)


@query("select length(n_name) + 1 as n_bytes, md5(n_name || chr(10)) as md5, sha256(n_name || chr(10)) as sha256 from nation")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-05: sizes and digests of files, one of each nation's name."""
    path = fresh(spark, "files")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_name").alias("of")).repartition(8).write.partitionBy("of").text(path)
    return tables.digests(spark, f"{path}/*/*.txt").select("n_bytes", "md5", "sha256")


@query("select s_suppkey as key, s_name as name, s_acctbal as balance from supplier")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: JSON files, one document each."""
    path = fresh(spark, "json")
    rows = table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))).alias("value"))
    tables.write_documents(rows, path)
    return tables.load_json(spark, path, "key long, name string, balance double").select("document.*")


@query("select o_custkey as page, 'Order ' || o_orderkey || ' & more' as name, 'http://x/event-details/' || o_orderkey as url, case when o_orderstatus <> 'F' then strftime(o_orderdate, '%Y-%m-%d') end as date_text from orders")
def listed_event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: events of listing pages, one page a customer, by a table function."""
    pages.register_table_functions(spark)
    row = F.concat(F.lit('<tr><td><a href="http://x/event-details/'), "o_orderkey", F.lit('"> Order '), "o_orderkey", F.lit(" &amp; more</a>"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit('<span class="b-statistics__date"> '), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</span>"))).otherwise(""), F.lit("</td></tr>"))
    html = table(spark, sf_dir, "orders").select("o_custkey", row.alias("row")).groupBy("o_custkey").agg(F.concat(F.lit('<table class="b-statistics__table-events">'), F.array_join(F.collect_list("row"), "\n"), F.lit("</table>")).alias("html"))
    return spark.sql("select p.o_custkey as page, e.name, e.url, e.date_text from {html} p, lateral listed_events(p.html) e", html=html)


# --- splits and ranking ----------------------------------------------------------------------------------------------


@query(
    f"with {B.BOUTS_SQL}, n as (select *, row_number() over (order by date, fight_id) as nth, count(*) over () as total from bouts) select case when nth <= round_even(total * 0.8, 0) then 'train' else 'test' end as split, count(*) as n, min(date) as first_day, max(date) as last_day from n group by 1"
)
def locked_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07: a split that is locked to its counts and days, checked, and counted again."""
    rows = cut(splits.two_way(B.bouts(spark, sf_dir)))
    count = lambda df: df.groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    expected = {r["split"]: (r["n"], r["first_day"], r["last_day"]) for r in count(rows).collect()}  # two rows
    return count(splits.locked(rows, expected))


@query(
    """with recursive c as (select o_orderpriority || o_orderstatus as name, round(avg(o_totalprice) / 1e6, 6) as log_loss, round(avg(o_custkey) / 1e4, 6) as brier, count(*)::double as auc from orders group by 1),
lead as (select min(log_loss) as low, 1 as band from c union all select (select min(log_loss) from c where log_loss > lead.low + 0.002), band + 1 from lead where exists (select 1 from c where log_loss > lead.low + 0.002)),
b as (select c.*, (select max(band) from lead where low <= c.log_loss) as band from c)
select name, row_number() over (order by band, brier, auc desc, name) as place from b"""
)
def noise_band_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08: candidates in bands of equal loss, within a band by the other scores."""
    c = table(spark, sf_dir, "orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("name")).agg(F.round(F.avg("o_totalprice") / 1e6, 6).alias("log_loss"), F.round(F.avg("o_custkey") / 1e4, 6).alias("brier"), F.count("*").cast("double").alias("auc"))
    ranked = splits.noise_band_rank([r.asDict() for r in c.orderBy("name").collect()])  # a dimension
    return spark.createDataFrame([(r["name"], k) for k, r in enumerate(ranked, 1)], "name string, place long")


# --- models with a closed form ---------------------------------------------------------------------------------------


@query(
    """with d as (select (l_returnflag = 'R')::int as r, (l_returnflag = 'A')::int as a, (l_quantity > 20 + 10 * (l_returnflag = 'R')::int)::int as y from lineitem)
select r, a, round(avg(y), 4) as p from d group by r, a"""
)
def logistic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-04, ML-11: a logistic model of flags that tell groups apart gives each group's share, when the penalty is next to nothing."""
    flag = F.col("l_returnflag")
    rows = cut(table(spark, sf_dir, "lineitem").select((flag == "R").cast("int").alias("r"), (flag == "A").cast("int").alias("a"), (F.col("l_quantity") > 20 + 10 * (flag == "R").cast("int")).cast("int").alias("y")))
    fitted = models.logistic(rows, ["r", "a"], "y", c=1e7, tol=1e-12)
    return fitted.predict(rows).groupBy("r", "a").agg(F.round(F.avg("p"), 4).alias("p"))


@query(
    """with d as (select case when l_tax > 0.04 then 0.7 else 0.4 end as p, (l_quantity > 20 - 10 * (l_tax > 0.04)::int)::int as y from lineitem)
select p as level, round(avg(y), 4) as platt, round(avg(y), 4) as isotonic from d group by p"""
)
def calibrated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-09, ML-10: both calibrators give each of two levels, which stand in the right order, its share."""
    high = F.col("l_tax") > 0.04
    rows = cut(table(spark, sf_dir, "lineitem").select(F.when(high, 0.7).otherwise(0.4).alias("p"), (F.col("l_quantity") > 20 - 10 * high.cast("int")).cast("int").alias("y")))
    levels = rows.select("p").distinct().withColumn("level", F.col("p"))
    for name, fit in (("platt", models.Platt()), ("isotonic", models.Isotonic())):
        levels = fit.fit(rows).apply(levels).withColumn(name, F.round("p", 4)).withColumn("p", F.col("level"))
    return levels.select("level", "platt", "isotonic")


@query(
    """with d as (select o_orderpriority as g, (o_totalprice > 150000)::int as y, o_orderkey % 3 as w from orders), s as (select w, g, avg(y) as p from d group by w, g)
select s.w as window_no, s.g as priority, round(s.p, 4) as p, (select round(avg(-(d.y * ln(t.p) + (1 - d.y) * ln(1 - t.p))), 4) from d join s t on t.g = d.g and t.w = s.w where d.w = s.w) as log_loss from s"""
)
def batched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP-05, EXP-07: models of several windows fitted in one pass, each with the shares of its own groups; scored in one pass."""
    orders = table(spark, sf_dir, "orders")
    priorities = sorted(r[0] for r in orders.select("o_orderpriority").distinct().collect())  # a dimension
    flags = {f"g{k}": (F.col("o_orderpriority") == p).cast("double") for k, p in enumerate(priorities[1:])}
    rows = cut(orders.select("o_orderpriority", (F.col("o_orderkey") % 3).alias("w"), (F.col("o_totalprice") > 150000).cast("int").alias("y"), *[c.alias(n) for n, c in flags.items()]))
    windows = [(F.col("w") == k, F.lit(False), F.col("w") == k) for k in range(3)]
    found = batch.fit(rows, "y", windows, [batch.Candidate("all", list(flags), 1e7)], ("o_orderpriority",))
    losses = [(k, own["log_loss"]) for k, own in enumerate(found.scores()[0])]
    shares = found.predictions().groupBy(F.col("window").cast("long").alias("window_no"), F.col("o_orderpriority").alias("priority")).agg(F.round(F.avg("p"), 4).alias("p"))
    return shares.join(F.broadcast(spark.createDataFrame(losses, "window_no long, log_loss double")), "window_no").select("window_no", "priority", "p", F.round("log_loss", 4).alias("log_loss"))  # a row a window


# --- streams ---------------------------------------------------------------------------------------------------------


@query(
    f"with {APPS}, {RECORD_LONG}, {LAYOFF_LONG} select r.fight_id, r.side, r.prior_fights, r.prior_wins, r.prior_losses, r.prior_win_pct, r.wins_last_3, r.win_pct_last_3, r.wins_last_5, r.win_pct_last_5, l.days_since_last_fight, l.layoff_days, l.layoff_missing, l.log_layoff_days, l.long_layoff from rec2 r join lay2 l on l.fight_id = r.fight_id and l.side = r.side"
)
def streamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-01: a stream's history as keyed state, begun from the first half of the table and fed with the rest, gives what the windows give."""
    long = cut(B.appearances(spark, sf_dir))
    middle = long.agg(F.percentile_approx(F.datediff("date", F.lit("1970-01-01").cast("date")), 0.5)).first()[0]
    early = F.datediff("date", F.lit("1970-01-01").cast("date")) <= middle
    base = fresh(spark, "history")
    long.filter(~early).write.parquet(f"{base}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.PROVIDER)
    try:
        stream = state.running_features(spark.readStream.schema(long.schema).parquet(f"{base}/in"), state.start_state(long.filter(early)))
        columns = ["fight_id", "side", *history.RECORD, *history.FORM, "days_since_last_fight", "layoff_days", "layoff_missing", "log_layoff_days", "long_layoff"]
        run = stream.select(*columns).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    first = history.layoff(history.activity(history.form(history.record(long.filter(early)))))
    return spark.read.parquet(f"{base}/out").select(*columns).unionByName(first.select(*columns))


# --- events and the live report --------------------------------------------------------------------------------------

EVENT_DAY = date(2024, 1, 20)


@query(
    f"""with {B.BOUTS_SQL}, ev as (select *, row_number() over (order by fight_id) as row_index from bouts where date = date '{EVENT_DAY}'),
act as (select *, case when a_id % 3 > 0 then '' when a_id % 10 = 0 then 'a_blocked_ambiguous_name' else '' end as a_bad, case when b_id % 3 > 0 then '' when b_id % 10 = 0 then 'b_blocked_ambiguous_name' else '' end as b_bad from ev),
r as (select *, array_to_string(list_filter([a_bad, b_bad, case when fight_id % 7 = 0 then 'undecided' else '' end, case when fight_id % 11 = 0 then 'no_length' else '' end], lambda x: x <> ''), ',') as reasons,
 row_number() over (partition by case when a_bad = '' and b_bad = '' then least(a_id, b_id) || '|' || greatest(a_id, b_id) else 'row ' || row_index end order by row_index) > 1 as again from act)
select row_index::int as row_index, reasons, case when reasons <> '' then 'blocked' when again then 'already_stored' else 'append' end as decision from r"""
)
def event_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-05, IDN-07, SNK-05: what an apply of a day's bouts to the versioned table of those before would do."""
    bouts = B.bouts(spark, sf_dir)
    store = versioned.begin(spark, fresh(spark, "rated"), rating.elo_by_league(bouts.filter(F.col("date") < EVENT_DAY)))
    side = lambda c: (F.concat(F.lit("User "), c), F.concat(F.lit("http://x/fighter-details/u"), c))
    nth = F.row_number().over(Window.orderBy("fight_id"))  # one day's bouts
    (an, au), (bn, bu) = side("a_id"), side("b_id")
    card = bouts.filter(F.col("date") == EVENT_DAY).select(nth.alias("row_index"), F.col("fight_id").cast("string").alias("fight_key"), an.alias("a_name"), au.alias("a_url"), bn.alias("b_name"), bu.alias("b_url"), F.when(F.col("fight_id") % 7 > 0, "win").otherwise("draw").alias("result"), F.when(F.col("fight_id") % 11 > 0, 5.0).alias("minutes"), "a_won")
    users = bouts.select(F.explode(F.array("a_id", "b_id")).alias("entity")).distinct()
    known = users.select("entity", F.when(F.col("entity") % 3 > 0, F.concat(F.lit("u"), "entity")).alias("slug"), F.concat(F.lit("user "), "entity").alias("name_key"))
    twins = known.filter(F.col("entity") % 10 == 0).select((F.col("entity") + 1_000_000).alias("entity"), F.lit(None).cast("string").alias("slug"), "name_key")
    event = spark.createDataFrame([("event_detail", "Event", EVENT_DAY, "e1")], applying.EVENT)
    ready = applying.plan(store, event, card, known.unionByName(twins))
    return ready.bouts.select("row_index", F.array_join("reasons", ",").alias("reasons"), "decision")


def _rolling_sql(size: int) -> str:
    frame = f"(order by date, fight_id rows between {size - 1} preceding and current row)"
    return f"case when nth >= {size} then avg(loss) over {frame} end as log_loss_{size}, case when nth >= {size} then avg(hit) over {frame} end as accuracy_{size}"


@query(
    f"""with {B.BOUTS_SQL}, r as (select date, fight_id, case when a_won = 1 then -ln((a_id % 10 + 0.5) / 10) else -ln(1 - (a_id % 10 + 0.5) / 10) end as loss, (((a_id % 10 + 0.5) / 10 >= 0.5)::int = a_won)::int as hit, row_number() over (order by date, fight_id) as nth from bouts)
select fight_id as seq, {_rolling_sql(50)}, {_rolling_sql(100)} from r"""
)
def live_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-10: rolling figures of a live ledger's resolved predictions."""
    rows = B.bouts(spark, sf_dir).select(F.col("date").alias("event_date"), F.concat(F.lit("E"), F.col("date").cast("string")).alias("event_name"), F.col("fight_id").alias("seq"), F.lit("resolved").alias("status"), F.col("a_won").alias("target_a_win"), ((F.col("a_id") % 10 + 0.5) / 10).alias("predicted_probability_a"), F.lit("v1").alias("model_version"))
    return ledger.live_report(rows)["rolling"].select("seq", *[f"{n}_{s}" for s in (50, 100) for n in ("log_loss", "accuracy")])
