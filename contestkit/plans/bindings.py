"""How the operators' generic tables are bound to the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestkit.session import table

STATS = ("minutes", "kd", "sl", "sa", "tdl", "tda", "sub", "ctrl")


def corners(events: DataFrame) -> DataFrame:
    """Even and odd event of each pair as structs a and b; one shuffle, no self-join."""
    side = F.struct("user_id", "value", "event_type", "ts", F.get_json_object("props", "$.k").try_cast("int").alias("k"), "event_id")
    pick = lambda odd: F.max(F.when(F.col("event_id") % 2 == odd, side))
    pairs = events.groupBy(F.expr("event_id div 2").alias("fight_id")).agg(pick(0).alias("a"), pick(1).alias("b"))
    return pairs.filter("a.user_id <> b.user_id and a.value <> b.value").withColumn("date", F.col("a.ts").cast("date"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fight_id, date, a_id, b_id, a_won: consecutive events of two users, the larger value wins."""
    return corners(table(spark, sf_dir, "events")).select("fight_id", "date", F.col("a.user_id").alias("a_id"), F.col("b.user_id").alias("b_id"), (F.col("a.value") > F.col("b.value")).cast("int").alias("a_won"))


BOUTS_SQL = """bouts as (select a.event_id // 2 as fight_id, cast(a.ts as date) as date, a.user_id as a_id, b.user_id as b_id,
  case when a.value > b.value then 1 else 0 end as a_won from events a join events b on b.event_id = a.event_id + 1
  where a.event_id % 2 = 0 and a.user_id <> b.user_id and a.value <> b.value)"""


def _stat_line(side: str) -> F.Column:
    """Statistics of one side from its event; error events have none."""
    e = F.col(side)
    k = F.coalesce(e["k"], F.lit(0))
    line = F.struct(
        (1.0 + k % 15).alias("minutes"), (k % 7 == 0).cast("double").alias("kd"), F.floor(F.abs(e["value"])).cast("double").alias("sl"), (F.floor(F.abs(e["value"])) + k).cast("double").alias("sa"),
        (k % 5).cast("double").alias("tdl"), (k % 5 + e["event_id"] % 3).cast("double").alias("tda"), F.when(e["event_type"] != "view", (k % 3).cast("double")).alias("sub"), (k * 2.0).alias("ctrl"),
    )
    return F.when(e["event_type"] != "error", line)


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a bout: fight_id, date, side, entity, opponent, won, own and opponent's statistics (opp_)."""
    pairs = corners(table(spark, sf_dir, "events")).withColumn("sa", _stat_line("a")).withColumn("sb", _stat_line("b"))
    won = (F.col("a.value") > F.col("b.value")).cast("int")
    row = lambda s, o, w: F.struct(F.lit(s).alias("side"), F.col(f"{s}.user_id").alias("entity"), F.col(f"{o}.user_id").alias("opponent"), w.alias("won"), F.col(f"s{s}").alias("own"), F.col(f"s{o}").alias("opp"))
    long = pairs.select("fight_id", "date", F.explode(F.array(row("a", "b", won), row("b", "a", 1 - won))).alias("r"))
    return long.select("fight_id", "date", "r.side", "r.entity", "r.opponent", "r.won", F.col("r.own").isNotNull().alias("has_stats"), F.col("r.opp").isNotNull().alias("opp_has_stats"), *[F.col(f"r.own.{c}").alias(c) for c in STATS], *[F.col(f"r.opp.{c}").alias(f"opp_{c}") for c in STATS])


def appearances_sql() -> str:
    k = "coalesce(cast(json_extract_string({s}.props, '$.k') as int), 0)"
    values = {
        "minutes": f"1.0 + {k} % 15", "kd": f"case when {k} % 7 = 0 then 1.0 else 0.0 end", "sl": "floor(abs({s}.value))", "sa": f"floor(abs({{s}}.value)) + {k}",
        "tdl": f"{k} % 5", "tda": f"{k} % 5 + {{s}}.event_id % 3", "sub": f"case when {{s}}.event_type <> 'view' then {k} % 3 end", "ctrl": f"{k} * 2.0",
    }
    line = lambda s, p: ", ".join(f"cast(case when {s}.event_type <> 'error' then {v.format(s=s)} end as double) as {p}{c}" for c, v in values.items())
    won = "case when a.value > b.value then 1 else 0 end"
    one = lambda s, o, w: f"select a.event_id // 2 as fight_id, cast(a.ts as date) as date, '{s}' as side, {s}.user_id as entity, {o}.user_id as opponent, {w} as won, {s}.event_type <> 'error' as has_stats, {o}.event_type <> 'error' as opp_has_stats, {line(s, '')}, {line(o, 'opp_')} from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 2 = 0 and a.user_id <> b.user_id and a.value <> b.value"
    return f"apps as ({one('a', 'b', won)} union all {one('b', 'a', f'1 - ({won})')})"


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way prices: event = order, book = supplier % 11, observed = ship date, and the order's cutoff 60 days on."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("event_id"), F.concat(F.lit("book"), F.col("l_suppkey") % 11).alias("book"), F.col("l_linenumber").alias("snapshot_id"), F.col("l_shipdate").alias("observed"),
        F.date_add(F.col("o_orderdate").cast("date"), 60).cast("timestamp_ntz").alias("cutoff"), F.date_add(F.col("o_orderdate").cast("date"), 90).cast("timestamp_ntz").alias("starts"),
        (1 + F.col("l_quantity") / 25.0).alias("price_a"), (1 + 25.0 / F.col("l_quantity") + F.col("l_discount")).alias("price_b"), (F.col("l_returnflag") != "N").alias("approved"),
    )


QUOTES_SQL = """quotes as (select l_orderkey as event_id, 'book' || (l_suppkey % 11) as book, l_linenumber as snapshot_id, l_shipdate as observed,
  cast(cast(o_orderdate as date) + 60 as timestamp) as cutoff, cast(cast(o_orderdate as date) + 90 as timestamp) as starts,
  1 + l_quantity / 25.0 as price_a, 1 + 25.0 / l_quantity + l_discount as price_b, l_returnflag <> 'N' as approved from lineitem join orders on l_orderkey = o_orderkey)"""
