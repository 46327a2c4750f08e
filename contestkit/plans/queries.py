"""Queries over the driver's tables, one or more per operator family, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestkit.functions import numeric as N
from contestkit.functions import parse as P
from contestkit.functions import text as T
from contestkit.operators import filters, history, identity, ledger, matchup, metrics, quotes, rating, splits
from contestkit.plans import bindings as B
from contestkit.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

APPS = B.appearances_sql()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sides(columns: tuple[str, ...]) -> str:
    """SQL for the wide form of long columns: _a, _b and their difference."""
    part = lambda c, s: f"max(case when side = '{s}' then {c} end)"
    return ", ".join(f"{part(c, 'a')} as {c}_a, {part(c, 'b')} as {c}_b, {part(c, 'a')} - {part(c, 'b')} as {c}_diff" for c in columns)


WIDE_KEYS = "fight_id, date, max(case when side = 'a' then entity end) as a_id, max(case when side = 'a' then opponent end) as b_id, max(case when side = 'a' then won end) as a_won"
W_ENTITY = "partition by entity order by date, fight_id"
BEFORE = f"({W_ENTITY} rows between unbounded preceding and 1 preceding)"

RECORD_LONG = f"""rec as (select *, count(*) over {BEFORE} as prior_fights, coalesce(sum(won) over {BEFORE}, 0) as prior_wins,
 coalesce(sum(won) over ({W_ENTITY} rows between 3 preceding and 1 preceding), 0) as wins_last_3, avg(cast(won as double)) over ({W_ENTITY} rows between 3 preceding and 1 preceding) as win_pct_last_3,
 coalesce(sum(won) over ({W_ENTITY} rows between 5 preceding and 1 preceding), 0) as wins_last_5, avg(cast(won as double)) over ({W_ENTITY} rows between 5 preceding and 1 preceding) as win_pct_last_5 from apps),
rec2 as (select *, prior_fights - prior_wins as prior_losses, case when prior_fights > 0 then prior_wins::double / prior_fights end as prior_win_pct from rec)"""


@query(f"with {APPS}, {RECORD_LONG} select {WIDE_KEYS}, {sides((*history.RECORD, *history.FORM))} from rec2 group by fight_id, date")
def history_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03, WIN-04, WIN-12, PRJ-01: what both sides had done before each bout."""
    long = B.appearances(spark, sf_dir).select("fight_id", "date", "side", "entity", "opponent", "won")
    return history.to_bouts(history.form(history.record(long)), (*history.RECORD, *history.FORM))


LAYOFF_LONG = f"""lay as (select *, date - lag(date) over ({W_ENTITY}) as days_since_last_fight,
 (date - date '1970-01-01') - max(date - date '1970-01-01') over (partition by entity order by date - date '1970-01-01' range between unbounded preceding and 1 preceding) as layoff_days from apps),
lay2 as (select *, cast(layoff_days is null as int) as layoff_missing, ln(1 + layoff_days) as log_layoff_days, cast(layoff_days < 60 as int) as short_turnaround, cast(layoff_days >= 365 as int) as long_layoff, cast(layoff_days >= 730 as int) as extreme_layoff from lay)"""


@query(f"with {APPS}, {LAYOFF_LONG} select {WIDE_KEYS}, {sides(('days_since_last_fight', *history.LAYOFF))} from lay2 group by fight_id, date")
def history_layoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05 to WIN-07: days since the last bout and since the last earlier day, and functions of them."""
    long = B.appearances(spark, sf_dir).select("fight_id", "date", "side", "entity", "opponent", "won")
    return history.to_bouts(history.layoff(history.activity(long)), ("days_since_last_fight", *history.LAYOFF))


_M = "coalesce(nullif(minutes, 0), opp_minutes, 0.0)"
_SUM = lambda c: f"coalesce(sum(case when use then {_M if c == 'minutes' else f'coalesce({c}, 0.0)'} end) over {BEFORE}, 0.0) as t_{c}"
_PER = lambda c, m: f"case when t_minutes > 0 then t_{c} / t_minutes * {m} end"
_CONTROL = lambda c: f"case when t_minutes > 0 then t_{c} / 60 / t_minutes * 15 end"
_SHARE = lambda a, b: f"case when t_minutes > 0 and t_{b} > 0 then t_{a} / t_{b} end"
RATES_LONG = f"""use1 as (select *, has_stats and opp_has_stats and {_M} > 0 as use from apps),
sums as (select *, {", ".join(_SUM(c) for c in history.SUMMED)}, count(case when use then 1 end) over {BEFORE} as t_n from use1),
rates as (select fight_id, date, side, entity, opponent, won, {_PER('sl', 1)} as sig_strikes_landed_per_min, {_PER('opp_sl', 1)} as sig_strikes_absorbed_per_min, {_PER('sl', 1)} - {_PER('opp_sl', 1)} as sig_strike_differential,
 {_SHARE('sl', 'sa')} as striking_accuracy, 1 - {_SHARE('opp_sl', 'opp_sa')} as striking_defense, {_PER('kd', 15)} as knockdown_rate, {_PER('tdl', 15)} as takedowns_per_15, {_SHARE('tdl', 'tda')} as takedown_accuracy,
 1 - {_SHARE('opp_tdl', 'opp_tda')} as takedown_defense, {_CONTROL('ctrl')} as control_time_per_15, {_PER('sub', 15)} as submission_attempts_per_15,
 {_PER('opp_tdl', 15)} as takedowns_allowed_per_15, {_PER('opp_tda', 15)} as opp_takedown_attempts_per_15, {_PER('opp_sa', 1)} as opp_sig_str_attempted_per_min, {_CONTROL('opp_ctrl')} as control_time_absorbed_per_15,
 {_PER('opp_kd', 15)} as knockdowns_absorbed_per_15, {_PER('opp_sub', 15)} as submission_attempts_absorbed_per_15, cast(t_n = 0 or t_minutes <= 0 as int) as no_prior_stats from sums)"""


@query(f"with {APPS}, {RATES_LONG} select {WIDE_KEYS}, {sides((*history.ROLLING, *history.AGAINST, 'no_prior_stats'))} from rates group by fight_id, date")
def rolling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08 to WIN-10, JOIN-06: rates over all earlier bouts, for and against."""
    return history.to_bouts(history.rates(B.appearances(spark, sf_dir)), (*history.ROLLING, *history.AGAINST, "no_prior_stats"))


def _net(x: str, y: str) -> str:
    m = lambda c, s: f"max(case when side = '{s}' then {c} end)"
    return f"({m(x, 'a')} - {m(y, 'b')}) - ({m(x, 'b')} - {m(y, 'a')})"


_S = lambda c, s: f"max(case when side = '{s}' then {c} end)"
_L, _D, _A, _AL = "sig_strikes_landed_per_min", "takedowns_per_15", "sig_strikes_absorbed_per_min", "takedowns_allowed_per_15"


@query(
    f"with {APPS}, {RATES_LONG} select fight_id, "
    + ", ".join(f"{_net(x, y)} as {n}" for n, (x, y) in matchup.NETS.items())
    + f", (({_S(_L, 'a')} + {_S(_D, 'a')}) - ({_S(_L, 'b')} + {_S(_D, 'b')})) as pace_pressure_advantage, (({_S(_A, 'b')} + {_S(_AL, 'b')}) - ({_S(_A, 'a')} + {_S(_AL, 'a')})) as opponent_pressure_absorption_advantage, max(no_prior_stats) as matchup_history_missing from rates group by fight_id"
)
def matchup_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02: net advantages of one side's rates over the other's."""
    wide = history.to_bouts(history.rates(B.appearances(spark, sf_dir)), (*history.ROLLING, *history.AGAINST, "no_prior_stats"), diffs=False)
    out = matchup.matchup(wide)
    return out.select("fight_id", *matchup.NETS, "pace_pressure_advantage", "opponent_pressure_absorption_advantage", "matchup_history_missing")


ELO_SQL = f"""with recursive {B.BOUTS_SQL}, o as (select *, row_number() over (order by date, fight_id) as n from bouts),
step as (select 0::bigint as n, null::bigint as fight_id, null::bigint as a_id, null::bigint as b_id, null::int as a_won, null::date as date, null::double as a_pre, null::double as b_pre, map([]::bigint[], []::double[]) as st
 union all
 select q.n, q.fight_id, q.a_id, q.b_id, q.a_won, q.date, q.ra, q.rb,
  map_concat(q.st, map([q.a_id, q.b_id], [q.ra + 32 * (q.a_won - q.e), q.rb + 32 * ((1 - q.a_won) - (1 - q.e))])) from
  (select r.*, 1 / (1 + power(10.0::double, (r.rb - r.ra) / 400)) as e from (select o.n, o.fight_id, o.a_id, o.b_id, o.a_won, o.date, s.st, coalesce(s.st[o.a_id], 1500.0::double) as ra, coalesce(s.st[o.b_id], 1500.0::double) as rb from step s join o on o.n = s.n + 1) r) q),
snap as (select fight_id, date, a_id, b_id, a_won, a_pre, b_pre, 1 / (1 + power(10.0::double, (b_pre - a_pre) / 400)) as e from step where n > 0)"""


@query(ELO_SQL + " select fight_id, a_id, b_id, a_pre as a_pre, b_pre as b_pre, e as a_expected, (a_pre + 32 * (a_won - e)) as a_post, (b_pre + 32 * ((1 - a_won) - (1 - e))) as b_post from snap")
def elo_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: ratings before and after each bout."""
    return rating.elo(B.bouts(spark, sf_dir)).select("fight_id", "a_id", "b_id", "a_pre", "b_pre", "a_expected", "a_post", "b_post")


@query(
    ELO_SQL
    + """, long as (select date, fight_id, a_id as entity, a_won as won, a_pre + 32 * (a_won - e) as rating from snap union all select date, fight_id, b_id, 1 - a_won, b_pre + 32 * ((1 - a_won) - (1 - e)) from snap),
last as (select *, row_number() over (partition by entity order by date desc, fight_id desc) as n from long)
select entity, count(*) as fights, cast(sum(won) as bigint) as wins, cast(count(*) - sum(won) as bigint) as losses, max(date) as last_date, max(case when n = 1 then rating end) as rating from last group by entity"""
)
def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, WIN-01, SET-01: record and latest rating of every entity."""
    return rating.standings(rating.elo_by_league(B.bouts(spark, sf_dir)))


@query(
    ELO_SQL
    + """ select s.fight_id, ca.c_name as a_name, cb.c_name as b_name, w.c_name as winner_name, s.e as a_expected from snap s join customer ca on ca.c_custkey = s.a_id join customer cb on cb.c_custkey = s.b_id
left join customer w on w.c_custkey = case when s.a_won = 1 then s.a_id else s.b_id end"""
)
def elo_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01, JOIN-02, SNK-08: snapshots with both sides' and the winner's names."""
    bouts = B.bouts(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    out = rating.baseline(rating.elo(bouts), bouts, names)
    return out.select("fight_id", "a_name", "b_name", "winner_name", "a_expected")


@query("select user_id, event_id, event_type, value as value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, WIN-13: newest row per key as a partial maximum."""
    return history.latest(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), ("event_id", "event_type", "value"))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: first row of equal keys."""
    return history.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ("user_id", "event_type"), ("event_id",))


PRED = f"""{RECORD_LONG}, wide as (select fight_id, date, max(case when side = 'a' then won end) as y, max(case when side = 'a' then (prior_wins + 1.0) / (prior_fights + 2) end) as sa, max(case when side = 'b' then (prior_wins + 1.0) / (prior_fights + 2) end) as sb from rec2 group by fight_id, date),
pred as (select fight_id, date, y, sa / (sa + sb) as p, 'm' as model from wide),
ll as (select *, case when y = 1 then -ln(greatest(1e-6, least(1 - 1e-6, p))) else -ln(1 - greatest(1e-6, least(1 - 1e-6, p))) end as row_ll, (p - y) * (p - y) as row_br, cast(cast(p >= 0.5 as int) = y as int)::double as hit from pred)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fight_id, date, y, p, model: smoothed records against each other."""
    long = B.appearances(spark, sf_dir).select("fight_id", "date", "side", "entity", "opponent", "won")
    wide = history.to_bouts(history.record(long), ("prior_fights", "prior_wins"), diffs=False)
    s = lambda x: (F.col(f"prior_wins_{x}") + 1.0) / (F.col(f"prior_fights_{x}") + 2)
    return wide.select("fight_id", "date", F.col("a_won").alias("y"), (s("a") / (s("a") + s("b"))).alias("p"), F.lit("m").alias("model"))


@query(
    f"with {APPS}, {PRED} select fight_id, case when count(*) over w >= 50 then avg(row_ll) over w end as log_loss_50, case when count(*) over w >= 50 then avg(hit) over w end as accuracy_50, case when count(*) over w >= 50 then 'ok' else 'insufficient_sample' end as status_50 from ll window w as (order by date, fight_id rows between 49 preceding and current row)"
)
def trailing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11, NUM-05: means over the last 50 predictions of a model."""
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")
    out = history.trailing(predictions(spark, sf_dir), {"log_loss": N.log_loss(F.col("p"), F.col("y")), "accuracy": hit}, 50)
    return out.select("fight_id", "log_loss_50", "accuracy_50", "status_50")


def _spine(edges: tuple[float, ...], name: str) -> str:
    return f"edges as (select * from (values {', '.join(f'({k}, {a!r}::double, {b!r}::double)' for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))}) t(bucket_no, lo, hi))" if name else ""


def _buckets(edges: tuple[float, ...], source: str = "ll") -> str:
    return f"""select e.bucket_no, count(p) as n, avg(p) as mean_p, avg(y) as mean_y, avg(p) - avg(y) as gap, avg(row_ll) as log_loss, avg(row_br) as brier
 from edges e left join {source} on p >= lo and (p < hi or (e.bucket_no = {len(edges) - 2} and p <= hi)) group by e.bucket_no"""


@query(f"with {APPS}, {PRED}, {_spine(metrics.TENTHS, 'x')} {_buckets(metrics.TENTHS)}")
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05: ten buckets with gaps, empty ones too."""
    return metrics.calibration_table(predictions(spark, sf_dir)).drop("bucket")


@query(f"with {APPS}, {PRED}, {_spine(metrics.EIGHTHS, 'x')} {_buckets(metrics.EIGHTHS)}")
def replay_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: the replay's eight buckets."""
    return metrics.calibration_table(predictions(spark, sf_dir), metrics.EIGHTHS).drop("bucket")


FAVOUR = "fav as (select greatest(p, 1 - p) as p, case when p >= 0.5 then y else 1 - y end as y, row_ll, row_br from ll)"


@query(f"with {APPS}, {PRED}, {FAVOUR}, {_spine(metrics.CONFIDENCE, 'x')} {_buckets(metrics.CONFIDENCE, 'fav')}")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07: buckets of the favoured side's probability."""
    return metrics.calibration_table(predictions(spark, sf_dir), metrics.CONFIDENCE, confidence=True).drop("bucket")


@query(
    f"with {APPS}, {PRED}, {FAVOUR} "
    + " union all ".join(f"select {t}::double as threshold, '{s}' as side, count(case when p > {t} then 1 end) as n, avg(case when p > {t} then p end) as mean_p, avg(case when p > {t} then y end) as mean_y from {src}" for s, src in (("one", "ll"), ("two", "fav")) for t in (0.55, 0.6, 0.7))
)
def high_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08, AGG-09: above thresholds, one-sided and two-sided."""
    rows = predictions(spark, sf_dir)
    one, two = (metrics.high_confidence(rows, (0.55, 0.6, 0.7), two_sided=t).withColumn("side", F.lit(n)) for t, n in ((False, "one"), (True, "two")))
    return one.unionByName(two).select("threshold", "side", "n", "mean_p", "mean_y")


@query(
    f"""with {APPS}, {PRED}, r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk from ll)
select count(*) as n, avg(hit) as accuracy, avg(row_ll) as log_loss, avg(row_br) as brier, avg(p) as mean_p, avg(y) as mean_y,
 ((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))) as auc from r"""
)
def metrics_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, MET-01, MET-04: accuracy, log loss, Brier score, means and the area under the curve."""
    return metrics.bundle(predictions(spark, sf_dir))


@query(f"with {APPS}, {PRED}, {_spine(metrics.TENTHS, 'x')}, t as ({_buckets(metrics.TENTHS)}) select sum(n * abs(gap)) / sum(n) as ece from t")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: expected calibration error."""
    return metrics.calibration_error(predictions(spark, sf_dir))


@query(f"with {APPS}, {PRED} select date, count(*) as n, avg(hit) as accuracy, avg(row_ll) as log_loss, avg(row_br) as brier, avg(p) as mean_p, avg(y) as mean_y from ll group by date")
def metrics_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: the bundle per day; months and years are other keys."""
    return metrics.evaluate(predictions(spark, sf_dir), ("date",))


COVERED = ("striking_accuracy", "takedown_defense", "knockdown_rate")


@query(f"with {APPS}, {RATES_LONG} " + " union all ".join(f"select '{c}' as feature, count({c}) as present, (count({c})::double / count(*)) as coverage from rates" for c in COVERED))
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: share of rows with a value."""
    return metrics.coverage(history.rates(B.appearances(spark, sf_dir)), COVERED)


DRIFTED = ("prior_fights", "prior_win_pct", "win_pct_last_3")


@query(
    f"with {APPS}, {RECORD_LONG}, tr as (select * from rec2 where date < date '2024-01-20'), ev as (select * from rec2 where date >= date '2024-01-20') "
    + " union all ".join(
        f"""select '{c}' as feature, avg(({c} is null)::int) as missing_event, max((select avg(({c} is null)::int) from tr)) as missing_train, avg({c}) - max((select avg({c}) from tr)) as mean_shift,
 ((avg({c}) - max((select avg({c}) from tr))) / nullif(max((select stddev_pop({c}) from tr)), 0)) as z_shift, count(case when {c} < (select min({c}) from tr) or {c} > (select max({c}) from tr) then 1 end) as out_of_range from ev"""
        for c in DRIFTED
    )
)
def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: late rows against earlier ones."""
    long = history.form(history.record(B.appearances(spark, sf_dir).select("fight_id", "date", "side", "entity", "opponent", "won")))
    late = F.col("date") >= date(2024, 1, 20)
    out = metrics.drift(long.filter(~late), long.filter(late), DRIFTED)
    return out.select("feature", "missing_event", "missing_train", "mean_shift", "z_shift", "out_of_range")


NTH = "o as (select *, row_number() over (order by date, fight_id) - 1 as i, count(*) over () as n from bouts)"


@query(f"with {B.BOUTS_SQL}, {NTH} select fight_id, case when i < round_even(n * 0.8, 0) then 'train' else 'test' end as split from o")
def split_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01, SRT-03: chronological split by share."""
    return splits.two_way(B.bouts(spark, sf_dir)).select("fight_id", "split")


@query(f"with {B.BOUTS_SQL}, {NTH} select case when i < round_even(n * 0.7, 0) then 'train' when i < round_even(n * 0.85, 0) then 'calibration' else 'test' end as split, count(*) as n, min(date) as first_date, max(date) as last_date from o group by 1")
def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04, AGG-19: three parts and their extents."""
    return splits.three_way(B.bouts(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(
    f"with {B.BOUTS_SQL}, {NTH} "
    + " union all ".join(f"select {k} as fold, count(case when i < round_even(n * {a}, 0) then 1 end) as fit, count(case when i >= round_even(n * {a}, 0) and i < round_even(n * {b}, 0) then 1 end) as calibration, count(case when i >= round_even(n * {b}, 0) and i < round_even(n * {c}, 0) then 1 end) as validation from o" for k, (a, b, c) in enumerate(splits.FOLDS))
)
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05: sizes of the expanding folds."""
    out = None
    for k, parts in enumerate(splits.folds(B.bouts(spark, sf_dir))):
        row = None
        for name, rows in zip(("fit", "calibration", "validation"), parts, strict=True):
            one = rows.agg(F.count("*").alias(name))
            row = one if row is None else row.crossJoin(F.broadcast(one))  # one row each
        row = row.select(F.lit(k).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {B.BOUTS_SQL} select fight_id, case when date < date '2024-01-25' - 10 then 'train' else 'calibration' end as split from bouts where date <= date '2024-01-25'")
def live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06, FLT-05, DAT-05, INC-09: rows up to a day, the last ten days apart."""
    return splits.live_window(B.bouts(spark, sf_dir), date(2024, 1, 25), 10).select("fight_id", "split")


@query(f"with {B.BOUTS_SQL}, d as (select date, count(*) as n from bouts group by date), p as (select date, n, coalesce(sum(n) over (order by date rows between unbounded preceding and 1 preceding), 0) as prior from d) select date, n, cast(prior as bigint) as prior, cast(greatest(prior - 30, 0) as bigint) as train_n, prior >= 130 as ready from p")
def replay_cut_offs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15: how many earlier bouts train and calibrate each day."""
    return history.cut_offs(B.bouts(spark, sf_dir), 100, 30)


RAW_SQL = """raw as (select event_id as source_row_id, case when event_id % 17 = 0 then 'junk' when event_id % 3 = 0 then strftime(ts, '%b %-d, %Y') else strftime(ts, '%Y-%m-%d') end as d, cast(ts as date) as day0, event_id % 17 <> 0 as good_day,
 case when event_id % 13 = 0 then ' ' else ' User  ' || (user_id % 40) end as fa, 'user ' || (event_id % 40) as fb, case when value > 50 then 'USER ' || (user_id % 40) when value > 10 then 'User ' || (event_id % 40) else 'Draw' end as w from events),
keyed as (select *, trim(lower(regexp_replace(fa, '\\s+', ' ', 'g'))) as ka, trim(lower(fb)) as kb, trim(lower(w)) as kw from raw),
judged as (select *, case when ka = '' or kb = '' or ka = kb then 'bad_name' when not good_day then 'bad_date' when kw <> ka and kw <> kb then 'undecided' end as reason from keyed),
firsts as (select day0, ka, kb, min(source_row_id) as first_id from judged where reason is null group by all)"""


def raw_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy text bouts made of events."""
    e = table(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 17 == 0, "junk").when(F.col("event_id") % 3 == 0, F.date_format("ts", "MMM d, yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    a = F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.concat(F.lit(" User  "), F.col("user_id") % 40))
    winner = F.when(F.col("value") > 50, F.concat(F.lit("USER "), F.col("user_id") % 40)).when(F.col("value") > 10, F.concat(F.lit("User "), F.col("event_id") % 40)).otherwise("Draw")
    return e.select(F.col("event_id").alias("source_row_id"), day.alias("date"), a.alias("fighter_a"), F.concat(F.lit("user "), F.col("event_id") % 40).alias("fighter_b"), winner.alias("winner"))


@query(f"with {RAW_SQL} select j.source_row_id, j.day0 as date, 'User ' || substr(j.ka, 6) as fighter_a, j.fb as fighter_b, case when j.kw = j.ka then 1 else 0 end as a_won from judged j join firsts f on f.day0 = j.day0 and f.ka = j.ka and f.kb = j.kb and f.first_id = j.source_row_id where reason is null")
def clean_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01 to FLT-03, WIN-14, STR-01, STR-02, PRS-09: cleaned bouts."""
    return filters.clean_bouts(raw_bouts(spark, sf_dir))[0]


@query(
    f"""with {RAW_SQL}, m as (select j.*, case when reason is not null then reason when f.first_id <> j.source_row_id then 'duplicate' end as r from judged j left join firsts f on f.day0 = j.day0 and f.ka = j.ka and f.kb = j.kb)
select count(*) as rows, count(case when r = 'bad_name' then 1 end) as bad_name, count(case when r = 'bad_date' then 1 end) as bad_date, count(case when r = 'undecided' then 1 end) as undecided, count(case when r = 'duplicate' then 1 end) as duplicate, count(case when r is null then 1 end) as kept from m"""
)
def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01 to FLT-04: what cleaning drops, in one aggregation."""
    return filters.clean_bouts(raw_bouts(spark, sf_dir))[1]


@query(
    r"""select p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) as display_name, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) as name_key, trim(regexp_replace(replace(replace(lower(p_name || ': No. 1'), '.', ''), ':', ''), '[^a-z0-9]+', ' ', 'g')) as event_key,
 trim(regexp_replace(lower(p_brand) || ' jr', '\s+(jr|sr|ii|iii|iv|v)$', '')) as unsuffixed, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as division_key, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') as division_column, split_part(p_brand, '#', 1) as slug from part"""
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02, STR-03, STR-06, STR-07, STR-10, STR-13."""
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.display_name(c("p_name")).alias("display_name"), T.name_key(c("p_name")).alias("name_key"), T.event_key(F.concat(c("p_name"), F.lit(": No. 1"))).alias("event_key"), T.without_suffix(F.concat(F.lower("p_brand"), F.lit(" jr"))).alias("unsuffixed"),
        T.division_key(c("p_type")).alias("division_key"), T.division_column(c("p_type")).alias("division_column"), T.url_slug(F.concat(F.lit("http://x/y/"), c("p_brand"), F.lit("/"))).alias("slug"),
    )


@query(r"""select doc_id, md5(array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[.''`’]', '', 'g'), '[-_/]', ' ', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda x: x <> ''), ' ')) as folded from documents""")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04, STR-05: accents folded over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded_name(F.col("text"))).alias("folded"))


@query(
    """select l_orderkey, l_linenumber, cast(l_linenumber as int) as landed, cast(l_quantity as int) as attempted, l_linenumber * 60 + 5 as seconds, ((l_linenumber - 1) * 5 + 1.5) as minutes, round((5 * 12 + l_linenumber) * 2.54, 1) as height, round(cast(l_quantity as int) * 2.54, 1) as reach, cast(l_quantity as int)::double as weight,
 cast(l_shipdate as date) as day, round(date_diff('day', date '1970-06-01', cast(l_shipdate as date)) / 365.25, 2) as age from lineitem"""
)
def parsed_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-01 to PRS-10, DAT-01: parsed back from texts."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    day = P.any_date(F.date_format("l_shipdate", "MMMM d, yyyy"))
    pair = P.landed_of_attempted(F.concat_ws(" of ", n, q))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", pair["landed"].alias("landed"), pair["attempted"].alias("attempted"), P.clock_seconds(F.concat(n, F.lit(":05"))).alias("seconds"), F.round(P.fight_minutes(P.round_lengths(F.lit("7 Rnd (5-5-5-5-5-5-5)")), n, F.lit("1:30")), 6).alias("minutes"),
        P.height_cm(F.concat(F.lit("5' "), n, F.lit('"'))).alias("height"), P.reach_cm(F.concat(q, F.lit('"'))).alias("reach"), P.weight_lbs(F.concat(q, F.lit(" lbs."))).alias("weight"), day.alias("day"), P.age_at(F.to_date(F.lit("1970-06-01")), day).alias("age"),
    )


@query(
    f"""with {B.QUOTES_SQL} select event_id, book, snapshot_id, (1 / price_a) as implied_a, ((1 / price_a) / (1 / price_a + 1 / price_b)) as fair_a, (1 / price_a + 1 / price_b) as overround, (ln(greatest(1e-6, least(1 - 1e-6, 1 / price_a)) / (1 - greatest(1e-6, least(1 - 1e-6, 1 / price_a))))) as logit_a,
 case when snapshot_id % 2 = 0 then 1 + snapshot_id * 50 / 100.0 else 1 + 100.0 / (snapshot_id * 50) end as american from quotes"""
)
def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-03, NUM-04, NUM-07 to NUM-10."""
    q = B.quotes(spark, sf_dir)
    a, b = N.implied(F.col("price_a")), N.implied(F.col("price_b"))
    odds = F.when(F.col("snapshot_id") % 2 == 0, F.col("snapshot_id") * 50).otherwise(-F.col("snapshot_id") * 50)
    return q.select("event_id", "book", "snapshot_id", a.alias("implied_a"), N.fair_share(a, b).alias("fair_a"), N.overround(a, b).alias("overround"), N.logit(a).alias("logit_a"), N.american_to_decimal(odds).alias("american"))


@query(
    f"""with {B.QUOTES_SQL}, j as (select *, case when not approved then 'unapproved_sportsbook' when observed > cutoff then 'observation_after_prediction_cutoff' when observed >= starts then 'observation_at_or_after_scheduled_start' when price_a <= 1 or price_b <= 1 then 'invalid_odds' end as reason, (1 / price_a) / (1 / price_a + 1 / price_b) as fair from quotes),
r as (select *, row_number() over (partition by event_id, book order by observed desc, snapshot_id desc) as n from j where reason is null),
s as (select event_id, book, fair, observed from r where n = 1), bk as (select event_id, book, string_agg(distinct reason, '+' order by reason) as reasons from j where reason is not null group by event_id, book),
ex as (select event_id, string_agg(book || ':' || reasons, ';' order by book || ':' || reasons) as excluded from bk group by event_id),
c as (select event_id, median(case when book <> 'book3' then fair end) as m, avg(case when book <> 'book3' then fair end) as a, min(case when book <> 'book3' then fair end) as lo, max(case when book <> 'book3' then fair end) as hi, stddev_pop(case when book <> 'book3' then fair end) as sd, count(case when book <> 'book3' then fair end) as books, max(case when book = 'book3' then fair end) as sharp, max(case when book <> 'book3' then observed end) as newest from s group by event_id)
select e.event_id, m as median_fair, a as mean_fair, lo as min_fair, hi as max_fair, (hi - lo) as range_fair, sd as sd_fair, coalesce(books, 0) as books, coalesce(books, 0) < 3 as coverage_low, (sharp - m) as sharp_minus_broad, newest, coalesce(excluded, '') as excluded
 from (select distinct event_id from quotes) e left join c using (event_id) left join ex using (event_id)"""
)
def asof_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ODD-07, JOIN-15, JOIN-18, AGG-16, AGG-17, FLT-19: consensus of the newest usable quotes."""
    out = quotes.consensus(B.quotes(spark, sf_dir), sharp=("book3",))
    return out.select("event_id", "median_fair", "mean_fair", "min_fair", "max_fair", "range_fair", "sd_fair", "books", "coverage_low", "sharp_minus_broad", "newest", F.array_join("excluded", ";").alias("excluded"))


#: Keys as providers write them: canonical ones, aliases, odd spellings, excluded sources and unknown ones.
PROVIDER_KEYS = (
    "draftkings", "fanduel_us", "betmgm", "williamhill_us", "pointsbetus", "sugarhouse", "espnbet", "pinnacle", "hardrockbet", "bet365_us", "circasports", "DraftKings", " thescore_bet ", "theScore Bet",
    "kalshi", "betfair_exchange", "Smarkets", "sporttrade", "prizepicks", "sleeper_picks", "FLIFF", "an_exchange", "hard_rock_bet",
)


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider payloads made of orders and their lines."""
    key = F.get(F.array(*map(F.lit, PROVIDER_KEYS)), (F.col("l_suppkey") % len(PROVIDER_KEYS)).cast("int"))
    outcome = lambda n, p: F.struct(F.lit(n).alias("name"), p.alias("price"))
    outcomes = F.when(F.col("l_linenumber") == 5, F.array(outcome("A", F.col("l_quantity")))).otherwise(F.array(outcome("A", 1 + F.col("l_quantity") / 25), outcome("B", F.when(F.col("l_linenumber") == 6, F.lit(0.5)).otherwise(F.lit(2.0)))))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    market = F.struct(F.when(F.col("l_linenumber") == 4, "totals").otherwise("h2h").alias("key"), F.when(F.col("l_linenumber") % 2 == 0, time(F.col("l_shipdate"))).alias("last_update"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), outcomes.alias("outcomes"))
    book = F.struct(key.alias("key"), key.alias("title"), F.when(F.col("l_linenumber") != 3, time(F.col("l_shipdate"))).alias("last_update"), F.array(market).alias("markets"))
    books = table(spark, sf_dir, "lineitem").withColumn("book", book).groupBy("l_orderkey").agg(F.collect_list("book").alias("bookmakers"))
    event = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("mma").alias("sport_key"), F.lit("League").alias("sport_title"), time(F.col("o_orderdate") + F.expr("interval 60 days")).alias("commence_time"), F.lit("A").alias("home_team"), F.lit("B").alias("away_team"), F.when(F.col("o_orderstatus") == "P", "cancelled").alias("status"), "bookmakers")
    joined = table(spark, sf_dir, "orders").join(books, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(time(F.col("o_orderdate")).alias("timestamp"), F.array(event).alias("data"))


@query(
    """with reg as (select * from (values (0, 'draftkings', 'ok'), (1, 'fanduel_us', 'ok'), (2, 'betmgm', 'ok'), (3, 'williamhill_us', 'ok'), (4, 'pointsbetus', 'ok'), (5, 'sugarhouse', 'ok'), (6, 'espnbet', 'ok'), (7, 'pinnacle', 'ok'), (8, 'hardrockbet', 'ok'),
 (9, 'bet365_us', 'pending'), (10, 'circasports', 'pending'), (11, 'DraftKings', 'ok'), (12, ' thescore_bet ', 'ok'), (13, 'theScore Bet', 'unknown'), (14, 'kalshi', 'barred'), (15, 'betfair_exchange', 'barred'), (16, 'Smarkets', 'barred'), (17, 'sporttrade', 'barred'),
 (18, 'prizepicks', 'barred'), (19, 'sleeper_picks', 'barred'), (20, 'FLIFF', 'barred'), (21, 'an_exchange', 'unknown'), (22, 'hard_rock_bet', 'ok')) t(no, provider_key, kind)),
m as (select l.*, o.*, reg.provider_key, reg.kind, case when l_linenumber = 3 then o_orderdate else l_shipdate end as observed, o_orderdate + interval 60 day as starts from lineitem l join orders o on l_orderkey = o_orderkey join reg on reg.no = l_suppkey % 23),
s as (select *, case when l_linenumber = 4 then 'rejected_unsupported_market' when o_orderstatus = 'P' then 'rejected_cancelled_bout' when kind = 'unknown' then 'rejected_unknown' when kind = 'barred' then 'rejected_prohibited_venue' when kind = 'pending' then 'rejected_unapproved_sportsbook' when date_trunc('second', observed) >= date_trunc('second', starts) then 'rejected_live_market' when l_linenumber = 5 then 'rejected_incomplete_market' when l_linenumber = 6 then 'rejected_invalid_odds' else 'normalized' end as status from m)
select provider_key, status, count(*) as n from s group by provider_key, status"""
)
def normalized_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ODD-01, ODD-03, ODD-04, FLT-20, AGG-20: flattened payloads and their status."""
    return quotes.normalized(quotes.flatten(nested_events(spark, sf_dir)), quotes.registry(spark)).groupBy("provider_key", "status").agg(F.count("*").alias("n"))


SNAPS = "snaps as (select fight_id as snapshot_id, case when fight_id % 2 = 0 then a_id else b_id end as a_id, case when fight_id % 2 = 0 then b_id else a_id end as b_id, date + cast(fight_id % 4 as int) - 1 as day from bouts)"


@query(
    f"""with {B.BOUTS_SQL}, {SNAPS}, c as (select s.snapshot_id, s.day, b.fight_id, b.date, s.a_id = b.a_id as same from snaps s join bouts b on least(s.a_id, s.b_id) = least(b.a_id, b.b_id) and greatest(s.a_id, s.b_id) = greatest(b.a_id, b.b_id) and b.date between s.day - 1 and s.day + 1),
g as (select snapshot_id, count(case when date = day then 1 end) as exact, count(*) as near, min(case when date = day then fight_id end) as ef, min(fight_id) as nf from c group by snapshot_id),
r as (select snapshot_id, case when exact > 0 then exact else near end as n, case when exact > 0 then ef else nf end as f from g)
select s.snapshot_id, case when n is null then 'unmatched' when n = 1 then 'matched' else 'ambiguous' end as match_status, case when n = 1 then f end as fight_id, case when n = 1 then (select bool_or(c.same) from c where c.snapshot_id = s.snapshot_id and c.fight_id = r.f) end as same_side from snaps s left join r using (snapshot_id)"""
)
def matched_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14, DAT-06, ARR-01, IDN-10: range join of a day either way, as an equi join."""
    bouts = B.bouts(spark, sf_dir)
    even = F.col("fight_id") % 2 == 0
    snaps = bouts.select(F.col("fight_id").alias("snapshot_id"), F.when(even, F.col("a_id")).otherwise(F.col("b_id")).alias("a_id"), F.when(even, F.col("b_id")).otherwise(F.col("a_id")).alias("b_id"), F.date_add("date", (F.col("fight_id") % 4 - 1).cast("int")).alias("day"))
    return quotes.match_bouts(snaps, bouts)


IDS = """ids as (select 's' || c_custkey as slug, 'name ' || (c_custkey % 700) as name_key, c_custkey from customer), ents as (select s_suppkey as entity, 'name ' || (s_suppkey % 60) as name_key, case when s_suppkey % 5 = 0 then 's' || s_suppkey end as slug from supplier)"""


def _identities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = lambda c, n: F.concat(F.lit("name "), F.col(c) % n)
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("slug"), name("c_custkey", 700).alias("name_key"))
    ents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), name("s_suppkey", 60).alias("name_key"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("s"), "s_suppkey")).alias("slug"))
    return ids, ents


@query(
    f"""with {IDS}, k as (select slug, min(entity) as by_slug from ents where slug is not null group by slug), n as (select name_key, count(*) as ne, min(entity) as by_name from ents group by name_key), t as (select name_key, count(*) as ni from ids group by name_key),
s as (select i.slug, i.name_key, by_slug, by_name, case when by_slug is not null then 'linked' when ni > 1 then 'ambiguous' when ne = 1 then 'linked' when ne > 1 then 'unresolved' else 'unlinked' end as status from ids i left join k on k.slug = i.slug left join n on n.name_key = i.name_key join t on t.name_key = i.name_key)
select slug, name_key, status, case when by_slug is not null then by_slug when status = 'linked' then by_name end as entity from s"""
)
def registered_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-02, AGG-03: link rules of the identity registry."""
    return identity.register(*_identities(spark, sf_dir))


@query(f"with {IDS} select i.slug, case when count(e.entity) = 0 then 'unmatched' when count(e.entity) = 1 then 'matched' else 'ambiguous' end as match_status, case when count(e.entity) = 1 then min(e.entity) end as entity from ids i left join ents e on e.name_key = i.name_key group by i.slug")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10, IDN-12: exact key, with the count telling the status."""
    ids, ents = _identities(spark, sf_dir)
    return identity.lookup(ids, ents).select("slug", "match_status", "entity")


@query(f"with {IDS} select entity, name_key from ents where entity not in (select entity from (select min(e.entity) as entity from ids i join ents e on e.slug = i.slug group by i.slug))")
def unclaimed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-07, SET-02: anti join against owners."""
    ids, ents = _identities(spark, sf_dir)
    owners = ids.join(ents.filter("slug is not null").select("slug", "entity"), "slug").select("entity")
    return identity.unclaimed(ents, owners).select("entity", "name_key")


@query(
    f"""with {B.BOUTS_SQL}, s as (select fight_id as ref, 0 as side, a_id as key from bouts union all select fight_id, 1, b_id from bouts), f as (select key, min(ref * 2 + side) as first from s group by key),
k as (select case when c_custkey % 9 = 0 then c_custkey else -1 - c_custkey end as key, c_custkey * 10 as entity from customer) select f.key, coalesce(k.entity, (select max(entity) from k) + cast(row_number() over (partition by k.entity is null order by first) as bigint)) as entity from f left join k on k.key = f.key"""
)
def numbered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDN-05, SRT-10: numbers by first appearance, side a before b."""
    b = B.bouts(spark, sf_dir)
    long = b.select(F.explode(F.array(*[F.struct(F.col("fight_id").alias("ref"), F.lit(k).alias("side"), F.col(c).alias("key")) for k, c in enumerate(("a_id", "b_id"))])).alias("r")).select("r.*")
    known = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.col("c_custkey")).otherwise(-1 - F.col("c_custkey")).alias("key"), (F.col("c_custkey") * 10).alias("entity"))
    return identity.numbered(long, known)


LEDGER_SQL = """led as (select 'p' || fight_id as prediction_id, date as event_date, 'u' || a_id as fighter_a, case when fight_id % 4 = 0 then 'x' else 'u' end || b_id as fighter_b, 'm' || (fight_id % 2) as model_version, case when fight_id % 7 = 0 then 'error' when fight_id % 3 = 0 then 'resolved' else 'pending' end as status from bouts),
new as (select 'n' || fight_id as prediction_id, date as event_date, 'U' || b_id as fighter_a, 'u' || a_id as fighter_b, 'm' || (fight_id % 2) as model_version, case when fight_id % 11 = 0 then 'error' else 'pending' end as status from bouts)"""
KEY_SQL = "event_date || '|' || least(lower(fighter_a), lower(fighter_b)) || '|' || greatest(lower(fighter_a), lower(fighter_b))"


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = B.bouts(spark, sf_dir)
    f = F.col("fight_id")
    row = lambda p, a, c, s: b.select(F.concat(F.lit(p), f).alias("prediction_id"), F.col("date").alias("event_date"), a.alias("fighter_a"), c.alias("fighter_b"), F.concat(F.lit("m"), f % 2).alias("model_version"), s.alias("status"), "fight_id")
    u = lambda c, p="u": F.concat(F.lit(p), c)
    led = row("p", u("a_id"), F.concat(F.when(f % 4 == 0, "x").otherwise("u"), "b_id"), F.when(f % 7 == 0, "error").when(f % 3 == 0, "resolved").otherwise("pending")).drop("fight_id")  # some sides are spelt otherwise
    new = row("n", u("b_id", "U"), u("a_id"), F.when(f % 11 == 0, "error").otherwise("pending")).drop("fight_id")
    return led, new


@query(
    f"""with {B.BOUTS_SQL}, {LEDGER_SQL}, a as (select {KEY_SQL} as k, model_version, bool_or(status = 'pending') as hp from led where status in ('pending', 'resolved') group by all),
d as (select n.*, {KEY_SQL} as k, a.hp from new n left join a on a.k = {KEY_SQL.replace("event_date", "n.event_date").replace("fighter_a", "n.fighter_a").replace("fighter_b", "n.fighter_b")} and a.model_version = n.model_version)
select prediction_id, case when hp is null or status = 'error' then 'accepted' when hp then 'overwrites_pending' else 'rejected_duplicate' end as decision from d"""
)
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-03, SET-05, HSH-01: decisions of an append that overwrites pending rows."""
    return ledger.append(*_ledger(spark, sf_dir), policy="overwrite_pending")[1]


@query(
    f"""with {B.BOUTS_SQL}, {LEDGER_SQL}, res as (select date as event_date, case when fight_id % 6 = 0 then 'y' else 'u' end || b_id as fighter_a, 'u' || a_id as fighter_b, case when fight_id % 5 = 0 then 'nobody' when a_won = 1 then 'U' || a_id else 'u' || b_id end as winner, fight_id from bouts),
g as (select {KEY_SQL} as k, count(*) as n, min(lower(winner)) as w from res group by 1),
j as (select l.*, g.n, g.w, case when w = lower(fighter_a) then 1 when w = lower(fighter_b) then 0 end as t from led l left join g on g.k = {KEY_SQL})
select prediction_id, case when status = 'error' then 'error' when status = 'resolved' then 'skipped' when n is null then 'unmatched' when n > 1 then 'ambiguous' when t is null then 'unknown_winner' else 'resolved' end as outcome, case when status = 'pending' and n = 1 then t end as target_a_win from j"""
)
def ledger_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-04, JOIN-11: results matched in either orientation."""
    led, _ = _ledger(spark, sf_dir)
    b = B.bouts(spark, sf_dir)
    u = lambda c, p="u": F.concat(F.lit(p), c)
    winner = F.when(F.col("fight_id") % 5 == 0, "nobody").when(F.col("a_won") == 1, u("a_id", "U")).otherwise(u("b_id"))
    results = b.select(F.col("date").alias("event_date"), F.concat(F.when(F.col("fight_id") % 6 == 0, "y").otherwise("u"), "b_id").alias("fighter_a"), u("a_id").alias("fighter_b"), winner.alias("winner"))
    full = led.withColumns({"predicted_probability_a": F.lit(0.6), "target_a_win": F.lit(None).cast("int"), "winner": F.lit(None).cast("string"), "log_loss": F.lit(None).cast("double"), "brier": F.lit(None).cast("double"), "correct_prediction": F.lit(None).cast("int")})
    return ledger.resolve(full, results).select("prediction_id", "outcome", "target_a_win")


@query(
    f"""with {B.BOUTS_SQL}, spelt as (select *, case when fight_id % 3 = 0 then 'x' else 'u' end || b_id as mb, case when fight_id % 5 = 0 then 'y' else 'u' end || b_id as lb from bouts),
man as (select date as event_date, least('u' || a_id, mb) || '|' || greatest('u' || a_id, mb) as k, case fight_id % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 else 5 end as rank, fight_id from spelt), led as (select date as event_date, least('u' || a_id, lb) || '|' || greatest('u' || a_id, lb) as k, fight_id from spelt),
j as (select coalesce(m.event_date, l.event_date) as event_date, l.fight_id as p, m.rank from man m full outer join led l on l.event_date = m.event_date and l.k = m.k)
select event_date, count(*) as bouts, count(p) as predicted, count(case when rank <= 2 then 1 end) as on_main, min(coalesce(rank, 5)) as first_rank, case when count(p) = 0 then 'unavailable' when count(p) = count(*) then 'frozen' else 'partial' end as status from j group by event_date"""
)
def card_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV-01, JOIN-12, SRT-09: manifest and ledger, full outer, nested per event."""
    b = B.bouts(spark, sf_dir)
    u = lambda c: F.concat(F.lit("u"), c)
    base = b.select(F.col("date").alias("event_date"), F.lit("e").alias("event_name"), u("a_id").alias("fighter_a"), u("b_id").alias("fighter_b"), "fight_id")
    spelt = lambda k, x: F.concat(F.when(F.col("fight_id") % k == 0, x).otherwise("u"), F.substring("fighter_b", 2, 20))
    section = F.get(F.array(*map(F.lit, (*ledger.SECTIONS, "fight_card", ""))), F.col("fight_id") % 6)
    manifest = base.withColumns({"bout_order": F.col("fight_id").cast("int"), "fighter_b": spelt(3, "x"), "card_section": section}).drop("fight_id")
    led = base.withColumn("fighter_b", spelt(5, "y")).withColumns({"predicted_probability_a": F.lit(0.6), "prediction_batch_id": F.lit("b"), "prediction_timestamp_utc": F.lit("t")}).drop("fight_id")
    view = ledger.card_view(manifest, led)
    return view.select("event_date", F.size("bouts").cast("long").alias("bouts"), F.size(F.filter("bouts", lambda x: x["probability_a"].isNotNull())).cast("long").alias("predicted"), F.size(F.filter("bouts", lambda x: x["section_rank"] <= 2)).cast("long").alias("on_main"), F.get("bouts", 0)["section_rank"].alias("first_rank"), "status")


@query(
    f"""with {B.BOUTS_SQL}, h as (select * from bouts where date < date '2024-01-21'), ev as (select fight_id, date + cast(fight_id % 5 as int) - 2 as date, a_id, b_id, least(a_id, b_id) as x, greatest(a_id, b_id) as y from bouts where date >= date '2024-01-19'), k as (select distinct date, least(a_id, b_id) as x, greatest(a_id, b_id) as y, true as there from h)
select fight_id, ev.date, case when there then 'already_stored' when ev.date < (select max(date) from h) then 'blocked_late' when ev.date = (select max(date) from h) then 'append_same_day' else 'append' end as decision from ev left join k on k.date = ev.date and k.x = ev.x and k.y = ev.y"""
)
def late_data_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-05, INC-06: late bouts are blocked, same-day ones appended with a warning."""
    b = B.bouts(spark, sf_dir)
    event = b.filter(F.col("date") >= date(2024, 1, 19)).select("fight_id", F.date_add("date", (F.col("fight_id") % 5 - 2).cast("int")).alias("date"), "a_id", "b_id")
    return ledger.apply_plan(b.filter(F.col("date") < date(2024, 1, 21)), event).select("fight_id", "date", "decision")


@query(
    """with f as (select case when o_orderkey % 2 = 0 then 'u' else 'w' end || o_orderkey as url, 'n' || (o_orderkey % 900) as name_key, (o_orderkey % 13) as bouts from orders), s as (select case o_orderkey % 3 when 0 then 'u' || o_orderkey when 1 then 'v' || o_orderkey end as url, case when o_orderkey % 5 = 0 then 'n' || (o_orderkey % 900) else 'q' || (o_orderkey % 700) end as name_key, (o_orderkey % 11) as bouts from orders),
u as (select url, max(bouts) as ub from s where url is not null group by url), n as (select name_key, count(*) as c, max(bouts) as nb from s group by name_key), j as (select f.*, ub, c, coalesce(ub, case when c = 1 then nb end) as held from f left join u using (url) left join n using (name_key))
select url, name_key, bouts, held as stored_bouts, case when ub is null and c > 1 then 'ambiguous' when held is null then 'missing' when held < bouts then 'stale' else 'current' end as status from j"""
)
def update_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INC-07, JOIN-17: fetched against stored, by URL and then by name."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = lambda x, n: F.concat(F.lit(x), k % n)
    fetched = o.select(F.concat(F.when(k % 2 == 0, "u").otherwise("w"), k).alias("url"), name("n", 900).alias("name_key"), (k % 13).alias("bouts"))
    stored = o.select(F.when(k % 3 == 0, F.concat(F.lit("u"), k)).when(k % 3 == 1, F.concat(F.lit("v"), k)).alias("url"), F.when(k % 5 == 0, name("n", 900)).otherwise(name("q", 700)).alias("name_key"), (k % 11).alias("bouts"))
    return ledger.compare(fetched, stored)


@query(
    f"""with {APPS}, {PRED}, lab as (select fight_id, p, greatest(p, 1 - p) as t from ll) select fight_id, case when t >= 0.8 then 'Very high confidence' when t >= 0.7 then 'High confidence' when t >= 0.62 then 'Moderate confidence' when t >= 0.55 then 'Slight lean' else 'Toss-up' end as dashboard,
 case when t >= 0.8 then 'strong' when t >= 0.7 then 'confident' when t >= 0.6 then 'lean' else 'toss-up' end as ledger, case when p > 0.5 then (p * 2) else 0.0 end as p_x_favoured from lab"""
)
def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05, PRJ-07: both ladders, and an interaction that is zero outside its class."""
    rows = predictions(spark, sf_dir).withColumn("weight_class", F.when(F.col("p") > 0.5, "favoured").otherwise("other")).withColumn("p2", F.col("p") * 2)
    out = matchup.division_interactions(rows.withColumnRenamed("p2", "twice"), ("twice",), ["favoured"])
    top = F.greatest("p", 1 - F.col("p"))
    return out.select("fight_id", matchup.dashboard_confidence(top).alias("dashboard"), matchup.ledger_confidence(F.col("p")).alias("ledger"), F.col("twice_x_favoured").alias("p_x_favoured"))


@query(
    f"""with {APPS}, {LAYOFF_LONG}, w as (select fight_id, max(case when side = 'a' then layoff_days end) * 40 as a, max(case when side = 'b' then layoff_days end) * 40 as b from lay2 group by fight_id)
select case when a is null or b is null then 'Missing' when greatest(a, b) < 60 then 'Under 60 days' when greatest(a, b) < 120 then '60-119 days' when greatest(a, b) < 240 then '120-239 days' when greatest(a, b) < 365 then '240-364 days' when greatest(a, b) < 730 then '365-729 days' else '730+ days' end as bucket, count(*) as n from w group by 1"""
)
def layoff_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06: groups of the longer layoff, days drawn out forty times."""
    long = history.layoff(B.appearances(spark, sf_dir).select("fight_id", "date", "side", "entity", "opponent", "won"))
    wide = history.to_bouts(long, ("layoff_days",))
    return wide.select(matchup.layoff_bucket(F.col("layoff_days_a") * 40, F.col("layoff_days_b") * 40).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"with {B.BOUTS_SQL} select fight_id, substr(sha1(date || '|' || least('u' || a_id, 'u' || b_id) || '|' || greatest('u' || a_id, 'u' || b_id) || '|m|b'), 1, 16) as prediction_id, 'snap_' || substr(sha256(fight_id || '|' || a_id), 1, 32) as snapshot_id from bouts")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-01, HSH-03, HSH-04, ARR-01."""
    u = lambda c: F.concat(F.lit("u"), c)
    return B.bouts(spark, sf_dir).select("fight_id", T.prediction_id(F.col("date"), u("a_id"), u("b_id"), F.lit("m"), F.lit("b")).alias("prediction_id"), T.prefixed_id("snap_", 32, F.col("fight_id"), F.col("a_id")).alias("snapshot_id"))


@query("select date, n, wins from (select cast(ts as date) as date, count(*) as n, count(case when value > 50 then 1 end) as wins from events group by 1) order by n desc, date limit 10")
def top_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02: the ten days with the most rows, a top-k report."""
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("wins"))
    return days.orderBy(F.desc("n"), "date").limit(10)


@query("select c_custkey as entity, c_custkey in (select o_custkey from orders) as in_orders, c_custkey in (select user_id from events) as in_events from customer")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-08, SET-03: membership of keys in two other tables."""
    flag = lambda t, c, n: table(spark, sf_dir, t).select(F.col(c).alias("entity")).distinct().withColumn(n, F.lit(True))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    out = rows.join(flag("orders", "o_custkey", "in_orders"), "entity", "left").join(flag("events", "user_id", "in_events"), "entity", "left")
    return out.fillna(False, ["in_orders", "in_events"])


@query("select n_regionkey as region, o_orderpriority as priority, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2 having count(*) >= 2")
def rare_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, AGG-22: counts per category over a threshold."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy(F.col("n_regionkey").alias("region"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n >= 2")


@query()
def model_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-01, ML-02, ML-05, ML-09, ML-10, EXP-03, MET-02, MET-03: fitted, calibrated and tested on a chronological split."""
    from contestkit.operators.experiments import calibrate

    long = B.appearances(spark, sf_dir).select("fight_id", "date", "side", "entity", "opponent", "won")
    wide = history.to_bouts(history.form(history.record(long)), (*history.RECORD, *history.FORM))
    rows = splits.three_way(wide).select("fight_id", "date", "split", "a_won", *[f"{c}_diff" for c in (*history.RECORD, *history.FORM)]).cache()
    found = calibrate(rows, [f"{c}_diff" for c in (*history.RECORD, *history.FORM)], "a_won")
    rows.unpersist()
    out = [(name, m["n"], m["accuracy"], m["log_loss"], m["brier"], m["auc"], m["ece"], found["best"] == name) for name, m in found["models"].items()]
    return spark.createDataFrame(out, "method string, n long, accuracy double, log_loss double, brier double, auc double, ece double, best boolean")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all history features and matchup projections of every bout, point in time."""
    return matchup.matchup(history.features(B.appearances(spark, sf_dir)))
