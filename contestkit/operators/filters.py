"""Cleaning, validation and guards (FLT-01 to FLT-20). Counters of what is dropped come from one aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestkit.functions.parse import any_date
from contestkit.functions.text import display_name, name_key

#: Parts of column names that tell a result or a market, and names that are allowed all the same.
EXPORT_PATTERNS = ("odds", "ranking", "rank", "winner_", "loser_", "sig_str", "takedown", "control", "avg")
EXPORT_ALLOWED = frozenset({"winner", "fighter_a_won", "method", "round"})
MODEL_PATTERNS = ("winner", "loser", "post", "method", "round", "odds", "rank", "sig_str", "takedown", "control", "result", "outcome", "td_", "ctrl", "knockdown", "sub_att")
MARKET_TOKENS = ("odds", "moneyline", "money_line", "vig", "juice", "implied_prob", "kalshi", "polymarket", "betfair", "sportsbook", "decimal_odds", "american_odds", "book", "market_prob")
#: What names a bout to come, and columns that would tell how it ended.
ID_COLUMNS = ("event_date", "event_name", "fighter_a", "fighter_b")
RESULT_COLUMNS = frozenset({"fighter_a_won", "fighter_b_won", "winner", "loser", "result", "outcome", "method", "round", "target", "target_a_win", "finish", "decision"})


def clean_bouts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row of counters) from date, fighter_a, fighter_b, winner, source_row_id.

    In this order: bad names (blank, or the same on both sides), bad dates, undecided results, later copies of
    an ordered (date, a, b).
    """
    a, b = name_key(F.col("fighter_a")), name_key(F.col("fighter_b"))
    reason = F.when((a == "") | (b == "") | (a == b), "bad_name").when(F.col("day").isNull(), "bad_date").when(F.col("a_won").isNull(), "undecided")
    winner = name_key(F.col("winner"))
    staged = raw.withColumn("day", any_date(F.col("date"))).withColumn("a_won", F.when(winner == a, 1).when(winner == b, 0)).withColumn("key_a", a).withColumn("key_b", b).withColumn("reason", reason)
    # rows with a reason stand alone, so that blank names fill no partition
    alike = Window.partitionBy("day", "key_a", "key_b", F.when(F.col("reason").isNotNull(), F.col("source_row_id")))
    marked = staged.withColumn("first_id", F.min("source_row_id").over(alike))
    marked = marked.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("first_id") != F.col("source_row_id"), "duplicate"))
    counted = marked.agg(F.count("*").alias("rows"), *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("bad_name", "bad_date", "undecided", "duplicate")], F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"))
    kept = marked.filter("reason is null").select("source_row_id", F.col("day").alias("date"), display_name(F.col("fighter_a")).alias("fighter_a"), display_name(F.col("fighter_b")).alias("fighter_b"), "a_won")
    return kept, counted


def with_target(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.dropna(subset=list(columns))


def as_of(rows: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """(rows up to the day, count of later ones)."""
    return rows.filter(F.col("date") <= day), rows.agg(F.count(F.when(F.col("date") > day, 1)).alias("excluded"))


def leaking(columns: list[str], patterns: tuple[str, ...] = MODEL_PATTERNS, allowed: frozenset[str] = frozenset()) -> list[str]:
    """Columns whose names hold a forbidden part; a guard raises on any."""
    return [c for c in columns if c not in allowed and any(p in c.lower() for p in patterns)]


def guard(columns: list[str], patterns: tuple[str, ...] = MODEL_PATTERNS, allowed: frozenset[str] = frozenset()) -> None:
    if bad := leaking(columns, patterns, allowed):
        raise ValueError(f"columns could leak the result: {bad}")


def available(rows: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """(usable, skipped): skipped are absent or null in all rows; one aggregation over the frame (FLT-08)."""
    there = [c for c in wanted if c in rows.columns]
    counts = rows.agg(*[F.count(c).alias(c) for c in there]).first().asDict() if there else {}
    return [c for c in there if counts[c]], [c for c in wanted if not counts.get(c)]


def numeric_or_fail(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Doubles; a present value that is no finite number is an error with three examples (FLT-09)."""
    cast = {c: F.col(c).try_cast("double") for c in columns}
    wrong = lambda c: F.col(c).isNotNull() & (cast[c].isNull() | F.isnan(cast[c]) | (F.abs(cast[c]) == F.lit(float("inf"))))
    counts = rows.agg(*[F.count(F.when(wrong(c), 1)).alias(c) for c in columns]).first().asDict()
    for c, n in counts.items():
        if n:
            examples = [r[0] for r in rows.filter(wrong(c)).select(F.col(c).cast("string")).take(3)]
            raise ValueError(f"{c}: {n} values are not finite numbers, such as {examples}")
    return rows.withColumns(cast)


def market_names(names: list[str]) -> list[str]:
    """Names of columns or parameters that hold a market's token (FLT-18)."""
    return [n for n in names if any(t in n.lower() for t in MARKET_TOKENS)]


def structure(columns: list[str], features: tuple[str, ...] = (), ids: tuple[str, ...] = ID_COLUMNS, markets: bool = True) -> dict[str, list[str]]:
    """What is wrong with the columns of bouts to come, by kind; all empty if nothing is (FLT-10, FLT-11)."""
    return {
        "missing_ids": [c for c in ids if c not in columns], "missing_features": [c for c in features if c not in columns],
        "results": sorted(RESULT_COLUMNS.intersection(columns)), "markets": market_names(columns) if markets else [],
    }


def row_reasons(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds reasons, the names of all checks that hold."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()])))


def bout_checks(key: Callable[[Column], Column] = name_key) -> dict[str, Column]:
    a, b = key(F.col("fighter_a")), key(F.col("fighter_b"))
    return {"bad_date": any_date(F.col("event_date")).isNull(), "empty_a": a == "", "empty_b": b == "", "same_name": (a == b) & (a != "")}


def judge_input(rows: DataFrame, key: Callable[[Column], Column] = name_key, strict: bool = True) -> DataFrame:
    """Adds reasons and first_row to bouts to come (row_index, event_date, fighter_a, fighter_b): also whether an earlier row has the same bout.

    ``strict`` (FLT-11): only rows that are in order themselves make a later one a duplicate, and only by real days;
    else (FLT-10) any row with two names does. Both sides' order does not matter.
    """
    judged = row_reasons(rows, bout_checks(key))
    sides = F.array_sort(F.array(key(F.col("fighter_a")), key(F.col("fighter_b"))))
    day = any_date(F.col("event_date")).cast("string")
    named = ~F.array_contains(sides, "")
    counts = F.size("reasons") == 0 if strict else named
    same = judged.withColumns({"bout": F.when(counts, F.concat_ws("|", day if strict else F.col("event_date").cast("string"), F.array_join(sides, "|")))})
    first = F.when(F.col("bout").isNotNull(), F.min("row_index").over(Window.partitionBy("bout", F.when(F.col("bout").isNull(), F.col("row_index")))))
    marked = same.withColumn("first_row", first).withColumn("duplicate", F.coalesce(F.col("first_row") < F.col("row_index"), F.lit(False)))
    return marked.withColumn("reasons", F.when(F.col("duplicate"), F.array_append("reasons", F.lit("duplicate"))).otherwise(F.col("reasons"))).drop("bout", "duplicate")


def first_reason(cascade: dict[str, Column]) -> Column:
    """The first check that holds, else null (FLT-19, FLT-20)."""
    out = F.lit(None).cast("string")
    for name, check in reversed(list(cascade.items())):
        out = F.when(check, name).otherwise(out)
    return out


def completed(status: Column) -> Column:
    """Bouts that took place (FLT-12)."""
    return ~F.coalesce(F.lower(F.trim(status)), F.lit("completed")).isin("cancelled", "canceled", "scheduled", "upcoming", "postponed", "synthetic", "incomplete", "pending")


def pending(rows: DataFrame) -> DataFrame:
    """Ledger rows that may be shown (FLT-13): pending, unresolved, of an official frozen live batch with versions."""
    blank = lambda c: F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin("", "nan", "none", "null")
    unresolved = blank("target_a_win") & blank("winner") & blank("resolved_timestamp_utc")
    batch = F.lower("prediction_batch_id")
    live = (F.col("prediction_mode") == "live_forward") & batch.contains("official") & batch.contains("frozen")
    return rows.filter((F.col("status") == "pending") & unresolved & live & ~blank("model_version") & ~blank("feature_schema_version"))


def valid_probabilities(p: Column, q: Column, winner_is_a: Column | None = None) -> Column:
    """Null if both are finite, within [0, 1] and sum to 1 within 1e-6, and the stored winner is the likelier side; else the reason (FLT-14).

    ``winner_is_a``: whether the stored winner is side A; null if none is stored. At exactly one half A is the winner.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    out = F.when(bad(p) | bad(q), "not_a_probability").when(F.abs(p + q - 1) > 1e-6, "not_complementary")
    return out if winner_is_a is None else out.when(winner_is_a != (p >= q), "winner_differs")


def schema_parity(new: DataFrame, old: DataFrame, key: str) -> dict:
    """Differences of columns and of keys (FLT-15, SET-02)."""
    a, b = new.columns, old.columns
    return {
        "only_new": [c for c in a if c not in b], "only_old": [c for c in b if c not in a], "same_order": a == b,
        "keys_only_new": new.select(key).exceptAll(old.select(key)).count(), "keys_only_old": old.select(key).exceptAll(new.select(key)).count(),
    }


def expected_events(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts against (date, event, n): adds found and ok; repeated ids are counted apart (FLT-16)."""
    counts = rows.groupBy("date", "event").agg(F.count("*").alias("found"), (F.count("*") - F.countDistinct("fight_id")).alias("repeated_ids"))
    return expected.join(counts, ["date", "event"], "left").fillna(0, ["found", "repeated_ids"]).withColumn("ok", (F.col("found") == F.col("n")) & (F.col("repeated_ids") == 0))


def quality_report(rows: DataFrame, columns: tuple[str, ...], target: str) -> DataFrame:
    """Missing rate and infinite values of each column and the target's mean, in one wide aggregation (FLT-17)."""
    sums = [F.avg(target).alias("target_mean"), F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in columns], *[F.count(F.when(F.abs(F.col(c).cast("double")) == F.lit(float("inf")), 1)).alias(f"i_{c}") for c in columns]]
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("missing_rate"), F.col(f"i_{c}").alias("infinite")) for c in columns])
    return rows.agg(*sums).select("n", "target_mean", F.explode(each).alias("r")).select("n", "target_mean", "r.*")
