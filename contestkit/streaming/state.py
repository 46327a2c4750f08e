"""The whole history as keyed state (INC-01): every feature of ``history.features`` for rows of a stream, given before the row counts.

A competitor's state is one row of counts, last results, last days and totals, which a batch reads and writes once: each call to the store is a
round trip between Python and the JVM. It can begin with what a batch table holds, and goes once the competitor has been away for ``expire_days``.
The formulas over the totals are those of ``history``.

Sessions need the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` (see ``PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from contestkit.operators import history
from contestkit.operators.history import SUMMED

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = date(1970, 1, 1)
KEPT = 5
MEASURES = (*SUMMED, "n")
KNOWN = "fights long, wins long, results array<int>, last int, earlier int"
STATE = f"{KNOWN}, totals array<double>"
_COUNTED = "prior_fights long, prior_wins long, " + ", ".join(f"wins_last_{n} long, win_pct_last_{n} double" for n in (3, 5)) + ", days_since_last_fight int, layoff_days int"
OUTPUT = f"fight_id long, day int, side string, entity long, opponent long, won int, late boolean, {_COUNTED}, totals array<double>"
_Given = Row(*[c.split()[0] for c in OUTPUT.split(", ")])


def start_state(long: DataFrame) -> DataFrame:
    """Each competitor's state after all rows of a batch table: entity, known (``KNOWN``), totals (in the order of ``MEASURES``).

    Totals are partial sums; of rows and days only a competitor's newest few are brought together.
    """
    rows = long.withColumns({f"c_{m}": c for m, c in history.contributions().items()} | {"day": F.datediff("date", F.lit(EPOCH))})
    sums = [F.coalesce(F.sum(f"c_{m}").cast("double"), F.lit(0.0)).alias(m) for m in MEASURES]
    counted = rows.groupBy("entity").agg(F.count("*").alias("fights"), F.sum("won").cast("long").alias("wins"), *sums)
    newest = Window.partitionBy("entity").orderBy(F.desc("date"), F.desc("fight_id"))
    results = rows.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= KEPT).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct((-F.col("nth")).alias("o"), F.col("won").cast("int").alias("won")))).alias("r"))
    lately = Window.partitionBy("entity").orderBy(F.desc("day"))
    days = rows.select("entity", "day").distinct().withColumn("nth", F.row_number().over(lately)).filter("nth <= 2").groupBy("entity").agg(F.max("day").alias("last"), F.max(F.when(F.col("nth") == 2, F.col("day"))).alias("earlier"))
    known = F.struct("fights", "wins", F.transform("r", lambda b: b["won"]).alias("results"), "last", "earlier")
    return counted.join(results, "entity").join(days, "entity").select("entity", known.alias("known"), F.array(*MEASURES).alias("totals"))


class _History(StatefulProcessor):
    def __init__(self, expire_days: int | None) -> None:
        self.expire_days = expire_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.known.update((*(initialState["known"][c.split()[0]] for c in KNOWN.split(", ")), [float(t) for t in initialState["totals"]]))
        self._wait(initialState["known"]["last"])

    def _wait(self, last: int) -> None:
        """One timer a competitor, for the day after which it is forgotten."""
        if self.expire_days is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.expire_days) * 86_400_000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fights, wins, results, last, earlier, totals = self.known.get() or (0, 0, [], None, None, [0.0] * len(MEASURES))
        results, totals, before = list(results), tuple(totals), last
        for day, fight_id, side, _, opponent, won, added, *_ in sorted(rows, key=itemgetter(0, 1)):
            late = before is not None and day < before
            three, five = results[-3:], results[-5:]
            since = earlier if day == last else last
            yield _Given(
                fight_id, day, side, key[0], opponent, won, late, fights, wins, sum(three), sum(three) / len(three) if three else None, sum(five), sum(five) / len(five) if five else None,
                None if last is None else day - last, None if since is None else day - since, totals,
            )
            if late:
                continue
            fights, wins, results = fights + 1, wins + won, [*results, won][-KEPT:]
            last, earlier = day, since
            if added is not None:
                totals = tuple(t + a for t, a in zip(totals, added, strict=True))
        self.known.update((fights, wins, results, last, earlier, list(totals)))
        if last != before:
            self._wait(last)

    def close(self) -> None:
        pass


def running_features(long: DataFrame, initial: DataFrame | None = None, expire_days: int | None = None, late: str = "0 days") -> DataFrame:
    """Every row of the stream ``long`` (as ``history.features`` takes it) with the features of its side, known before it; and whether it is ``late``.

    Rows of a batch go in (date, fight_id) order. A row of a day before the competitor's last one, as earlier batches left it, is marked late: it gets the
    features as they stand, and changes nothing. ``initial`` is what ``start_state`` makes of a batch table. With ``expire_days`` the event time is the
    day, with a watermark of ``late``: rows behind it are gone, and a competitor's state once it lies that far back.
    """
    adds = history.contributions()
    # the processor takes and gives totals as one array: every further column of a row costs Python more than its sum
    added = F.when(adds["n"].isNotNull(), F.array(*[adds[m].cast("double") for m in MEASURES]))
    rows = long.select(F.datediff("date", F.lit(EPOCH)).alias("day"), "fight_id", "side", "entity", "opponent", F.col("won").cast("int").alias("won"), added.alias("added"))
    mode = "None"
    if expire_days is not None:
        rows, mode = rows.withColumn("at", F.date_from_unix_date("day").cast("timestamp")).withWatermark("at", late), "EventTime"
    begun = None if initial is None else initial.groupBy("entity")
    out = rows.groupBy("entity").transformWithState(_History(expire_days), OUTPUT, "Append", mode, begun)
    totals = [F.col("totals")[k].cast("long" if m == "n" else "double").alias(f"t_{m}") for k, m in enumerate(MEASURES)]
    named = out.select(*[F.date_from_unix_date("day").alias("date") if c == "day" else c for c in out.columns if c != "totals"], *totals)
    return history.with_rates(history.with_layoff_flags(history.with_losses(named)))
