"""Streams (INC-01, INC-03, INC-06, INC-08): the history, the ledger and windows as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "entity long, fight_id long, date date, won int, prior_fights long, prior_wins long, days_since_last_fight int"
RECORD_STATE = "fights long, wins long, last_day long"


def running_record(long: DataFrame) -> DataFrame:
    """Prior record per entity, emitted before the row is folded in. Within a batch rows go in (date, fight_id) order."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fights, wins, last = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(parts)).sort_values(["date", "fight_id"])
        out = []
        for r in rows.itertuples(index=False):
            day = pd.Timestamp(r.date).toordinal()
            out.append((key[0], r.fight_id, r.date, r.won, fights, wins, None if last is None else day - last))
            fights, wins, last = fights + 1, wins + int(r.won), day
        state.update((fights, wins, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    return long.select("entity", "fight_id", "date", "won").groupBy("entity").applyInPandasWithState(fold, RECORD, RECORD_STATE, "append", GroupStateTimeout.NoTimeout)


def unique(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once while the watermark keeps it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, time: str, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Activity of a user without a longer gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def gate_late(history_path: str, accepted_path: str, late_path: str, schema: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows before the last stored day are set aside, not dropped; others are appended once.

    Each batch owns one folder ``batch=N`` of each table, which a retry overwrites, so no failure between the writes loses or doubles
    a row. The last stored day comes from earlier batches only: from the history, read once, and a table of one row a
    batch. A bout that is stored already lies on or after that day, so older files of the accepted table are not read.
    """
    days_path = f"{accepted_path}_days"
    first: list = []

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not first:
            first.append(spark.read.parquet(history_path).agg(F.max("date")).first()[0])
        earlier = lambda path, columns: _read(spark, path, columns).filter(F.col("batch") < number)
        newest = earlier(days_path, "date date").agg(F.max("date")).first()[0]
        old = max((d for d in (*first, newest) if d is not None), default=None)
        late = F.lit(False) if old is None else F.col("date") < F.lit(old)
        put = lambda rows, path: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        put(batch.filter(late), late_path)
        stored = earlier(accepted_path, schema)
        stored = (stored if old is None else stored.filter(F.col("date") >= F.lit(old))).select("fight_id")
        put(batch.filter(~late).join(stored, "fight_id", "left_anti"), accepted_path)
        put(batch.filter(~late).agg(F.max("date").alias("date")), days_path)

    return write


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table there, with its batch numbers; no rows if there is none yet."""
    empty = spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(empty.schema).parquet(path) if _exists(spark, path) else empty


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("parquet").load(path)
    except AnalysisException:
        return False
    return True
