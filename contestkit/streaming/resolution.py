"""Resolution of predictions as a stream (INC-04): ledger and results meet in a stream-stream join, late results come by a correction path.

Tables below a base folder, one folder ``batch=N`` a batch, which a retry overwrites: predictions, results (all that came), matches (what the join gave:
predictions with a result, or without any once the watermark passed their day) and corrections (results that came behind the watermark). ``resolved`` puts
them together and equals ``ledger.resolve`` over the same rows, whatever the order in which they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contestkit.operators.ledger import fight_key, found_results, judged
from contestkit.session import cut
from contestkit.sources.tables import there

PREDICTION = "prediction_id string, event_date date, fighter_a string, fighter_b string, predicted_probability_a double, status string"
RESULT = "result_id string, event_date date, fighter_a string, fighter_b string, winner string"
MATCH = "prediction_id string, k string, result_id string, winner string"
CORRECTION = "result_id string, k string, winner string"


def matches(predictions: DataFrame, results: DataFrame, late: str = "3 days") -> DataFrame:
    """Left outer join of the streams on the bout's key, whose day is its event time; both sides wait for ``late`` behind the newest day of either.

    A prediction without a result by then comes out with nulls; its key's state goes, so results behind it are left to ``correct``.
    """
    at = F.col("event_date").cast("timestamp")
    left = predictions.select("prediction_id", fight_key().alias("k"), at.alias("at")).withWatermark("at", late)
    right = results.select("result_id", fight_key().alias("rk"), at.alias("rat"), "winner").withWatermark("rat", late)
    joined = left.join(right, (F.col("k") == F.col("rk")) & (F.col("at") == F.col("rat")), "leftOuter")
    return joined.select("prediction_id", "k", "result_id", "winner")


def _put(base: str, name: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")

    return write


def start(predictions: DataFrame, results: DataFrame, base: str, late: str = "3 days", **trigger: object) -> list[StreamingQuery]:
    """Starts the three queries: both inputs as they come, and their matches. They go on from their checkpoints after a restart."""
    queries = []
    for name, stream in (("predictions", predictions), ("results", results), ("matches", matches(predictions, results, late))):
        queries.append(stream.writeStream.foreachBatch(_put(base, name)).option("checkpointLocation", f"{base}/checkpoints/{name}").trigger(**(trigger or {"availableNow": True})).start())
    return queries


def _read(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    path = f"{base}/{name}"
    return spark.read.schema(f"{schema}, batch long").parquet(path) if there(spark, path) else spark.createDataFrame([], f"{schema}, batch long")


def late_results(spark: SparkSession, base: str, number: int) -> DataFrame:
    """(result_id, k, winner) of results for a prediction that neither the join nor corrections other than batch ``number`` gave out."""
    results = _read(spark, base, "results", RESULT).withColumn("k", fight_key()).select("result_id", "k", "winner")
    known = _read(spark, base, "matches", MATCH).filter("result_id is not null").select("result_id")
    done = _read(spark, base, "corrections", CORRECTION).filter(F.col("batch") != number).select("result_id")
    keys = _read(spark, base, "predictions", PREDICTION).select(fight_key().alias("k")).distinct()
    return results.join(known.unionByName(done).distinct(), "result_id", "left_anti").join(keys, "k", "left_semi").dropDuplicates(["result_id", "k"])


def correct(spark: SparkSession, base: str, number: int) -> int:
    """Adds the results that the join left out to the corrections, as batch ``number``; run again with the same number it replaces it. How many.

    A result that is still on its way through the join may be taken too: ``resolved`` counts it once, by its id.
    """
    rows = cut(late_results(spark, base, number).select("result_id", "k", "winner"))
    _put(base, "corrections")(rows, number)
    return rows.count()


def resolved(spark: SparkSession, base: str, overwrite: bool = False) -> DataFrame:
    """The ledger with outcomes, from the predictions, matches and corrections alone; each result counts once."""
    predictions = _read(spark, base, "predictions", PREDICTION).drop("batch")
    met = _read(spark, base, "matches", MATCH).filter("result_id is not null").select("result_id", "k", "winner")
    each = met.unionByName(_read(spark, base, "corrections", CORRECTION).select("result_id", "k", "winner")).dropDuplicates(["result_id", "k"])
    return judged(predictions.withColumn("k", fight_key()).join(found_results(each), "k", "left"), predictions.columns, overwrite)
