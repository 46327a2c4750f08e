"""Evaluation of probabilities (AGG-04 to AGG-19, MET-01 to MET-04). Input has p (double) and y (0/1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestkit.functions.numeric import brier, clip, log_loss
from contestkit.session import cut

TENTHS = tuple(k * 0.1 for k in range(10)) + (1.0,)
#: Edges of the replay's buckets, and of its buckets of max(p, 1 - p). Fixed values.
EIGHTHS = (0.00, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 1.00)
CONFIDENCE = (0.50, 0.60, 0.70, 0.80, 1.00)


#: Ranges of probabilities whose distinct values one task orders.
AUC_RANGES = 256


def summary(clipped: bool = False) -> list[Column]:
    """Count, accuracy at p >= 0.5, log loss, Brier score, mean p and mean y, as aggregates."""
    p, y = (clip(F.col("p")) if clipped else F.col("p")), F.col("y")
    hit = ((p >= 0.5).cast("int") == y).cast("double")
    return [F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(log_loss(p, y)).alias("log_loss"), F.avg(brier(p, y)).alias("brier"), F.avg(p).alias("mean_p"), F.avg(y.cast("double")).alias("mean_y")]


def evaluate(rows: DataFrame, by: tuple[str, ...] = (), clipped: bool = False) -> DataFrame:
    return rows.groupBy(*by).agg(*summary(clipped))


def ties(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each distinct p with its numbers of ones and zeros: all that any figure needs of the rows."""
    return rows.groupBy(*by, "p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))


def auc(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve with ties at half, of each group; null for a single class. The rows are read once, to count ties."""
    return auc_of(cut(ties(rows, by)), by)


def auc_of(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``auc`` from the stored result of ``ties``.

    The ordered pass sees distinct values only; ranges of p between their quantiles are summed apart and brought together
    by a small prefix sum, so no task holds all of them, however p is spread.
    """
    cuts = counts.groupBy(*by).agg(F.percentile_approx("p", [k / AUC_RANGES for k in range(1, AUC_RANGES)], 10 * AUC_RANGES).alias("cuts"))
    same = lambda df: [F.col(f"_{c}").eqNullSafe(df[c]) for c in by]
    under = lambda df, other: df.join(F.broadcast(other), [*same(df)], "inner").drop(*[f"_{c}" for c in by]) if by else df.crossJoin(F.broadcast(other))
    renamed = lambda df: df.withColumnsRenamed({c: f"_{c}" for c in by})
    # a row a group: few
    ranged = under(counts, renamed(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("p")))).drop("cuts")
    parts = ranged.groupBy(*by, "part").agg(F.sum("neg").alias("neg_in_part"))  # at most AUC_RANGES rows a group
    lower = F.coalesce(F.sum("neg_in_part").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = parts.select(*by, F.col("part").alias("_part"), lower.alias("neg_lower"))
    ranked = ranged.join(F.broadcast(renamed(sums)), [*same(ranged), F.col("_part") == ranged["part"]])
    within = F.coalesce(F.sum("neg").over(Window.partitionBy(*by, "part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = F.sum(F.col("pos") * (F.col("neg_lower") + F.col("neg_before") + F.col("neg") / 2))
    return ranked.withColumn("neg_before", within).groupBy(*by).agg((won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def bundle(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``evaluate`` and the area under the curve of each group (MET-01): the rows are read once, to count ties, from which all figures follow."""
    counts = cut(ties(rows, by))
    n, p, one, zero = F.col("pos") + F.col("neg"), F.col("p"), F.lit(1), F.lit(0)
    mean = lambda a, b: F.sum(F.col("pos") * a + F.col("neg") * b) / F.sum(n)
    hit = (p >= 0.5).cast("int")
    figures = {"accuracy": mean(hit, 1 - hit), "log_loss": mean(log_loss(p, one), log_loss(p, zero)), "brier": mean(brier(p, one), brier(p, zero)), "mean_p": mean(p, p), "mean_y": mean(one, zero)}
    plain = counts.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"), *[c.alias(k) for k, c in figures.items()])
    area = auc_of(counts, by)
    if not by:
        return plain.crossJoin(F.broadcast(area))  # one row each
    renamed = area.withColumnsRenamed({c: f"_{c}" for c in by})
    joined = plain.join(F.broadcast(renamed), [F.col(f"_{c}").eqNullSafe(plain[c]) for c in by], "left")  # a row a group: few
    return joined.drop(*[f"_{c}" for c in by])


def bucket_of(p: Column, edges: tuple[float, ...]) -> Column:
    """Number of the bucket [low, high), the last closed; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        low, high = edges[k], edges[k + 1]
        inside = (p >= low) & ((p <= high) if k == len(edges) - 2 else (p < high))
        out = F.when(inside, k).otherwise(out)
    return out


def spine(spark: SparkSession, edges: tuple[float, ...]) -> DataFrame:
    return spark.createDataFrame([(k, f"{a:.1f}-{b:.1f}" if edges == TENTHS else f"{a:.2f}-{b:.2f}") for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bucket_no int, bucket string")


def calibration_table(rows: DataFrame, edges: tuple[float, ...] = TENTHS, confidence: bool = False) -> DataFrame:
    """Per bucket: count, mean p, mean y, gap, log loss and Brier score; empty buckets are there with count 0.

    With ``confidence`` the buckets are of the favoured side's probability, and y is whether it won.
    """
    if confidence:
        side = F.col("p") >= 0.5
        rows = rows.select(F.greatest("p", 1 - F.col("p")).alias("p"), F.when(side, F.col("y")).otherwise(1 - F.col("y")).alias("y"))
    filled = rows.withColumn("bucket_no", bucket_of(F.col("p"), edges)).groupBy("bucket_no").agg(*summary())
    joined = spine(rows.sparkSession, edges).join(F.broadcast(filled), "bucket_no", "left")  # as many rows as buckets
    return joined.select("bucket_no", "bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y", (F.col("mean_p") - F.col("mean_y")).alias("gap"), "log_loss", "brier")


def calibration_error(rows: DataFrame) -> DataFrame:
    """Mean absolute gap of the ten buckets, weighted by count (AGG-11)."""
    table = calibration_table(rows)
    return table.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def high_confidence(rows: DataFrame, thresholds: tuple[float, ...] = (0.7, 0.8), two_sided: bool = False) -> DataFrame:
    """Above each threshold (strictly): count, mean p, mean y and their gap, one row a threshold."""
    if two_sided:
        side = F.col("p") >= 0.5
        rows = rows.select(F.greatest("p", 1 - F.col("p")).alias("p"), F.when(side, F.col("y")).otherwise(1 - F.col("y")).alias("y"))
    sums = [x for k, t in enumerate(thresholds) for x in (F.count(F.when(F.col("p") > t, 1)).alias(f"n{k}"), F.avg(F.when(F.col("p") > t, F.col("p"))).alias(f"p{k}"), F.avg(F.when(F.col("p") > t, F.col("y").cast("double"))).alias(f"y{k}"))]
    row = rows.agg(*sums)
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{k}").alias("n"), F.col(f"p{k}").alias("mean_p"), F.col(f"y{k}").alias("mean_y"), (F.col(f"p{k}") - F.col(f"y{k}")).alias("gap")) for k, t in enumerate(thresholds)])).alias("r")).select("r.*")


def coverage(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Share of non-null values of each column, one row a column (AGG-13)."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("present"), (F.col(c) / F.col("n")).alias("coverage")) for c in columns])).alias("r")).select("r.*")


def drift(train: DataFrame, event: DataFrame, columns: tuple[str, ...], elevated: float = 0.10) -> DataFrame:
    """Event against training, one row a column (AGG-14): missing rates, shift in population deviations, values out of range."""
    stats = train.agg(*[x for c in columns for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}"), F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))])
    joined = event.crossJoin(F.broadcast(stats))  # one row on the right
    out = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNull().cast("double")).alias("missing_event"), F.max(f"m_{c}").alias("missing_train"), (F.avg(c) - F.max(f"a_{c}")).alias("mean_shift"), F.max(f"s_{c}").alias("sd"), F.count(F.when((F.col(c) < F.col(f"l_{c}")) | (F.col(c) > F.col(f"h_{c}")), 1)).alias("out_of_range")) for c in columns]
    rows = joined.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.withColumn("z_shift", F.col("mean_shift") / F.nullif("sd", F.lit(0.0))).withColumn("elevated", F.col("missing_event") - F.col("missing_train") > elevated)


def nan_heavy(rows: DataFrame, columns: tuple[str, ...], share: float = 0.5) -> DataFrame:
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / len(columns)
    return rows.agg(F.count(F.when(missing > share, 1)).alias("nan_heavy"))


def best_method(platt: dict, isotonic: dict, n_calibration: int, margin: float = 1e-3, least: int = 300) -> str:
    """Platt unless isotonic is clearly better on enough calibration rows (MET-03)."""
    edge, brier_edge = platt["log_loss"] - isotonic["log_loss"], platt["brier"] - isotonic["brier"]
    better = edge >= margin or (abs(edge) < margin and brier_edge >= margin)
    return "isotonic" if n_calibration >= least and better else "platt"


def fold_summary(rows: DataFrame, anchor: str) -> DataFrame:
    """Candidates (name, fold, log_loss) over folds: mean, population deviation, gain against the anchor fold by fold, and folds won (AGG-15, JOIN-19).

    Rows are stored before the anchor's are joined to them: worked out twice, the anchor could differ from itself in the last bit and win a fold.
    """
    rows = cut(rows)
    base = rows.filter(F.col("name") == anchor).select("fold", F.col("log_loss").alias("base"))
    both = rows.join(base, "fold", "left")
    return both.groupBy("name").agg(F.count("*").alias("n_folds"), F.avg("log_loss").alias("log_loss"), F.stddev_pop("log_loss").alias("log_loss_sd"), F.avg(F.col("base") - F.col("log_loss")).alias("gain"), F.count_if(F.col("log_loss") < F.col("base")).alias("folds_won"))


def stability(rows: DataFrame) -> DataFrame:
    """Coefficients (feature, fold, coefficient) over folds: mean, population deviation, folds with a nonzero one, and whether signs differ (AGG-21)."""
    c = F.col("coefficient")
    return rows.groupBy("feature").agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.count_if(c != 0).alias("nonzero"), ((F.min(c) < 0) & (F.max(c) > 0)).alias("sign_flip"))
