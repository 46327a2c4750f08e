"""Sequential ratings (WIN-02, INC-01).

A rating couples two entities, so bouts of one connected component are replayed in order. Rows stream through the
replay sorted by (component, date, fight_id); the state is one number an entity, never the bouts. Independent components
(leagues, tours, weight classes that never meet; ``with_leagues`` finds them) run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestkit.session import cut

K, START = 32.0, 1500.0
SNAPSHOT = "fight_id long, date date, a_id long, b_id long, a_won int, a_pre double, b_pre double, a_expected double, b_expected double, a_post double, b_post double, elo_diff double"


def elo(bouts: DataFrame, k: float = K, start: float = START, component: str | None = None, initial: dict[int, float] | None = None) -> DataFrame:
    """Snapshots of both ratings before and after every bout (fight_id, date, a_id, b_id, a_won)."""
    given = dict(initial or {})

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings: dict[int, float] = dict(given)
        part = None
        names = [f.split()[0] for f in SNAPSHOT.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            a_pre, b_pre, expected, a_post, b_post = out = [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("component", "a_id", "b_id", "a_won")]
            for c, a, b, won in zip(*columns, strict=True):
                if c != part:
                    part, ratings = c, dict(given)
                ra, rb = ratings.get(a, start), ratings.get(b, start)
                ea = 1.0 / (1.0 + 10.0 ** ((rb - ra) / 400.0))
                ratings[a], ratings[b] = na, nb = ra + k * (won - ea), rb + k * ((1 - won) - (1.0 - ea))
                a_pre.append(ra), b_pre.append(rb), expected.append(ea), a_post.append(na), b_post.append(nb)
            ra, rb, ea, na, nb = map(np.array, out)
            rest = [pa.array(x) for x in (ra, rb, ea, 1.0 - ea, na, nb, ra - rb)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), *rest], names=names)

    part = F.col(component).cast("string") if component else F.lit("all")
    rows = bouts.select(part.alias("component"), "fight_id", "date", "a_id", "b_id", F.col("a_won").cast("int").alias("a_won"))
    return rows.repartition("component").sortWithinPartitions("component", "date", "fight_id").mapInArrow(replay, SNAPSHOT)


def with_leagues(bouts: DataFrame) -> DataFrame:
    """Adds league, the smallest entity that a chain of bouts links to: ratings of different leagues never meet, so each is a replay of its own.

    Every round gives each entity the smallest label among its opponents and then that label's own label, so that labels travel twice as far
    with each round; the pairs are distinct, and labels are stored between rounds.
    """
    pairs = bouts.select("a_id", "b_id").filter("a_id <> b_id").distinct()
    edges = cut(pairs.union(pairs.select("b_id", "a_id")).toDF("u", "v").distinct())
    labels = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("least"))
        met = labels.join(near, "u").select("u", F.least("label", "least").alias("label"))
        after = cut(met.join(met.select(F.col("u").alias("label"), F.col("label").alias("further")), "label", "left").select("u", F.coalesce("further", "label").alias("label")))
        if not after.join(labels.withColumnRenamed("label", "before"), "u").filter("label <> before").take(1):
            break
        labels = after
    return bouts.join(labels.select(F.col("u").alias("a_id"), F.col("label").alias("league")), "a_id", "left").withColumn("league", F.coalesce("league", "a_id"))


def elo_by_league(bouts: DataFrame, k: float = K, start: float = START) -> DataFrame:
    """``elo`` with each league that ``with_leagues`` finds replayed on its own: the same snapshots, and a task sorts and holds a league, not all bouts."""
    return elo(with_leagues(cut(bouts.select("fight_id", "date", "a_id", "b_id", "a_won"))), k, start, "league")


def baseline(snapshots: DataFrame, bouts: DataFrame, names: DataFrame) -> DataFrame:
    """Snapshots with names (JOIN-01): inner joins for the sides, a left one for the winner; names is (entity, name)."""
    side = lambda p: names.select(F.col("entity").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    winner = F.when(F.col("a_won") == 1, F.col("a_id")).when(F.col("a_won") == 0, F.col("b_id"))
    joined = snapshots.join(bouts.select("fight_id"), "fight_id").join(side("a"), "a_id").join(side("b"), "b_id")
    return joined.withColumn("winner_id", winner).join(side("winner"), "winner_id", "left")


def standings(snapshots: DataFrame) -> DataFrame:
    """Per entity: bouts, wins, losses, last day (AGG-01) and the latest rating (WIN-01), in one aggregation."""
    row = lambda p, w: F.struct(F.col(f"{p}_id").alias("entity"), w.alias("won"), F.col(f"{p}_post").alias("rating"))
    long = snapshots.select("date", "fight_id", F.explode(F.array(row("a", F.col("a_won")), row("b", 1 - F.col("a_won")))).alias("r")).select("date", "fight_id", "r.*")
    return long.groupBy("entity").agg(F.count("*").alias("fights"), F.sum("won").alias("wins"), (F.count("*") - F.sum("won")).alias("losses"), F.max("date").alias("last_date"), F.max_by("rating", F.struct("date", "fight_id")).alias("rating"))
