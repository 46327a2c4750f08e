import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestkit.operators import boosting, models

FEATURES = ["x", "z", "few", "none"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = []
    for k in range(5000):
        x, few = rng.gauss(0, 1), rng.randrange(4)
        gone = rng.random() < (0.5 if x > 0.5 else 0.1)  # missing values tell something
        y = int(rng.random() < 1 / (1 + math.exp(-(2 * x * (few - 1.5) + (1.5 if gone else 0)))))
        data.append((k, x, None if gone else rng.gauss(0, 1), float(few) if k % 11 else float("nan"), None, y))
    return spark.createDataFrame(data, "fight_id long, x double, z double, few double, none double, y int").repartition(7).cache()


def plain(x, y, cuts, rounds, leaves, rate, least_leaf, l2):
    """Each split searched by itself over raw values: (trees as nested tuples, scores)."""
    score = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    trees = []

    def gain_of(at, g, h):
        best = None
        for f in range(x.shape[1]):
            none = np.isnan(x[at, f])
            for missing_left in (False, True) if none.any() else (False,):
                for edge in [*cuts[f], math.inf]:
                    left = np.where(none, missing_left, x[at, f] <= edge)
                    gl, hl, gr, hr = g[at][left].sum() / boosting.ONE, h[at][left].sum() / boosting.ONE, g[at][~left].sum() / boosting.ONE, h[at][~left].sum() / boosting.ONE
                    if min(left.sum(), (~left).sum()) < max(1, least_leaf) or min(hl, hr) < boosting.LEAST_HESSIAN:
                        continue
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gl + gr) ** 2 / (hl + hr + l2)
                    if gain > 0 and (best is None or gain > best[0] + 1e-12 * gain):
                        best = (gain, f, edge, missing_left, at[left], at[~left])
        return best

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = np.rint((p - y) * boosting.ONE), np.rint(p * (1 - p) * boosting.ONE)
        count, root = 0, {"at": np.arange(len(y))}
        root["best"] = gain_of(root["at"], g, h)
        heap, made = ([(-root["best"][0], 0, root)] if root["best"] else []), 1
        while heap and made < leaves:
            _, _, node = heapq.heappop(heap)
            node["children"] = [{"at": a} for a in node["best"][4:]]
            made += 1
            for c in node["children"]:
                c["best"] = gain_of(c["at"], g, h)
                if c["best"]:
                    count += 1
                    heapq.heappush(heap, (-c["best"][0], count, c))

        def finish(node, g=g, h=h):
            if "children" in node:
                return (node["best"][1], node["best"][2], node["best"][3] if np.isnan(x[node["at"], node["best"][1]]).any() else None, *map(finish, node["children"]))
            own = node["at"]
            v = -rate * (g[own].sum() / boosting.ONE) / (h[own].sum() / boosting.ONE + l2)
            score[own] += v
            return round(v, 9)

        trees.append(finish(root))
    return trees, score


def nested(tree, seen, at=0):
    """The tree as nested tuples; the way of missing values only where ``seen`` has some."""
    if tree.left[at] < 0:
        return round(tree.value[at], 9)
    return (tree.feature[at], tree.edge[at], tree.missing_left[at] if seen[tree.feature[at]] else None, nested(tree, seen, tree.left[at]), nested(tree, seen, tree.right[at]))


@pytest.mark.parametrize("l2", [0.0, 5.0])
def test_trees_equal_plain_numpy(rows, l2):
    model = boosting.fit(rows, FEATURES, "y", rounds=3, leaves=7, rate=0.3, least_leaf=40, l2=l2, bins=32)
    data = rows.orderBy("fight_id").select(*FEATURES, "y").toPandas()
    x, y = data[FEATURES].to_numpy(float), data["y"].to_numpy(float)
    cuts = boosting.edges(rows, FEATURES, 32)
    assert len(cuts[0]) == 31 and cuts[2] == [0.0, 1.0, 2.0] and cuts[3] == []
    want, score = plain(x, y, cuts, 3, 7, 0.3, 40, l2)
    drop = lambda t: t if not isinstance(t, tuple) else (t[0], t[1], drop(t[3]), drop(t[4]))
    assert [drop(nested(t, [False] * 4)) for t in model.trees] == [drop(t) for t in want]
    assert all(t.leaves == 7 for t in model.trees)
    applied = model.start + sum(t.values(x) for t in model.trees)
    assert np.abs(applied - score).max() < 1e-9


def test_more_leaves_and_rounds_fit_better_and_penalties_differ(rows):
    loss = lambda fit: fit.predict(rows).agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))).first()[0]
    few, more, ridge = (models.boosted(rows, FEATURES, "y", rounds=n, leaves=6, rate=0.3, l2=l2) for n, l2 in ((1, 0.0), (12, 0.0), (12, 50.0)))
    assert loss(more) < loss(few) - 0.02 and abs(loss(more) - loss(ridge)) > 1e-4
    assert len(more.model.trees) == 12 > boosting.STORE_EVERY


def test_early_stopping_and_artifacts(rows, spark, tmp_path):
    stopped = boosting.fit(rows.withColumn("y", (F.rand(3) > 0.5).cast("int")), ["x"], "y", rounds=40, leaves=8, rate=0.5, held=F.col("fight_id") % 5 == 0, patience=3)
    assert len(stopped.trees) < 40 and len(stopped.losses) > 3
    fit = models.boosted(rows, FEATURES, "y", rounds=2, leaves=4, held=0.1)
    version = models.save(fit, f"file://{tmp_path}/b", "v1")
    again, manifest = models.load(f"file://{tmp_path}/b", FEATURES)
    assert manifest["feature_schema_version"] == version and again.model.trees == fit.model.trees
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (2, 1.0, float("nan"), 9.0, 3.0, 0)], rows.schema)
    assert [r["p"] for r in fit.predict(odd).collect()] == [r["p"] for r in again.predict(odd).collect()]


def test_degenerate_tables(rows, spark):
    empty = boosting.fit(rows.limit(0), FEATURES, "y")
    assert empty.trees == [] and empty.start == 0.0
    assert boosting.fit(rows.filter("y = 1"), FEATURES, "y").trees == []
    constant = boosting.fit(rows.withColumns({"x": F.lit(1.0), "y": F.when(F.col("fight_id") % 7 > 0, F.col("y"))}), ["x"], "y", rounds=3)
    assert constant.trees == []


def test_first_gains_are_the_first_split(rows):
    cuts = boosting.edges(rows, ["x", "few"], 16)
    table = boosting.first_gains(rows, ["x", "few"], "y", cuts).collect()
    best = max(table, key=lambda r: r["gain"])
    tree = boosting.fit(rows, ["x", "few"], "y", rounds=1, leaves=2, least_leaf=1, bins=16).trees[0]
    assert (["x", "few"][tree.feature[0]], tree.edge[0]) == (best["feature"], best["edge"] if best["edge"] is not None else math.inf)
