import numpy as np
from pyspark.sql import functions as F

from contestkit.llm import neighbours, queries


def plain(vectors, wanted, k):
    out = {}
    for q in wanted:
        near = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out[q] = near[:k]
    return out


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, KEY string")


def test_recall_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = plain(vectors, [i for i in vectors if i % 100 == 0], 10)
    rows = queries.op5_nearest_neighbours(spark, sf).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert abs(r["score"] - np.sqrt(((vectors[r["query_id"]] - vectors[r["vec_id"]]) ** 2).sum())) < 1e-12
    assert all(len(x) == 10 and x == sorted(x) for x in got.values()) and got.keys() == want.keys()
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    same = [1.0, 2.0, 3.0]
    vectors = [(i, same) for i in range(0, 60)] + [(100 + i, [float(x) for x in rng.standard_normal(3)]) for i in range(30)] + [(5, same)]
    bad = [(900, None), (1000, [0.0, 0.0, 0.0]), (1100, [1.0, None, 2.0]), (1200, [1.0, float("nan"), 2.0]), (1300, [float("inf"), 0.0, 1.0]), (1400, [1.0]), (None, same)]
    rows = neighbours.nearest(table(spark, vectors + bad), F.col("vec_id") % 50 == 0, 10).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == list(range(1, 11)) and got[50] == list(range(10)) and set(got) == {0, 50, 100}
    kept = {i: np.array(np.array(v, dtype=np.float32), dtype=float) for i, v in vectors}
    assert got[100] == [i for _, i in plain(kept, [100], 10)[100]]
    few = neighbours.nearest(table(spark, [(0, [1.0]), (3, [2.0])]), F.col("vec_id") == 0, 10).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in few] == [(1, 3, 1.0)]
    assert neighbours.nearest(table(spark, bad), F.lit(True)).collect() == []
    assert neighbours.nearest(table(spark, []), F.lit(True)).collect() == []


def test_clustered_vectors_need_few_comparisons(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 900)
    rng = np.random.default_rng(4)
    centres = 3 * rng.standard_normal((60, 16))
    points = (centres[rng.integers(60, size=6000)] + 0.4 * rng.standard_normal((6000, 16))).astype(np.float32)
    forest = neighbours.Forest.fit(points.astype(float), 10)
    assert forest.enough <= 0.3 * len(points)
    vectors = {i: p.astype(float) for i, p in enumerate(points)}
    want = plain(vectors, range(0, 6000, 100), 10)
    got = {}
    for r in neighbours.nearest(table(spark, [(i, [float(x) for x in p]) for i, p in vectors.items()]), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in want]) >= 0.95


def test_a_thin_sample_is_measured_on_the_whole_table(spark, monkeypatch):
    """Far more rows than sample: large leaves are split further, and a query is compared with the rows that it needs, not with a share of all."""
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 600)
    rng = np.random.default_rng(8)
    centres = 3 * rng.standard_normal((400, 12))
    points = (centres[rng.integers(400, size=40_000)] + 0.3 * rng.standard_normal((40_000, 12))).astype(np.float32)
    vectors = points.astype(float)
    compared, plain_closest = [0], neighbours.closest

    def counting(asked, block, ids, best, keep):
        compared[0] += len(asked) * len(block)
        plain_closest(asked, block, ids, best, keep)

    held = neighbours.Held.of([neighbours._rows([np.zeros(5000, int)] * 3, 0, [[0]] * 5000, list(range(5000)), [[i] for i in range(5000)], list(vectors[:5000]))], neighbours.WIDEN)
    monkeypatch.setattr(neighbours, "closest", counting)
    asking = neighbours._rows([np.zeros(50, int)] * 3, 1, [[0]] * 50, list(range(50)), [[0]] * 50, list(vectors[:50]))
    assert all(found[0] == (0.0, i) for i, found in enumerate(held.nearest(asking, 11))) and compared[0] <= 50 * (5000 / neighbours.WIDEN + 2 * neighbours.LEAF_ROWS)
    monkeypatch.setattr(neighbours, "closest", plain_closest)
    table_ = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in neighbours.nearest(table_, F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {}
    for q in range(0, 40_000, 400):
        far = ((vectors - vectors[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        want[q] = set(np.argsort(far, kind="stable")[:10].tolist())
    assert got.keys() == want.keys() and np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.93
