import random

import numpy as np
import pytest

from contestkit.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, VEC string, `n` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def exact(vectors):
    """x, and the scatter of n x - S in Python's whole numbers."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    return x, y, [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]


def test_remainders_and_primes():
    moduli = whitening.primes(1 << 90)
    assert len(moduli) == 5 and all(p < 1 << 20 and pow(2, p - 1, p) == 1 for p in moduli) and len(set(moduli)) == 5
    for v in (0, 1, -1, 10**27, -(10**27), 12345678901234567890):
        assert whitening.remainders([v % p for p in moduli], moduli) == v


@pytest.mark.parametrize("scale", [1.0, 3000.0])
def test_scatter_is_exact(spark, scale):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 7)) * scale * np.array([1, 100, 1e-3, 1, 5, 1, 1])).astype(np.float32).tolist()
    rows = whitening.usable(table(spark, enumerate(vectors)).repartition(5), "vec_id", "embedding")
    n, sums, width = whitening._sums(rows, 64, 1_000_000)
    x, _, want = exact(vectors)
    assert n == 300 and sums == [sum(r[j] for r in x) for j in range(7)]
    assert whitening.scatter(rows, n, sums, width) == want


def test_query_against_plain_numbers(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 40)) @ np.diag(np.linspace(0.05, 4, 40))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 39), (903, [float("nan")] * 40), (904, [1.0] * 39 + [float("inf")]), (905, [2.0] * 3)]
    odd = [(3, rows[3][1]), (None, rows[4][1]), (700, [0.0] * 40)]
    table(spark, rows + bad + odd).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_embedding_whitening(spark, str(tmp_path)).collect()
    kept = rows + odd
    x, y, scatter = exact([v for _, v in kept])
    n = len(kept)
    assert len(got) == 32 * n and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 33))
    v = np.array([[s / n**3 for s in row] for row in scatter])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    z = (np.array(y) / n) @ u[:, :32] / np.sqrt(e[:32])
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for k in range(1, 33):
        mine = np.array([by[i][k][0]["whitened"] for i, _ in kept])
        assert min(np.abs(mine - z[:, k - 1]).max(), np.abs(mine + z[:, k - 1]).max()) < 1e-8
        assert abs(by[0][k][0]["explained"] / (e[k - 1] / np.trace(v)) - 1) < 1e-9
    assert all(by[i][1][0]["deviation"] == sum(c * c for c in y[at]) for at, (i, _) in enumerate(kept))
    assert len(by[3][1]) == 2 and by[3][1][0] == by[3][1][1] and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_odd_tables(spark):
    none = whitening.by_component(*whitening.whiten(table(spark, [(1, None), (2, [float("nan")])])))
    assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.by_component(*whitening.whiten(table(spark, []))).collect() == []
    one = whitening.by_component(*whitening.whiten(table(spark, [(1, [1.0, 2.0])]))).collect()
    assert [(r["component"], r["deviation"], r["whitened"]) for r in one] == [(1, 0, None), (2, 0, None)]
    flat = whitening.by_component(*whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0])]))).collect()
    first = sorted((r["vec_id"], round(abs(r["whitened"]), 9)) for r in flat if r["component"] == 1)
    assert first == [(1, round(1.5**0.5, 9)), (2, 0.0), (3, round(1.5**0.5, 9))] and {r["whitened"] for r in flat if r["component"] == 2} == {None}


def test_deviations_beyond_a_long():
    rng = random.Random(1)
    model = whitening.Model(10**9, [rng.randrange(10**15) for _ in range(4)], np.ones(4), np.eye(4), 4.0)
    x = np.array([[s // model.n + k for s in model.sums] for k in (0, 1, 2, 3, -2, 10**6)])
    want = [sum((model.n * int(c) - s) ** 2 for c, s in zip(r, model.sums, strict=True)) for r in x]
    assert model.deviations(x) == [w if w < 1 << 63 else None for w in want]
