import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from contestkit.llm import periods, queries


def brute(w, least=24, times=3):
    """Every stretch of equality at every distance."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def digest(doc_id, text):
    w = periods.words_of(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    out = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in out)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def test_runs_against_brute_force():
    r = random.Random(3)
    found = 0
    for _ in range(1500):
        kinds, w = r.choice([1, 2, 2, 3, 50]), []
        while len(w) < r.randint(0, 300):
            w += [r.randrange(kinds) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30]))] * r.choice([1, 1, 2, 3, 4, 9])
            if r.random() < 0.3:
                w += w[-r.randint(1, 40) :] * r.randint(1, 4)
        w = w[:350]
        assert periods.find_runs(w) == brute(w), w
        assert periods.find_runs(w, 9, 2) == brute(w, 9, 2), w
        found += len(brute(w))
    assert found > 500


def test_borders_of_the_rule():
    assert periods.find_runs([7] * 23) == [] and periods.find_runs([7] * 24) == [(0, 24, 1)]
    unit = list(range(10))
    assert periods.find_runs([*unit * 2, *unit[:9]]) == [] and periods.find_runs(unit * 3) == [(0, 30, 10)]
    assert periods.find_runs([99, *unit * 3, *unit[:3], 98]) == [(1, 33, 10)]
    # a run of one period within a run of another
    inner = [0] * 30 + [1]
    assert periods.find_runs(inner * 3) == brute(inner * 3)
    assert periods.kept_words(list("abcdefgh"), [(1, 4, 1), (2, 3, 2)]) == ["a", "b", "f", "g", "h"]


@pytest.mark.parametrize("w", [[0] * 200_000, [0, 1] * 100_000, [bin(i).count("1") % 2 for i in range(200_000)], list(range(1000)) * 200, list(range(100_000)) * 2], ids=["one word", "two words", "cube-free", "long unit", "square"])
def test_long_texts_take_near_linear_time(w):
    began = time.process_time()
    periods.find_runs(w)
    assert time.process_time() - began < 30


def test_query_against_brute_force(spark, tmp_path, sf_dir):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.choice([5, 30, 200])))) for i in range(150)]
    rows += [(1000 + i, "\t" + " la la\n" * i) for i in range(9, 16)] + [(None, "x " * 30), (7, "x " * 30), (7, "x " * 30), (8, None), (9, ""), (10, " \n "), (11, "é ü " * 40), (12, "a b " * 20 + "x y z " * 20 + "w")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, RUNS int, `t` string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((digest(d, t) for d, t in rows), key=repr)
    assert any(r[1] > 1 for r in got)
    small = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert small == sorted(digest(d, t) for d, t in texts.items() if len(t or "") < 10**7)


def test_operator_and_empty_table(spark, odd):
    rows = odd.select("doc_id", periods.periodic_runs()(F.col("text")).alias("t")).select("doc_id", "t.*").collect()
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in rows if r["runs"]} == {4: [(0, 40_000, 1)]}  # one word, 40,000 times
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert odd.limit(0).select(periods.periodic_runs()(F.col("text")).alias("t")).collect() == []
    one = spark.createDataFrame([("go on " * 20 + "end",)], "text string").select(periods.periodic_runs()(F.col("text")).alias("t")).first()["t"]
    assert one["kept"] == "go on end" and [tuple(r) for r in one["runs"]] == [(0, 40, 2)]


def test_query_against_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("a b c d".split()) for _ in range(rng.choice([5, 30, 150])))) for i in range(120)]
    rows += [(1000 + i, "go on\t" * i + "end " + "x y z " * i) for i in range(8, 20)] + [(5000, None), (5001, ""), (5002, " \n "), (5003, "w " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    mine = queries.op11_periodic_runs(spark, str(tmp_path))
    found = base.execute(queries.ORACLES["op11_periodic_runs"])
    assert [d[0] for d in found.description] == mine.columns
    assert sorted(found.fetchall(), key=repr) == sorted(map(tuple, mine.collect()), key=repr)
