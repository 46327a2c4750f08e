import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contestkit.llm import graph, queries, simhash

from .conftest import documents


def plain_print(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for c in b"\t\n\v\f\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (doc_id, fingerprint) pairs; all pairs compared."""
    ids = [d for d, _ in prints]
    fps = np.array([f for _, f in prints], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3).tolist():
            root[find(i)] = find(j)
    least = {}
    for k, d in enumerate(ids):
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: least[find(k)] for k, d in enumerate(ids)}


def test_query_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    prints = [(r["doc_id"], plain_print(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op8_simhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{f:016x}" for d, f in prints}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(prints)


@pytest.mark.parametrize("block", [4, 256])
def test_links_join_what_all_pairs_join(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(25)}
    prints = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.links(prints).collect()
    for r in links:
        assert bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 3
    numbered = sorted(np.array([r["fp"] for r in prints.collect()]).tolist())
    want = plain_components([(f, f & (2**64 - 1)) for f in numbered])
    got = {r["node"]: r["root"] for r in graph.components(simhash.links(prints)).collect()}
    assert {f: got.get(f, f) for f in numbered} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    assert {c for d, f, c in rows if f == "0" * 16} == {1}
    assert sorted((d or 0, c) for d, f, c in rows if f == f"{plain_print('one two three four'):016x}") == [(0, 5), (5, 5), (5, 5), (7, 5)]
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 8, 9]
    assert simhash.keep_one(odd.limit(0)).collect() == []
    alone = simhash.keep_one(documents(spark, [(None, "x y z"), (None, "x y z")]))
    assert [r["text"] for r in alone.collect()] == ["x y z"]


def test_rows_are_kept_by_their_own_text(spark):
    a, b = "one two three four five", "quite another text with words of its own"
    docs = documents(spark, [(3, a), (5, a), (5, b), (5, b), (None, a), (None, "a third text that nobody else has"), (2, b + " ")])
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(3, a), (2, b + " "), (None, "a third text that nobody else has")], key=str)
    same = docs.withColumn("source", F.when(F.col("text") == a, "z").otherwise("s")).unionByName(documents(spark, [(3, a)]))
    rows = [simhash.keep_one(same.repartition(k)).filter("doc_id = 3").collect() for k in (1, 3, 5)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 1


def test_hot_fingerprint(spark, monkeypatch):
    rows = [(k, "the same text") for k in range(60)] + [(100 + k, f"text {k} of {k} others {k * k}") for k in range(40)]
    want = sorted(simhash.near_duplicates(documents(spark, rows)).collect())
    monkeypatch.setattr(simhash, "HOT", 10)
    assert sorted(simhash.near_duplicates(documents(spark, rows)).collect()) == want
