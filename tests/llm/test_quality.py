import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from contestkit.llm import quality, queries


def plain_bins(text):
    mask = (1 << 64) - 1
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", data)]
    hashed = []
    for a, b in spans:
        h = 0
        for k, c in enumerate(data[a:b]):
            h = (h + ((c + 32 if 65 <= c <= 90 else c) + 1) * pow(quality._STEP, k, 1 << 64)) & mask
        hashed.append(h)
    both = hashed + [(x * 0x9E3779B97F4A7C15 + (y ^ 0xC2B2AE3D27D4EB4F)) & mask for x, y in zip(hashed, hashed[1:])]
    return [((h ^ h >> 29) * 0xFF51AFD7ED558CCD & mask) >> 48 for h in both]


def test_bins_against_plain_hashing():
    hasher = quality.Hasher()
    for text in ("", "  ", "One", "one TWO, three-four é5 ", "a " * 500):
        assert hasher.bins(text.encode()).tolist() == plain_bins(text)


def test_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] == 1}
    bins = {d: plain_bins(t or "") for d, t in docs.items()}
    raw, target = Counter(), Counter()
    for d, own in bins.items():
        raw.update(own)
        if d in good:
            target.update(own)
    total = [sum(c.values()) + quality.BINS for c in (target, raw)]
    rows = queries.op7_importance_resampling(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = sum(math.log((target[b] + 1) / total[0]) - math.log((raw[b] + 1) / total[1]) for b in bins[r["doc_id"]])
        assert r["log_weight"] == pytest.approx(want, abs=1e-6)
    keys = sorted((r["sample_key"] for r in rows), reverse=True)
    assert {r["doc_id"] for r in rows if r["sampled"]} == {r["doc_id"] for r in rows if r["sample_key"] >= keys[len(rows) // 2 - 1]}


@pytest.mark.parametrize("k", [0, 1, 7, 50, 199, 200, 300])
def test_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 0.5, -3.0]) for _ in range(200)]
    got = quality.largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k)
    assert got == (None if k == 0 else sorted(values, reverse=True)[min(k, 200) - 1])


def test_noise_is_gumbel(spark):
    from pyspark.sql import functions as F

    noise = np.array([r[0] for r in spark.range(20_000).select(quality.gumbel(F.col("id"))).collect()])
    assert abs(noise.mean() - 0.5772) < 0.04 and abs(noise.var() - math.pi**2 / 6) < 0.08


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 1), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    rows = quality.resample(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality.resample(odd.limit(0), labels).collect() == []
    assert quality.resample(odd, labels.limit(0)).count() == odd.count()
