import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from contestkit.llm import queries, toxicity

from .conftest import documents


def plain_segments(scores):
    """Recursive definition: the best segment (shortest of ties), then those left and right of it."""
    def best(lo, hi):
        found = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if found[0] <= 0:
            return []
        a, b = -found[2], found[3]
        return [*best(lo, a), (a, b), *best(b, hi)]

    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(20))
def test_segments_against_brute_force(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(18)]
    assert [(a, b) for _, a, b in toxicity.maximal_segments(scores)] == plain_segments(scores)


def corpus(rng, n):
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["idiot", "scumbag", "moronic", "vileness"]
    rows = []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 200))]
        toxic = k % 5 == 0
        if toxic:
            at = rng.randint(0, len(words))
            words[at:at] = rng.sample(bad, 3)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_finds_passage_and_unseen_forms(spark):
    rows = corpus(random.Random(1), 800)
    docs = documents(spark, [(d, t) for d, t, _ in rows])
    labels = spark.createDataFrame([(d, 1, x) for d, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    test = documents(spark, [(1, "idiot moronic scumbag"), (2, "aaaaa " * 300), (3, ""), (4, None), (5, "? !"), (6, "bcdef " * 50 + "you idiots and scumbags moronically " + "bcdef " * 50)])
    got = {r["doc_id"]: r["t"] for r in test.select("doc_id", toxicity.toxicity(model)(test["text"]).alias("t")).collect()}
    flagged = {d for d, t in got.items() if t["score"] >= toxicity.THRESHOLD}
    assert flagged == {1, 6}
    assert got[3]["score"] == got[4]["score"] == got[5]["score"] and not got[3]["passages"]
    assert all(0 <= t["score"] <= 1 for t in got.values())
    assert any(p["start"] >= 50 and p["end"] <= 55 for p in got[6]["passages"])
    kept = toxicity.drop_toxic(test, model)
    assert kept.columns == test.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op2_toxic_segments(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    hit = sum(r["predicted"] and toxic[r["doc_id"]] for r in rows)
    said, are = sum(r["predicted"] for r in rows), sum(toxic[r["doc_id"]] for r in rows)
    assert hit / said > 0.95 and hit / are > 0.85


def plain_scores(fit, held, texts):
    """Score of each text by the method as told: own counts, every pair of borders tried for the best segments, own statistic and calibration."""
    words = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
    chain = lambda w: [w[:n] for n in (3, 4, 5, 6) if n < len(w)] + [w + "$"]
    counts = {}
    for text, toxic in fit:
        for w in set(words(text)):
            for f in chain(w):
                own = counts.setdefault(f, [0, 0])
                own[not toxic] += 1
    counts = {f: c for f, c in counts.items() if sum(c) >= 3}
    totals = [sum(c[k] for f, c in counts.items() if f.endswith("$")) for k in (0, 1)]
    share = (totals[0] + 0.5) / (sum(totals) + 1)

    def belief(f):
        stem = f.removesuffix("$")
        shorter = [stem[:n] for n in (6, 5, 4, 3) if n < len(stem) and stem[:n] in counts]
        prior = belief(shorter[0]) if shorter else share
        return (counts[f][0] + 4 * prior) / (sum(counts[f]) + 4)

    odds = {}
    for f, (t, c) in counts.items():
        x = math.log(belief(f) / (1 - belief(f))) - math.log(share / (1 - share))
        odds[f] = x if x > 0 and x >= 3 * math.sqrt(1 / (t + 4 * share) + 1 / (c + 4 * (1 - share))) else 0.0
    marked = [sum(counts[f][k] for f in odds if f.endswith("$") and odds[f] > 0) for k in (0, 1)]
    other = min(-1e-3, math.log(1 - marked[0] / totals[0]) - math.log(1 - marked[1] / totals[1]))

    def score_of(w):
        known = [odds[f] for f in chain(w) if f in odds]
        return known[-1] if known and known[-1] > 0 else other

    segments = lambda s: sorted((sum(s[a:b]) for a, b in plain_segments(s)), reverse=True)
    rows = [([score_of(w) for w in words(t)], toxic) for t, toxic in held]
    clean = [s for s, toxic in rows if not toxic and s]
    every = [x for s in clean for x in s]
    low, high = 1e-9, 200.0
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(math.exp(min(700, mid * x)) for x in every) < len(every) else (low, mid)
    lam = low if max(every) > 0 else 1.0
    k = len(clean) / sum(len(s) * math.exp(-lam * max(segments(s), default=0.0)) for s in clean)

    def evidence(s):
        best = total = 0.0
        for r, x in enumerate(segments(s), 1):
            if lam * x <= math.log(k * len(s)):
                break
            total += lam * x - math.log(k * len(s))
            if total > r:
                best = max(best, total - (r - 1) * math.log(total) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        return best

    x, y = [evidence(s) for s, _ in rows], [toxic for _, toxic in rows]
    goal = [(sum(y) + 1) / (sum(y) + 2) if t else 1 / (len(y) - sum(y) + 2) for t in y]
    a, b = 0.1, -1.0
    for _ in range(500):
        p = [1 / (1 + math.exp(-(a * v + b))) for v in x]
        g = [sum((q - t) * v for q, t, v in zip(p, goal, x, strict=True)), sum(q - t for q, t in zip(p, goal, strict=True))]
        h = [sum(q * (1 - q) * v * v for q, v in zip(p, x, strict=True)) + 1e-6, sum(q * (1 - q) * v for q, v in zip(p, x, strict=True)), sum(q * (1 - q) for q in p) + 1e-6]
        det = h[0] * h[2] - h[1] ** 2
        step = (h[2] * g[0] - h[1] * g[1]) / det, (h[0] * g[1] - h[1] * g[0]) / det
        a, b = a - max(-1, min(1, step[0])), b - max(-1, min(1, step[1]))
    a = max(a, 1e-3)
    # the cut with the best F1, midway to the next value below
    values = sorted(set(x), reverse=True)
    f1 = {v: 2 * sum(t for w, t in zip(x, y, strict=True) if w >= v) / (sum(w >= v for w in x) + sum(y)) for v in values}
    top = max(values, key=lambda v: (f1[v], v))
    cut = (top + next((v for v in values if v < top), 0.0)) / 2
    shift = math.log(0.7 / 0.3) - a * cut
    return [1 / (1 + math.exp(-(a * evidence([score_of(w) for w in words(t)]) + shift))) for t in texts]


def test_query_against_plain_scores(spark, tmp_path):
    rows = [(d, " ".join(t.split()[:40]) if not x else t, x) for d, t, x in corpus(random.Random(4), 300)]
    rows = [(d, " ".join(w for i, w in enumerate(t.split()) if i < 40 or w in ("idiot", "scumbag", "moronic", "vileness")), x) for d, t, x in rows]
    odd_ones = [(1001, None), (1002, ""), (1003, "idiots scumbag moronically vile"), (1003, "idiot " * 6), (None, "idiot moronic scumbag"), (1004, "Idiot-moronic, SCUMBAG! 7")]
    docs = documents(spark, [(d, t) for d, t, _ in rows] + odd_ones)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, x) for d, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    taught = [(d, t, x) for d, t, x in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    dealt = spark.createDataFrame(taught, "doc_id long, text string, toxic int").select("text", "toxic", (F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(4)) == 0).alias("held")).collect()
    parts = [[(r["text"], r["toxic"]) for r in dealt if r["held"] == h] for h in (False, True)]
    got = queries.op2_toxic_segments(spark, str(tmp_path)).collect()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    want = {}
    for (d, t), score in zip(texts, plain_scores(*parts, [t for _, t in texts]), strict=True):
        want.setdefault(d, []).append(score)
    mine = {}
    for r in got:
        mine.setdefault(r["doc_id"], []).append(r["score"])
        assert r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert mine.keys() == want.keys() and all(sorted(mine[d]) == pytest.approx(sorted(want[d]), abs=1e-6) for d in want)
    assert {r["predicted"] for r in got} == {0, 1}


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        model = toxicity.train(odd, labels)
        assert toxicity.drop_toxic(odd, model).count() == odd.count()
    assert toxicity.drop_toxic(odd.limit(0), toxicity.train(odd.limit(0), none)).collect() == []


def test_every_use_of_a_word_scores(spark):
    rows = corpus(random.Random(1), 800)
    docs = documents(spark, [(d, t) for d, t, _ in rows])
    labels = spark.createDataFrame([(d, 1, x) for d, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    bad, gap = "idiot scumbag moronic vileness ", "bcdef " * 2500  # so long that no segment crosses it
    singly = gap.join(f"{w} " for w in bad.split()) + gap
    test = documents(spark, [(1, gap + bad + gap + bad + gap), (2, singly + bad + gap), (3, singly)])
    got = {r["doc_id"]: r["t"] for r in test.select("doc_id", toxicity.toxicity(model)(test["text"]).alias("t")).collect()}
    found = {d: {(p["start"], p["end"]) for p in t["passages"]} for d, t in got.items()}
    assert {(2500, 2504), (5004, 5008)} == found[1]
    assert (10004, 10008) in found[2]
    assert max(p["score"] for p in got[2]["passages"]) > max((p["score"] for p in got[3]["passages"]), default=0)


def test_query_with_odd_rows(spark, odd, tmp_path):
    odd.withColumn("score", odd["TEXT_"]).write.parquet(f"{tmp_path}/one/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 1), (5, 0, 0), (8, 1, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/one/labels.parquet")
    rows = queries.op2_toxic_segments(spark, f"{tmp_path}/one").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert queries.op2_toxic_segments(spark, f"{tmp_path}/none").collect() == []


def test_segments_take_linear_time():
    import time

    began = time.process_time()
    for scores in ([1, -2] * 500_000, [1, -2] * 250_000 + [3, -0.5] * 250_000, [2, -1] * 500_000):
        toxicity.maximal_segments(scores)
    assert time.process_time() - began < 20
