import random
import re

import pytest

from contestkit.llm import decontaminate, queries

from .conftest import documents

VOCABULARY = [f"w{k}" for k in range(400)]


def text(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def bench(spark, items):
    return spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, H long")


def plain(docs, items):
    """All alignments compared, without seeds: (doc_id, item_id) pairs that must be found."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = set()
    for d, a in ((d, cut(t)) for d, t in docs):
        for i, b in ((i, cut(t)) for i, t in items):
            if not b:
                continue
            need = min(len(b), decontaminate.OVERLAP)
            for shift in range(-len(b), len(a)):
                same = [a[k + shift] == b[k] for k in range(max(0, -shift), min(len(b), len(a) - shift))]
                if any(sum(same[s : s + need]) >= decontaminate.least_agreeing(len(b)) for s in range(len(same) - need + 1)):
                    found.add((d, i))
    return found


@pytest.mark.parametrize("blocks", [400_000, 4_000])
def test_against_all_alignments(spark, monkeypatch, blocks):
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", blocks)
    rng = random.Random(2)
    items = [(k, " ".join(text(rng, [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 15, 40][k % 13]))) for k in range(26)]
    docs = []
    for k in range(104):
        words = text(rng, rng.choice([0, 3, 30, 200]))
        if k % 3 == 0:
            passage = items[k % 26][1].split()
            passage = [w if rng.random() > 0.07 else "other" for w in passage][: rng.choice([12, 99])]
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((k, rng.choice([" ", ", ", " - "]).join(words).title()))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(documents(spark, docs), bench(spark, items)).collect()}
    want = plain(docs, items)
    assert got == want and want


def test_evenly_substituted_passage(spark):
    rng = random.Random(4)
    item = text(rng, 40)
    changed = [w if k % 5 else "other" for k, w in enumerate(item)]
    rows = decontaminate.overlaps(documents(spark, [(1, " ".join(["x"] * 30 + changed)), (2, " ".join(text(rng, 99)))]), bench(spark, [(9, " ".join(item))])).collect()
    assert [(r["doc_id"], r["item_id"], r["doc_start"], r["aligned"], r["agreeing"]) for r in rows] == [(1, 9, 30, 40, 32)]


def test_odd_rows(spark, odd):
    items = bench(spark, [(1, None), (2, ""), (3, "One two, three FOUR five"), (4, "one two three four"), (5, "alpha beta " * 20), (5, "alpha beta " * 20), (None, "omega " * 30)])
    rows = decontaminate.overlaps(documents(spark, [(1, "one two three four five"), (1, "one two three four five"), (None, "one two three four five six"), (2, None), (3, "")]), items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in rows) == [(0, 3), (0, 4), (1, 3), (1, 4)]
    assert decontaminate.overlaps(odd, items).count() >= 0
    assert decontaminate.overlaps(odd.limit(0), items).collect() == []
    assert decontaminate.overlaps(odd, items.limit(0)).collect() == []
    kept = decontaminate.drop_contaminated(odd, bench(spark, [(1, "token = abcdef1234 one two"), (2, "token abcdef1234 x y z")]))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_rows_are_judged_by_their_own_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = documents(spark, [(None, f"so {item} then"), (None, "clean"), (4, item), (4, "another clean text"), (5, "x only four words here y"), (6, "only four, words"), (7, None)])
    kept = decontaminate.drop_contaminated(docs, bench(spark, [(1, item), (2, item.upper()), (3, "Only four words here")]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, "clean"), (4, "another clean text"), (6, "only four, words"), (7, None)], key=str)
    rows = decontaminate.overlaps(docs, bench(spark, [(1, item), (2, item.upper()), (None, item)])).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in rows) == [(0, 0), (0, 1), (0, 2), (4, 0), (4, 1), (4, 2)]


def test_query_against_whole_passages(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_benchmark_decontamination(spark, sf).collect()}
    norm = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], norm(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, b in items if b in t}
    assert whole and whole <= got


def test_main_path_is_native(spark, sf_dir):
    plan = queries.op9_benchmark_decontamination(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20])
def test_masks_lose_no_overlap(n):
    from itertools import combinations

    masks = decontaminate.masks_for([n] if n < 12 else [])
    window = min(n, decontaminate.OVERLAP)
    for gone in combinations(range(window), window - decontaminate.least_agreeing(n)):
        assert any(not {o + at for o in m.offsets} & set(gone) for m in masks if m.least <= n <= m.most for at in range(window - m.offsets[-1]))
