import re

import numpy as np

import corpus_pipeline as pipeline
from contestkit.llm import secrets, toxicity

from .test_packing import check
from .test_secrets import plain
from .test_simhash import plain_components, plain_print


def test_stages_against_brute_force(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = now = read("documents")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, read("labels"))
    clean = {d for d, t in texts.items() if model.score(model.evidence([s for s, _, _ in model.passages(toxicity.tokens(t), {})], len(toxicity.tokens(t)))) < toxicity.THRESHOLD}
    assert kept["toxicity"] == {d: texts[d] for d in clean}
    classes = plain_components([(d, plain_print(texts[d])) for d in clean])
    assert set(kept["near_dedup"]) == set(classes.values())
    norm = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    items = [norm(r["text"]) for r in read("benchmark").collect()]
    assert set(kept["decontamination"]) == {d for d, t in kept["near_dedup"].items() if not any(b in norm(t) for b in items)}
    assert set(kept["secrets"]) == set(kept["decontamination"])
    for d, t in kept["secrets"].items():
        assert not plain(t) or secrets.RULES
        assert (t == texts[d]) == (not plain(texts[d]))
    rows = pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(kept["secrets"])
    n = check(rows, 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert least <= n <= least * 1.01 + 1
    assert np.all(np.array([r["length"] for r in rows]) > 0)


def test_null_and_repeated_ids_of_differing_texts(spark, sf_dir):
    from pyspark.sql import functions as F

    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = read("documents").limit(60)
    item = read("benchmark").first()["text"]
    copies = plain.withColumn("doc_id", F.lit(None).cast("long")).unionByName(plain.withColumn("doc_id", F.lit(1).cast("long")))
    marked = plain.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(f"so then {item} it goes"))
    now = plain.unionByName(copies).unionByName(marked).unionByName(plain.limit(0))
    stages = dict(pipeline.STAGES)
    texts = lambda df: sorted(r["text"] or "" for r in df.collect())
    once = stages["near_dedup"](spark, now, sf_dir)
    alone = stages["near_dedup"](spark, plain.unionByName(marked), sf_dir)
    assert texts(once) == texts(alone)
    clean = stages["decontamination"](spark, once, sf_dir)
    assert all(item not in t for t in texts(clean)) and clean.count() < once.count()
    assert texts(stages["secrets"](spark, clean, sf_dir)) and stages["secrets"](spark, clean, sf_dir).count() == clean.count()
    for name, stage in pipeline.STAGES:
        assert stage(spark, now.limit(0), sf_dir).collect() == [], name
