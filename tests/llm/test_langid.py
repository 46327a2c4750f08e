import math
import random
import zlib
from collections import Counter

from contestkit.llm import langid, queries


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op6_language_mixture(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixture_and_odd_rows(spark, odd):
    rng = random.Random(1)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    data = [(k, say("abcd" if k % 2 else "wxyz", 60), "one" if k % 2 else "two") for k in range(60)] + [(99, None, "one"), (98, "abcd", None)]
    model = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.languages == ["one", "two"]
    shares = model.mixture(langid.grams(say("abcd", 30) + " " + say("wxyz", 90)))
    assert abs(shares["two"] - 0.75) < 0.05
    assert set(model.mixture(langid.grams(say("abcd", 200)))) == {"one"}
    got = {r["doc_id"]: r["t"] for r in odd.select("doc_id", langid.language(model)(odd["text"]).alias("t")).collect()}
    assert {d for d, t in got.items() if t["lang"] == "und"} == {1, 2, 3} and got[1]["score"] == 0
    empty = langid.train(odd.limit(0))
    assert {r["t"]["lang"] for r in odd.select(langid.language(empty)(odd["text"]).alias("t")).collect()} == {"und"}


def plain_grams(text):
    """Trigrams by character, one at a time, and the same bins by Python integers."""
    if not text or not any(c.isalpha() for c in text):
        return []
    runs, now = [], ""
    for c in text.lower():
        if c.isalpha():
            now += c
        elif now:
            runs.append(now)
            now = ""
    kept = " " + " ".join([*runs, now] if now else runs) + " "
    bins, m = [], 2**64 - 1
    for a, b, c in zip(*[map(ord, kept[k:]) for k in range(3)], strict=False):
        x = ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & m) ^ (b << 17)
        bins.append((x * 0xFF51AFD7ED558CCD & m) >> 49)
    return bins


def plain_mixture(counts, table):
    """Proportions by expectation-maximisation, one language less as long as the penalised likelihood does not fall."""
    n = sum(counts.values())

    def fitted(langs):
        share = {x: 1 / len(langs) for x in langs}
        for _ in range(langid.ROUNDS if len(langs) > 1 else 0):
            new = dict.fromkeys(langs, 0.0)
            for b, c in counts.items():
                whole = sum(share[x] * table[x][b] for x in langs)
                for x in langs:
                    new[x] += c * share[x] * table[x][b] / whole / n
            moved = max(abs(new[x] - share[x]) for x in langs)
            share = new
            if moved < langid.TOLERANCE:
                break
        return share, sum(c * math.log(sum(share[x] * table[x][b] for x in langs)) for b, c in counts.items())

    langs = sorted(table)
    share, fit = fitted(langs)
    while len(langs) > 1:
        fewer = [x for x in langs if x != min(langs, key=lambda x: share[x])]
        other, worse = fitted(fewer)
        if worse + 0.5 * math.log(max(2.0, n)) < fit:
            break
        langs, share, fit = fewer, other, worse
    return share


def test_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = {}
    for d, r in docs.items():
        if zlib.crc32(str(d).encode()) % 5 and r["lang"] is not None and r["text"] is not None:
            seen.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    table = {}
    for x, counts in seen.items():
        whole = sum(counts.values()) + langid.SMOOTHING * langid.BINS
        table[x] = [(counts[b] + langid.SMOOTHING) / whole for b in range(langid.BINS)]
    rows = queries.op6_language_mixture(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts = Counter(plain_grams(docs[r["doc_id"]]["text"]))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not counts:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        want = plain_mixture(counts, table)
        got = {m["key"]: m["value"] for m in r["mixture"]}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
        assert r["lang_pred"] == max(want, key=lambda x: (want[x], x)) and abs(r["score"] - max(want.values())) < 1e-6


def test_query_with_odd_rows(spark, odd, tmp_path):
    odd.withColumn("held_out", odd["TEXT_"]).write.parquet(f"{tmp_path}/one/documents.parquet")
    rows = queries.op6_language_mixture(spark, f"{tmp_path}/one").collect()
    assert len(rows) == odd.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 5} == {("en", 1.0)}
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op6_language_mixture(spark, f"{tmp_path}/none").collect() == []
