"""Toxic passages as maximum-scoring segments.

Words get log-odds of toxic against clean use. Their priors are Dirichlet priors in a chain: a word's prior
is its six-letter prefix, whose prior is the five-letter prefix, and so on, so that an unseen form of a known stem
has a score. The odds count texts, not uses, so one text that repeats a word teaches no more than any other.
A linear-time scan (all maximal segments) over every use of every word finds every passage whose summed log-odds stand
out. Extreme-value theory calibrates them: lambda and K are fitted on clean texts, segment scores become
normalised for the text's length, and the sum statistic of the best r segments is the text's evidence. A logistic
curve fitted on labelled rows that the word counts did not see makes it a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.llm.common import chunks, pick, stash

#: At most about this many labelled rows fit the model: rows are taken by a hash of doc_id.
FIT_ROWS = 24_000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6)
#: Pseudo-counts of each prior in the chain.
PRIOR = 4.0
#: Least uses of a word or prefix in the model, and least standard score of toxic ones.
LEAST_USES, LEAST_Z = 3, 3.0
#: Words whose scores a worker keeps at hand.
CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The chain of priors from short to long; the word itself ends with a mark."""
    return [*(word[:n] for n in PREFIXES if n < len(word)), word + "$"]


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last + 1), in linear time.

    Every candidate remembers the nearest one before it whose sum begins lower, so that no search passes a candidate twice.
    """
    stack: list[list] = []  # first, last + 1, total before, total after, nearest candidate that begins lower
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low, k = i, before, len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                stack.append([first, i + 1, low, total, k])
                break
            first, _, low, _, nearest = stack[k]
            del stack[k:]
            k = nearest
    return [(right - left, a, b) for a, b, left, right, _ in stack]


@dataclass(frozen=True)
class Model:
    """Scores of toxic features, the score of all other words, and the calibration."""

    known: dict[str, float]
    other: float
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def word(self, word: str) -> float:
        score = self.other
        for f in features(word):
            score = self.known.get(f, score)
        return score

    def passages(self, words: list[str], cache: dict[str, float]) -> list[tuple[float, int, int]]:
        """Maximal segments of the words, best first. Every use of a word scores; runs of other words count as one step."""
        scores, places = [], []
        last = -1
        for i, w in enumerate(words):
            s = cache.get(w)
            if s is None:
                s = self.word(w)
                if len(cache) < CACHE:
                    cache[w] = s
            if s > 0:
                if i - last > 1:
                    scores.append(self.other * (i - last - 1))
                    places.append(last + 1)
                scores.append(s)
                places.append(i)
                last = i
        return sorted(((s, places[a], places[b - 1] + 1) for s, a, b in maximal_segments(scores)), reverse=True)

    def evidence(self, scores: list[float], n: int) -> float:
        """-ln of the chance that a clean text of n words has segments like the best r, for the best r; scores are sorted, best first.

        A segment that a clean text of that length is likely to have, and any after it, adds nothing to the sum.
        """
        if not scores or not n:
            return 0.0
        best, t = 0.0, 0.0
        base = math.log(self.k * n)
        for r, s in enumerate(scores, 1):
            if self.lam * s <= base:
                break
            t += self.lam * s - base
            if t > r:
                best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.shift))))


def _count(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): number of texts with the word, summed over words for prefixes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(sides[0].keys() | sides[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([side[f] for f in names], pa.int64()) for side in sides[::-1])]
            for side in sides:
                side.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "clean"])

        for batch in chunks(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                sides[toxic].update(f for w in set(tokens(text)) for f in features(w))
            if sum(map(len, sides)) > 400_000:
                yield out()
        yield out()

    return labelled.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _word_model(rows: list[tuple[str, int, int]], toxic_all: int, clean_all: int) -> Model:
    share = (toxic_all + 0.5) / (toxic_all + clean_all + 1)
    counts = {f: (t, c) for f, t, c in rows}
    belief: dict[str, float] = {}

    def of(f: str) -> float:
        """Share of toxic uses, with the next shorter prefix as its prior."""
        if f not in belief:
            stem = f[:-1] if f.endswith("$") else f
            shorter = next((stem[:n] for n in reversed(PREFIXES) if n < len(stem) and stem[:n] in counts), None)
            prior = share if shorter is None else of(shorter)
            t, c = counts[f]
            belief[f] = (t + PRIOR * prior) / (t + c + PRIOR)
        return belief[f]

    known: dict[str, float] = {}
    for f, (t, c) in counts.items():
        p = of(f)
        odds = math.log(p / (1 - p)) - math.log(share / (1 - share))
        z = odds / math.sqrt(1 / (t + PRIOR * share) + 1 / (c + PRIOR * (1 - share)))
        known[f] = odds if odds > 0 and z >= LEAST_Z else 0.0
    in_toxic = in_clean = 0
    for f, (t, c) in counts.items():
        if f.endswith("$") and known[f] > 0:
            in_toxic, in_clean = in_toxic + t, in_clean + c
    other = math.log(max(1e-9, 1 - in_toxic / max(1, toxic_all))) - math.log(max(1e-9, 1 - in_clean / max(1, clean_all)))
    other = min(other, -1e-3)
    return Model(_told_apart({f: s if s > 0 else other for f, s in known.items()}, other), other)


def _told_apart(known: dict[str, float], other: float) -> dict[str, float]:
    """Only the features whose score differs from that of the next shorter prefix; words score the same without the rest."""
    out = {}
    for f, s in known.items():
        stem = f[:-1] if f.endswith("$") else f
        shorter = next((known[stem[:n]] for n in reversed(PREFIXES) if n < len(stem) and stem[:n] in known), other)
        if s != shorter:
            out[f] = s
    return out


def _lambda(scores: np.ndarray) -> float:
    """The positive root of mean(exp(lambda s)) = 1."""
    if not len(scores) or scores.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while np.mean(np.exp(high * scores)) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.mean(np.exp(mid * scores)) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, the labels smoothed a little; the slope is positive."""
    positive, negative = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    w = np.array([0.1, -1.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (p - target))
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The evidence with the best F1, midway between two values."""
    order = np.argsort(-x, kind="stable")
    xs, hit = x[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(x) + 1) + y.sum())
    ends = np.append(xs[1:] < xs[:-1], True)
    at = int(np.argmax(np.where(ends, f1, -1)))
    return float((xs[at] + (xs[at + 1] if at + 1 < len(x) else 0.0)) / 2)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on ``labelled`` (doc_id, text, toxic 0/1), at most about ``fit_rows`` rows; reads it more than once: pass a stored table.

    A quarter of the rows is kept from the word counts, for the calibration. Rows with a null label or
    text are left out; without any toxic or clean row the model scores every text alike.
    """
    rows = pick(labelled, "doc_id", "text", "toxic").dropna(subset=["text", "toxic"])
    n = rows.count()
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 20))  # the text too: rows may share a doc_id
    rows = rows.filter(part < int(min(1.0, fit_rows / max(1, n)) * (1 << 20)))
    held = F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(4)) == 0
    counts = _count(rows.filter(~held).select("text", "toxic"))
    kept = [tuple(r) for r in counts.filter(F.col("toxic") + F.col("clean") >= LEAST_USES).select("feature", "toxic", "clean").toLocalIterator()]  # bounded by fit_rows
    toxic_all, clean_all = (sum(r[k] for r in kept if r[0].endswith("$")) for k in (1, 2))
    words = _word_model(kept, toxic_all, clean_all)
    return _calibrated(words, rows.filter(held).select("text", "toxic"))


def _calibrated(words: Model, rows: DataFrame) -> Model:
    """Lambda and K from the clean ones of ``rows`` (text, toxic), a stored table's; then the logistic curve from the evidence of all."""
    first = "toxic int, n int, best double, sums array<double>, used array<long>"
    second = "toxic int, evidence double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in chunks(batches, "text"):
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = tokens(text)
                uses: Counter = Counter()
                for w, n in Counter(own).items():
                    if (s := words.word(w)) > 0:
                        uses[s] += n
                best = words.passages(own, cache)[:1]
                out.append((toxic, len(own), best[0][0] if best else 0.0, list(uses.keys()), list(uses.values())))
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["toxic", "n", "best", "sums", "used"])

    seen = rows.mapInArrow(scan, first).collect()  # a quarter of fit_rows rows of a few numbers
    clean = [r for r in seen if not r["toxic"] and r["n"]]
    total = sum(r["n"] for r in clean)
    if not clean or len(clean) == len(seen):
        return Model(words.known, words.other, shift=-5.0)
    uses: Counter = Counter()
    for r in clean:
        uses.update(dict(zip(r["sums"], r["used"], strict=True)))
    lam = 1.0
    if uses:
        values, weights = np.array([*uses.keys(), words.other]), np.array([*uses.values(), total - sum(uses.values())])
        lam = _lambda(np.repeat(values, np.ceil(weights / max(1, weights.max() // 100_000)).astype(int)))
    extreme = sum(r["n"] * math.exp(-lam * r["best"]) for r in clean)
    model = Model(words.known, words.other, lam, len(clean) / max(extreme, 1e-9))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in chunks(batches, "text"):
            own = [tokens(text) for text in batch.column("text").to_pylist()]
            found = [model.evidence([s for s, _, _ in model.passages(w, cache)], len(w)) for w in own]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(found, pa.float64())], names=["toxic", "evidence"])

    weighed = rows.mapInArrow(weigh, second).collect()  # as many rows, of two numbers
    x, y = (np.array([float(r[k]) for r in weighed]) for k in ("evidence", "toxic"))
    slope, shift = _logistic(x, y)
    # the stated threshold falls on the cut with the best F1
    return Model(model.known, model.other, lam, model.k, slope, math.log(THRESHOLD / (1 - THRESHOLD)) - slope * _best_cut(x, y))


def toxicity(model: Model) -> Callable[[Column], Column]:
    """Column function: text to struct (score double, passages array of (start word, end word, score)).

    Null, empty and wordless texts have no passage and the score of no evidence. Passages are the
    maximal segments whose own normalised score is positive.
    """
    shared: dict[str, dict[str, float]] = {"cache": {}}
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    whole = pa.struct([("score", pa.float64()), ("passages", pa.list_(passage))])

    def of(texts: pa.Array) -> pa.Array:
        cache, out = shared["cache"], []
        for x in texts:
            words = tokens(x.as_py())
            found = model.passages(words, cache)
            base = math.log(model.k * len(words)) if words else 0.0
            evidence = model.evidence([s for s, _, _ in found], len(words))
            out.append({"score": model.score(evidence), "passages": [{"start": a, "end": b, "score": s} for s, a, b in found if model.lam * s > base]})
        return pa.array(out, type=whole)

    return F.arrow_udf(of, "struct<score:double,passages:array<struct<start:int,end:int,score:double>>>")


def labelled_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``fit_rows`` labelled rows; only these labels are broadcast, no text is shuffled.

    Of repeated labels of a doc_id the largest counts.
    """
    marks = pick(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20))
    sample = marks.filter(part < int(min(1.0, fit_rows / max(1, n)) * (1 << 20)))
    return pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on the labelled rows of ``docs`` for which ``held_out`` (over doc_id) does not hold; they are stored, so ``docs`` is read once.

    Null texts, labels and doc_ids teach nothing. Empty tables give the model that scores every text alike.
    """
    if held_out is not None:
        labels = pick(labels, "doc_id", "toxic").filter(~held_out)
    return fit(stash(labelled_documents(docs, labels, fit_rows), "labelled"), fit_rows)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay.

    Each row is judged by its text alone: repeated rows stay or go together, null and empty texts have the score of no
    evidence and stay. An empty table gives no rows.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    score = toxicity(model)(F.col(f"c{columns.index('text')}"))["score"]
    kept = plain.withColumn("score", score).filter(F.col("score") < threshold).drop("score")
    return kept.toDF(*columns)
