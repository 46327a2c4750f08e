"""Language identification as a mixture of languages.

Each language is a distribution over hashed letter trigrams, learned from labelled texts. A document is a
mixture: expectation-maximisation finds the language proportions that make its trigrams likeliest. Starting
from all languages, the one with the least share is taken out as long as the penalised likelihood (BIC)
does not fall; what remains is the document's language set.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.llm.common import chunks, pick

#: At most about this many labelled rows, taken by a hash of doc_id, fit the model.
FIT_ROWS = 20_000
BINS = 1 << 15
SMOOTHING = 0.3
ROUNDS, TOLERANCE = 40, 1e-4
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """Bins of the letter trigrams of the whole text; runs of anything else count as one space."""
    if not text:
        return np.zeros(0, np.int64)
    kept = _OTHER.sub(" ", text.lower()).strip()
    if not any(c.isalpha() for c in kept):
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {kept} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)) ^ (codes[1:-1] << np.uint64(17))
    return ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - 15)).astype(np.int64)


class Model:
    """Languages in order and their trigram probabilities, one row each."""

    def __init__(self, languages: list[str], probabilities: np.ndarray) -> None:
        self.languages, self.probabilities = languages, probabilities

    def mixture(self, bins: np.ndarray) -> dict[str, float]:
        """Proportions of the selected languages."""
        counts = np.bincount(bins, minlength=BINS)
        used = np.flatnonzero(counts)
        c = counts[used].astype(float)
        p, chosen = self.probabilities[:, used], np.arange(len(self.languages))
        share, fit = _expectation_maximisation(p, c)
        price = 0.5 * np.log(max(2.0, c.sum()))
        while len(chosen) > 1:
            stay = np.delete(np.arange(len(chosen)), int(np.argmin(share)))
            less, worse = _expectation_maximisation(p[stay], c)
            if worse + price < fit:
                break
            p, chosen, share, fit = p[stay], chosen[stay], less, worse
        return {self.languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def _expectation_maximisation(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood for counts c of grams with probabilities p (languages x grams)."""
    share = np.full(len(p), 1 / len(p))
    n = c.sum()
    for _ in range(ROUNDS if len(p) > 1 else 0):
        new = share * (p @ (c / (share @ p))) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, float(c @ np.log(share @ p))


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from ``labelled`` (doc_id, text, lang); rows with a null text or lang are left out, repeated rows count as often as they occur.

    The texts are read once, for at most about ``fit_rows`` of them. The driver gets the model's own size: at most ``BINS`` counts a
    language. An empty table gives a model without languages.
    """
    rows = pick(labelled, "doc_id", "text", "lang").filter("lang is not null")
    n = rows.count()  # reads no text
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 20))  # the text too: rows may share a doc_id
    rows = rows.filter("text is not null").filter(part < int(min(1.0, fit_rows / max(1, n)) * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, np.zeros(BINS, np.int64))
                seen[lang] += np.bincount(grams(text), minlength=BINS)
        for lang, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(counts[used])], names=["lang", "bin", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # BINS rows a language at most
    languages = sorted({r["lang"] for r in counted})
    table = np.full((len(languages), BINS), SMOOTHING)
    at = {lang: k for k, lang in enumerate(languages)}
    for r in counted:
        table[at[r["lang"]], r["bin"]] += r["n"]
    return Model(languages, table / table.sum(axis=1, keepdims=True) if languages else table)


def language(model: Model) -> Callable[[Column], Column]:
    """Column function: text to struct (lang, score, mixture).

    lang is the language with the largest share, the first by name of equals; score its share. Texts that are null
    or without letters, and all texts if nothing was learned, are ``und`` with score 0.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            bins = grams(x.as_py())
            if not len(bins) or not model.languages:
                out.append((UNDETERMINED, 0.0, []))
                continue
            shares = model.mixture(bins)
            best = min(shares, key=lambda lang: (-shares[lang], lang))
            out.append((best, min(1.0, shares[best]), list(shares.items())))
        return pa.array([dict(zip(("lang", "score", "mixture"), r, strict=True)) for r in out], type=kind)

    return F.arrow_udf(of, "struct<lang:string,score:double,mixture:map<string,double>>")
