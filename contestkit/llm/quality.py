"""Quality by importance resampling.

Texts are bags of hashed word unigrams and bigrams. Two generative models, one of target texts (labelled good)
and one of all raw texts, give each text its log importance weight; adding Gumbel noise and
taking the largest keys samples without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.llm.common import chunks, pick, stash

BINS = 1 << 16
SMOOTHING = 1.0
#: At most about this many labelled rows make the target model; the raw model counts every document.
TARGET_ROWS = 40_000
#: Share of the documents that is sampled.
FRACTION = 0.5
SPLITS = 4096

_STEP = 0x100000001B3
_BACK = pow(_STEP, -1, 1 << 64)
#: Bytes that belong to words: letters, digits and all of other scripts; A-Z are lowered.
_WORDY = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)


class Hasher:
    """Bins of a text's word unigrams and bigrams, by polynomial prefix sums over its bytes."""

    def __init__(self) -> None:
        self.forth = self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.forth) <= n:
            size = max(n + 1, 1 << 16)

            def power(step: int) -> np.ndarray:
                steps = np.full(size + 1, step, dtype=np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            self.forth, self.back = power(_STEP), power(_BACK)

    def bins(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, np.uint8)
        inside = _WORDY[raw]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(begin):
            return np.zeros(0, np.int64)
        self._grow(len(raw))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[raw] + np.uint64(1)) * self.forth[: len(raw)], dtype=np.uint64)])
        one = (sums[end] - sums[begin]) * self.back[begin]
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + (one[1:] ^ np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = np.concatenate([one, two])
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)).astype(np.int64)


def _raw_bytes(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in column.cast(pa.binary()))


def log_ratios(docs: DataFrame, targets: DataFrame) -> np.ndarray:
    """ln p_target - ln p_raw of each bin. docs: (doc_id, text), all counted; targets: (doc_id), a bounded table."""
    marked = pick(docs, "doc_id", "text").join(F.broadcast(targets.select(F.col("doc_id").alias("of")).distinct()), F.col("doc_id") == F.col("of"), "left").select("text", F.col("of").isNotNull().alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, hasher = np.zeros((2, BINS), np.int64), Hasher()
        for batch in chunks(batches, "text"):
            for text, target in zip(_raw_bytes(batch.column("text")), batch.column("target").to_pylist(), strict=True):
                own = np.bincount(hasher.bins(text), minlength=BINS)
                sums[0] += own
                if target:
                    sums[1] += own
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], names=["bin", "raw", "target"])

    counts = np.zeros((2, BINS))
    for r in marked.mapInArrow(count, "bin long, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BINS rows at most
        counts[:, r["bin"]] = r["raw"], r["target"]
    counts += SMOOTHING
    raw, target = np.log(counts / counts.sum(axis=1, keepdims=True))
    return target - raw


def log_weight(ratios: np.ndarray) -> Callable[[Column], Column]:
    """Column function: text to its log importance weight; 0 without words."""

    def of(texts: pa.Array) -> pa.Array:
        hasher = Hasher()
        return pa.array([float(ratios[hasher.bins(x)].sum()) for x in _raw_bytes(texts)], type=pa.float64())

    return F.arrow_udf(of, "double")


def gumbel(doc_id: Column) -> Column:
    """Standard Gumbel noise that is a function of the id, in DataFrame functions."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(11)), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def largest(keyed: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a stored table's column, exactly: the interval that holds it is split until few are left."""
    rows = keyed.filter(F.col(column).isNotNull())
    low, high, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    within = F.col(column).between(low, high)
    while low < high:
        width = (high - low) / SPLITS
        nth = F.least(F.floor((F.col(column) - low) / width).cast("int"), F.lit(SPLITS - 1)) if width > 0 else F.lit(0)
        parts = rows.filter(within).groupBy(nth.alias("nth")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # SPLITS rows at most
        for part in sorted(parts, key=lambda r: -r["nth"]):
            if part["n"] >= k:
                break
            k -= part["n"]
        if (part["low"], part["high"]) == (low, high):
            break
        low, high = part["low"], part["high"]
        if part["n"] == k:
            return low
        within = F.col(column).between(low, high)
    return low


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, log_weight, sample_key, sampled of every row of ``docs`` (doc_id, text).

    labels: (doc_id, quality); quality 1 marks target texts. sampled holds for the share ``fraction`` of the rows
    with the largest keys; rows that tie with the last of them are sampled too. Null and empty texts weigh 1
    (log 0); without any target every text weighs about the same. Repeated rows repeat with equal keys; a null doc_id stays
    null. Empty tables give no rows. Extra columns are ignored.
    """
    good = pick(labels, "doc_id", "quality").filter("quality = 1").select("doc_id").dropna().distinct()
    share = min(1.0, target_rows / max(1, good.count()))
    sample = good.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < int(share * (1 << 20)))
    ratios = log_ratios(docs, sample) if sample.take(1) else np.zeros(BINS)
    weighed = pick(docs, "doc_id", "text").select("doc_id", log_weight(ratios)(F.col("text")).alias("log_weight"))
    keyed = stash(weighed.withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id"))), "weights")
    cut = largest(keyed, "sample_key", round(fraction * keyed.count()))
    return keyed.withColumn("sampled", F.col("sample_key") >= F.lit(cut) if cut is not None else F.lit(False))
