"""Exact quantiles of many columns at once in bounded memory (ML-01).

A double's bits, turned so that they sort like its value, are a number of 64 bits. Each pass counts values by the next bits of that number, within the intervals
in which the wanted ranks lie, for all columns and groups together; a partition sends counts of the intervals it met. Once few values are left
they are fetched with their counts. No buffer holds a column's distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a pass decides: first sign and exponent, then parts of the fraction.
STEPS = (12, 13, 13, 13, 13)
#: Values in undecided intervals that are fetched with their counts at most.
FETCHED = 200_000


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort like the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(k: int) -> float:
    bits = k & ~(1 << 63) if k >> 63 else ~k & (1 << 64) - 1
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def exact(rows: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.5,), groups: list[Column] | None = None) -> list[dict[str, list[float | None]]]:
    """For each group (a condition; all rows without any) and column the quantiles of the shares, between two values in proportion; nulls and NaN count for nothing.

    Columns without values have nulls. The passes are five at most, whatever the number of columns, groups and shares; ``rows`` is read by each, so pass a stored table.
    """
    marks = F.array(*[F.coalesce(g, F.lit(False)) for g in groups]) if groups else F.array(F.lit(True))
    table = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), marks.alias("m"))
    d, n_groups = len(columns), len(groups) if groups else 1
    key = [(g, c) for g in range(n_groups) for c in range(d)]

    def count(prefixes: dict[tuple[int, int], set[int]] | None, shift: int, width: int) -> dict[tuple[int, int], dict[int, int]]:
        """Counts by the next bits within the intervals (all values at first)."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                m = batch.column("m").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, n_groups)
                for g, c in key:
                    if prefixes is not None and not prefixes.get((g, c)):
                        continue
                    own = x[m[:, g], c]
                    bits = ordered_bits(own[~np.isnan(own)])
                    if prefixes is not None:
                        bits = bits[np.isin(bits >> np.uint64(shift + width), np.array(sorted(prefixes[g, c]), dtype=np.uint64))]
                    for b, n in zip(*np.unique(bits >> np.uint64(shift), return_counts=True), strict=True):
                        total[g, c, int(b)] = total.get((g, c, int(b)), 0) + int(n)
            if total:
                g, c, b = zip(*total, strict=True)
                signed = np.array(b, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(c, pa.int32()), pa.array(signed, pa.int64()), pa.array(list(total.values()), pa.int64())], names=["g", "c", "b", "n"])

        found = table.mapInArrow(part, "g int, c int, b long, n long").groupBy("g", "c", "b").agg(F.sum("n").alias("n")).toArrow()
        out: dict[tuple[int, int], dict[int, int]] = {}
        for g, c, b, n in zip(*(found.column(k).to_pylist() for k in ("g", "c", "b", "n")), strict=True):
            out.setdefault((g, c), {})[b & (1 << 64) - 1] = n
        return out

    shift = 64 - STEPS[0]
    counts = count(None, shift, STEPS[0])
    sizes = {k: sum(v.values()) for k, v in counts.items()}
    wanted = {k: sorted({r for s in shares for r in (int(np.floor(s * (n - 1))), int(np.ceil(s * (n - 1))))}) for k, n in sizes.items()}
    # rank -> (interval, rank within it)
    at = {k: {r: _locate(counts[k], r) for r in wanted[k]} for k in wanted}
    for step in STEPS[1:]:
        left = sum(counts[k][p] for k in at for p in {p for p, _ in at[k].values()})
        width = shift if left <= FETCHED else step  # few are left: all their bits at once
        shift -= width
        counts = count({k: {p for p, _ in v.values()} for k, v in at.items()}, shift, width)
        at = {k: {r: _locate({b: n for b, n in counts[k].items() if b >> width == p}, rest) for r, (p, rest) in v.items()} for k, v in at.items()}
        if not shift:
            break
    out: list[dict[str, list[float | None]]] = []
    for g in range(n_groups):
        out.append({})
        for c, name in enumerate(columns):
            found = at.get((g, c))
            values = []
            for s in shares if found else ():
                place = s * (sizes[g, c] - 1)
                low, high = int(np.floor(place)), int(np.ceil(place))
                a, b = from_bits(found[low][0]), from_bits(found[high][0])
                values.append(a if a == b else (high - place) * a + (place - low) * b)
            out[g][name] = values if found else [None] * len(shares)
    return out


def _locate(counts: dict[int, int], rank: int) -> tuple[int, int]:
    for b in sorted(counts):
        if rank < counts[b]:
            return b, rank
        rank -= counts[b]
    raise ValueError("the rows changed between two passes")
