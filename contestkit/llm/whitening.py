"""Whitening of embeddings from an exact scatter matrix in residues.

Entries become integers x. A first pass gives the exact sums S of the n vectors. A second pass centres, y = n x - S, and multiplies the residues of y modulo
several primes below 2**20: a block of 8,192 rows of such residues has an exact double-precision product, so each partition runs plain matrix
products and sends one residue a prime and pair of dimensions. Spark adds the residues, the driver rebuilds each entry of sum(y y') from them by the Chinese
remainder theorem, as a whole number: the covariance V = sum(y y') / n**3 is rounded once. Its eigenvectors come from a double ``eigh``.
The number of primes follows from n and the range of x. What the driver holds grows with the square of the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.llm.common import pick

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: 2**13 products of numbers below 2**20 add up to at most 2**53, the last exact double.
BLOCK_ROWS = 1 << 13
PRIME_BITS = 20
#: Entries beyond it have no long x with room for the shift.
LARGEST = float(1 << 55)


@dataclass
class Model:
    """n fit vectors, sums S by dimension, eigenvalues falling, unit eigenvectors in columns, trace(V), whether a component has variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int = SCALE
    shift: int = SHIFT

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def sound(self, components: int) -> np.ndarray:
        """Which of the first components have a variance above the rounding of V."""
        e = self.values[:components]
        return e > len(self.values) * np.finfo(float).eps * max(float(self.values[0]), 0.0) if len(e) else e > 0

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """Rows of x, centred, projected and scaled; NaN for a component without variance."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        e = np.where(self.sound(components), self.values[:components], np.nan)
        return ((x - whole).astype(float) - rest) @ self.vectors[:, :components] / np.sqrt(e)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S)**2; None if one does not fit in a long."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = [s % self.n for s in self.sums]
        near = x - whole
        guess = (((near.astype(float) - np.array(rest) / self.n) * self.n) ** 2).sum(axis=1)
        out: list[int | None] = [None] * len(x)
        small = guess < 0.99 * 2.0**63  # then every y and every partial sum of squares is below 2**63
        if small.any():
            y = near[small] * np.int64(self.n) - np.array(rest, dtype=np.int64)
            for i, v in zip(np.flatnonzero(small).tolist(), (y * y).sum(axis=1).tolist(), strict=True):
                out[i] = v
        for i in np.flatnonzero(~small & (guess < 1.01 * 2.0**63)).tolist():
            v = sum((v * self.n - r) ** 2 for v, r in zip(near[i].tolist(), rest, strict=True))
            out[i] = v if v < 1 << 63 else None
        return out


def primes(bound: int) -> list[int]:
    """The largest primes below 2**20 whose product exceeds ``bound``."""
    out: list[int] = []
    at = (1 << PRIME_BITS) - 1
    while prod(out) <= bound:
        if all(at % k for k in range(3, 1 << (PRIME_BITS // 2), 2)):
            out.append(at)
        at -= 2
    return out


def remainders(residues: list[int], moduli: list[int]) -> int:
    """The number between -M/2 and M/2, M the product of the moduli, that leaves these residues."""
    whole = prod(moduli)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % whole
    return x - whole if 2 * x > whole else x


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows whose vector is neither null nor empty, and all whose entries are numbers within range.

    Vectors of another length than most have (the longer, if equally many) are left out as well: they have no place in the space.
    """
    rows = pick(df, id_col, vec_col).toDF("id", "vec")
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    rows = rows.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad)
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vec") == (lengths["d"] if lengths else -1))


def _integers(vec: pa.Array, scale: int, shift: int) -> np.ndarray:
    """Rows of floor(scale c) + shift."""
    flat = vec.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).astype(np.int64).reshape(len(vec), -1) + shift


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, _integers(part.column("vec"), scale, shift)


def _sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int], int]:
    """n, S by dimension, and the widest range of x in a dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, least, most = 0, None, None, None, None
        for _, x in _blocks(batches, scale, shift):
            # sums of the upper and lower 32 bits cannot overflow
            parts = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)
            if n:
                parts = high + parts[0], low + parts[1], np.minimum(least, parts[2]), np.maximum(most, parts[3])
            high, low, least, most = parts
            n += len(x)
        if n:
            columns = [np.arange(len(high)), np.full(len(high), n), high, low, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["dim", "n", "high", "low", "least", "most"])

    parts = rows.select("vec").mapInArrow(add, "dim long, n long, high long, low long, least long, most long")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    dims = parts.groupBy("dim").agg(F.sum("n").alias("n"), *exact, F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()  # one row a dimension
    if not dims:
        return 0, [], 0
    return dims[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in dims], max(r["most"] - r["least"] for r in dims)


def scatter(rows: DataFrame, n: int, sums: list[int], width: int, scale: int = SCALE, shift: int = SHIFT) -> list[list[int]]:
    """The exact matrix sum(y y'), y = n x - S, over ``rows`` (vec); ``width`` is the widest range of x in a dimension."""
    d = len(sums)
    moduli = primes(2 * n * (n * width) ** 2 + 1)  # |y| <= n * width
    upper = np.triu_indices(d)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((d, d), dtype=np.int64) for _ in moduli]
        seen = False
        for _, x in _blocks(batches, scale, shift):
            seen = True
            for total, p in zip(totals, moduli, strict=True):
                y = ((x % p) * (n % p) - np.array([s % p for s in sums], dtype=np.int64)) % p
                y = y.astype(float)
                total += (y.T @ y).astype(np.int64) % p
                total %= p
        if seen:
            for total, p in zip(totals, moduli, strict=True):
                columns = [np.full(len(upper[0]), p), upper[0] * d + upper[1], total[upper]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["prime", "cell", "residue"])

    parts = rows.select("vec").mapInArrow(multiply, "prime long, cell long, residue long")
    cells = parts.groupBy("prime", "cell").agg(F.sum("residue").alias("residue")).collect()  # one row a prime and cell of the matrix
    by_cell: dict[int, dict[int, int]] = {}
    for r in cells:
        by_cell.setdefault(r["cell"], {})[r["prime"]] = r["residue"] % r["prime"]
    out = [[0] * d for _ in range(d)]
    for cell, found in by_cell.items():
        i, j = divmod(cell, d)
        out[i][j] = out[j][i] = remainders([found[p] for p in moduli], moduli)
    return out


def fit(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> Model | None:
    """The model of ``rows`` (vec), all of one length; None if there is none."""
    n, sums, width = _sums(rows, scale, shift)
    if not n:
        return None
    exact = scatter(rows, n, sums, width, scale, shift)
    cube = n**3
    values, vectors = np.linalg.eigh(np.array([[v / cube for v in row] for row in exact]))  # whole numbers divide with one rounding
    return Model(n, sums, values[::-1].copy(), vectors[:, ::-1].copy(), sum(exact[i][i] for i in range(len(sums))) / cube, scale, shift)


def identity_error(rows: DataFrame, model: Model, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n) minus the identity, measured on the rows.

    The whitened values are centred already, so their products and their means are added up as they are; Spark adds the partitions' parts. Components
    without variance take no part.
    """
    keep = np.flatnonzero(model.sound(components))
    k = len(keep)
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, model.scale, model.shift):
            z = model.whitened(x, components)[:, keep]
            total += np.vstack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel(), pa.float64())], names=["cell", "part"])

    cells = rows.select("vec").mapInArrow(moments, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("total")).collect()  # k (k + 1) rows
    total = np.zeros((k + 1) * k)
    for r in cells:
        total[r["cell"]] = r["total"] / model.n
    products, mean = total[: k * k].reshape(k, k), total[k * k :]
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


OUTPUT = "vec_id {id}, n long, deviation long, whitened array<double>"


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Model | None, float]:
    """(vec_id, n, deviation, whitened array) of each usable row, the model, and the identity error.

    Rows with a null or empty vector, or with null, non-finite or over-large (beyond 2**55) entries, or of another length than most, are dropped from
    both the fit and the result. All other rows count once each: repeated rows and ids repeat, a null id stays null, zero vectors are vectors. A component without
    variance (one row, constant dimensions, more components than independent rows) is null; ``deviation`` is null where it does not fit in a long. A table
    without usable rows gives no rows and no model. Extra columns are ignored.
    """
    rows = usable(df, id_col, vec_col)
    model = fit(rows, scale, shift)
    kind = rows.schema["id"].dataType.simpleString()
    if model is None:
        return df.sparkSession.createDataFrame([], OUTPUT.format(id=kind)), None, 0.0
    error = identity_error(rows, model, components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, scale, shift):
            z = model.whitened(x, components)
            flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)  # NaN: null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([model.n] * len(z), pa.int64()), pa.array(model.deviations(x), pa.int64()), lists], names=["vec_id", "n", "deviation", "whitened"])

    return rows.mapInArrow(apply, OUTPUT.format(id=kind)), model, error


def by_component(found: DataFrame, model: Model | None, error: float) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    shares = [] if model is None or model.trace <= 0 else [float(v) / model.trace for v in model.values]
    explained: Column = F.get(F.array(*map(F.lit, shares)), F.col("k")) if shares else F.lit(None).cast("double")
    rows = found.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
