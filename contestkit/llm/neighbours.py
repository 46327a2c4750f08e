"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits its points at the median of their projections on a random
direction, down to leaves of a fixed number of rows, so that leaves grow in number with the data until the sample is too
thin. Every row is routed to one leaf of each tree. A query searches all trees through one priority queue, ordered by
the largest distance to a hyperplane that a branch lies beyond, until the leaves taken hold enough points. How many are
enough, and how many trees serve with the least comparisons, is measured: on the sample if it is the whole table, else on
the whole table, whose rows are all compared with TRIALS points of the sample in one pass. Where the sample is too thin for
leaves of LEAF_ROWS rows, the task that holds a leaf splits its rows further with a tree of their own, and a query is led
to WIDEN times the rows that it needs and looks at the nearest part of them. Queries and rows that meet are compared exactly.

Neighbouring leaves lie in one bundle of a bounded number of rows, which one task holds while the queries stream by,
so neither many rows nor many queries fill a task. Equal vectors are one entry of the index with its
smallest ids, as many as any query can need.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestkit.llm.common import pick, stash

#: Numbers of trees to choose from.
TREES = (2, 4, 8)
#: Rows in a leaf, about, and the least points of the sample in one.
LEAF_ROWS, LEAF = 128, 8
#: The sample: at most about so many rows and so many numbers.
SAMPLE_ROWS, SAMPLE_NUMBERS = 60_000, 4_000_000
#: Recall to reach on the sample, and queries of the sample that measure it.
TARGET_RECALL, TRIALS = 0.97, 150
#: Points that a query is compared with, as shares of all, that are tried.
SHARES = (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)
#: Where leaves are split further, a query is led to so many times the rows that it is compared with.
WIDEN = 4
#: Rows of a bundle that a task holds, about.
PART_ROWS = 20_000
SEED = 17
#: Rows and queries compared at once.
BLOCK = 512


@dataclass(frozen=True)
class Tree:
    """Nodes by number; children below zero are leaves (leaf k is -1 - k)."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    sizes: np.ndarray
    root: int

    @classmethod
    def fit(cls, points: np.ndarray, rng: np.random.Generator, leaf: int) -> Tree:
        directions, cuts, children, sizes = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        root = 0
        while todo:
            own, parent, side = todo.pop()
            at = None
            if len(own) > leaf:
                direction = rng.standard_normal(points.shape[1])
                direction /= np.linalg.norm(direction)
                along = points[own] @ direction
                cut = float(np.median(along))
                left = along < cut
                if 0 < left.sum() < len(own):
                    at = len(cuts)
                    directions.append(direction)
                    cuts.append(cut)
                    children.append([0, 0])
                    todo += [(own[left], at, 0), (own[~left], at, 1)]
            if at is None:
                at = -1 - len(sizes)
                sizes.append(len(own))
            if parent < 0:
                root = at
            else:
                children[parent][side] = at
        width = points.shape[1]
        return cls(np.array(directions).reshape(-1, width), np.array(cuts), np.array(children, dtype=np.int64).reshape(-1, 2), np.array(sizes), root)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while (moving := np.flatnonzero(at >= 0)).size:
            node = at[moving]
            right = np.einsum("nd,nd->n", points[moving], self.directions[node]) >= self.cuts[node]
            at[moving] = self.children[node, right.astype(int)]
        return -1 - at


@dataclass(frozen=True)
class Forest:
    """``enough``: points of the sample in the leaves that a query is led to; of a large leaf's rows it is compared with one in ``widen``."""

    trees: list[Tree]
    enough: float
    widen: int = 1

    @classmethod
    def fit(cls, points: np.ndarray, k: int, share: float = 1.0, rows: DataFrame | None = None) -> Forest:
        """Fits on ``points``, a ``share`` of all rows, for queries for ``k`` neighbours; ``rows`` (vector) are all of them, if that is more."""
        rng = np.random.default_rng(SEED)
        leaf = max(LEAF, math.ceil(LEAF_ROWS * share))
        all_trees = [Tree.fit(points, rng, leaf) for _ in range(max(TREES))]
        n = len(points)
        if n <= 4 * leaf:  # a few leaves in all: every one is searched, whatever the measure would say
            return cls(all_trees[: min(TREES)], float("inf"))
        tried = points[rng.permutation(n)[:TRIALS]]
        homes = _true_homes(points, tried, all_trees, k) if rows is None else _true_homes_of_all(rows, tried, all_trees, k)
        best: tuple[float, int] | None = None
        for count in TREES:
            forest = cls(all_trees[:count], float("inf"))
            needed = np.array([x for q, near in zip(tried, homes, strict=True) for x in forest._needed(q, near)])
            # the least of the tried shares that reaches the recall on a whole sample; on a whole table the very number
            good = [s * n for s in SHARES if s <= count and np.mean(needed < s * n) >= TARGET_RECALL] if rows is None else [float(np.quantile(needed, TARGET_RECALL, method="higher")) + 1]
            if good and (best is None or good[0] < best[0]):
                best = good[0], count
        if best is None:
            return cls(all_trees[: min(TREES)], float("inf"))
        widen = WIDEN if leaf / share > 2 * LEAF_ROWS else 1
        return cls(all_trees[: best[1]], max(best[0] * widen, float(leaf)), widen)

    def _needed(self, point: np.ndarray, homes: np.ndarray) -> list[float]:
        """For each of the neighbours with these leaves (one a tree), how many points lie in the leaves that are searched before it is met."""
        wanted: dict[tuple[int, int], list[int]] = {}
        for i, leaves in enumerate(homes.tolist()):
            for t, leaf in enumerate(leaves[: len(self.trees)]):
                wanted.setdefault((t, leaf), []).append(i)
        out, taken, left = [float("inf")] * len(homes), 0, len(homes)
        for t, leaf, _ in self.search(point, float("inf")):
            for i in wanted.get((t, leaf), ()):
                if out[i] == float("inf"):
                    out[i] = taken
                    left -= 1
            if not left:
                break
            taken += int(self.trees[t].sizes[leaf])
        return out

    def search(self, point: np.ndarray, enough: float | None = None) -> Iterator[tuple[int, int, float]]:
        """(tree, leaf, distance beyond hyperplanes), nearest first, until the leaves hold enough sample points."""
        enough = self.enough if enough is None else enough
        sides = [t.directions @ point - t.cuts for t in self.trees]
        heap = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
        taken = 0
        while heap and taken < enough:
            beyond, k, at = heapq.heappop(heap)
            tree = self.trees[k]
            while at >= 0:
                side = sides[k][at]
                right = int(side >= 0)
                heapq.heappush(heap, (max(beyond, abs(side)), k, int(tree.children[at, 1 - right])))
                at = int(tree.children[at, right])
            taken += tree.sizes[-1 - at]
            yield k, -1 - at, beyond


def _homes(trees: list[Tree], points: np.ndarray) -> np.ndarray:
    return np.stack([t.leaf_of(points) for t in trees], axis=1)


def _true_homes(points: np.ndarray, tried: np.ndarray, trees: list[Tree], k: int) -> list[np.ndarray]:
    """The leaves, one a tree, of each tried point's true neighbours among the points."""
    leaves, out = _homes(trees, points), []
    for q in tried:
        far = ((points - q) ** 2).sum(axis=1)
        far[far == 0] = np.inf  # itself: vectors are distinct
        out.append(leaves[np.argpartition(far, min(k, len(far) - 1))[:k]])
    return out


def _true_homes_of_all(rows: DataFrame, tried: np.ndarray, trees: list[Tree], k: int) -> list[np.ndarray]:
    """``_true_homes`` among all rows (vector): each task sends the nearest of its rows for each of the tried points, a bounded query set."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, len(trees)), dtype=np.int64)) for _ in tried]
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            own = _vectors(batch.column("vector"))
            square = (own**2).sum(axis=1)[None, :] + (tried**2).sum(axis=1)[:, None] - 2 * tried @ own.T
            for i, line in enumerate(square):
                first = np.argpartition(line, min(k, len(line) - 1))[: k + 1]
                far = ((own[first] - tried[i]) ** 2).sum(axis=1)
                first, far = first[far > 0], far[far > 0]
                far, homes = np.append(best[i][0], far), np.vstack([best[i][1], _homes(trees, own[first])]) if len(first) else best[i][1]
                keep = np.argsort(far, kind="stable")[:k]
                best[i] = far[keep], homes[keep]
        trial = np.repeat(np.arange(len(tried)), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(trial, pa.int32()), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.vstack([b[1] for b in best]).tolist(), pa.list_(pa.int32()))], names=["trial", "far", "homes"])

    met = rows.select("vector").mapInArrow(near, "trial int, far double, homes array<int>")
    nth = F.row_number().over(Window.partitionBy("trial").orderBy("far"))
    found = met.withColumn("nth", nth).filter(F.col("nth") <= k).select("trial", "homes").collect()  # TRIALS x k rows
    out: list[list[list[int]]] = [[] for _ in tried]
    for r in found:
        out[r["trial"]].append(r["homes"])
    return [np.array(h).reshape(-1, len(trees)) for h in out]


ROW = "tree int, bundle int, part int, kind int, leaves array<int>, key long, ids array<long>, vector array<double>"
#: Kinds of ROW, in the order in which a task meets them.
HELD, ASKING = 0, 1


@dataclass(frozen=True)
class Bundles:
    """For one tree, the bundle of each leaf, and into how many parts each bundle is dealt."""

    of: np.ndarray
    parts: np.ndarray

    @classmethod
    def plan(cls, tree: Tree, share: float) -> Bundles:
        rows = tree.sizes / max(share, 1e-12)
        of = ((np.cumsum(rows) - rows / 2) // PART_ROWS).astype(int)
        of = np.unique(of, return_inverse=True)[1]
        return cls(of, np.maximum(1, np.ceil(np.bincount(of, rows) / (1.5 * PART_ROWS))).astype(int))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _rows(places: list[np.ndarray], kind: int, leaves: list, keys: list[int], ids: list[list[int]], vectors: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(x), type=pa.int32()) for x in (*places, np.full(len(keys), kind))]
    columns += [pa.array(leaves, pa.list_(pa.int32())), pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(vectors, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "bundle", "part", "kind", "leaves", "key", "ids", "vector"])


@dataclass
class Held:
    """The rows of one part of a bundle, by leaf."""

    leaves: np.ndarray
    ids: list[list[int]]
    vectors: np.ndarray
    widen: int = 1
    split: dict[int, tuple[Forest, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], widen: int = 1) -> Held:
        leaves = np.concatenate([b.column("leaves").flatten().to_numpy() for b in batches])
        order = np.argsort(leaves, kind="stable")
        ids = [x for b in batches for x in b.column("ids").to_pylist()]
        return cls(leaves[order], [ids[i] for i in order.tolist()], np.concatenate([_vectors(b.column("vector")) for b in batches])[order], widen)

    def _part(self, leaf: int, first: int, last: int) -> tuple[Forest, np.ndarray]:
        """A tree of a large leaf's own rows, and each row's place in it."""
        if leaf not in self.split:
            own = self.vectors[first:last]
            tree = Tree.fit(own, np.random.default_rng([SEED, leaf]), LEAF_ROWS)
            self.split[leaf] = Forest([tree], len(own) / self.widen), tree.leaf_of(own)
        return self.split[leaf]

    def _blocks(self, leaf: int, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries by their place in ``asked``, rows) that are compared: all with all, but in a large leaf only with the nearest of its parts."""
        first, last = np.searchsorted(self.leaves, leaf), np.searchsorted(self.leaves, leaf, "right")
        if self.widen == 1 or last - first <= 2 * LEAF_ROWS:
            yield np.arange(len(asked)), np.arange(first, last)
            return
        forest, places = self._part(leaf, first, last)
        looks: dict[int, list[int]] = {}
        for q, point in enumerate(asked):
            for _, at, _ in forest.search(point):
                looks.setdefault(at, []).append(q)
        for at, who in looks.items():
            yield np.array(who), first + np.flatnonzero(places == at)

    def nearest(self, asking: pa.RecordBatch, keep: int) -> list[list[tuple[float, int]]]:
        """For each query its ``keep`` best among the rows in the leaves that it looks at."""
        vectors, best = _vectors(asking.column("vector")), [[] for _ in range(asking.num_rows)]
        column = asking.column("leaves")
        who = np.repeat(np.arange(asking.num_rows), pa.compute.list_value_length(column).to_numpy())
        where = column.flatten().to_numpy()
        order = np.argsort(where, kind="stable")
        where, who = where[order], who[order]
        for leaf in np.intersect1d(where, self.leaves).tolist():
            own = who[np.searchsorted(where, leaf) : np.searchsorted(where, leaf, "right")]
            for asked, rows in self._blocks(leaf, vectors[own]):
                found = [best[i] for i in own[asked].tolist()]
                for at in range(0, len(rows), BLOCK):
                    block = rows[at : at + BLOCK]
                    closest(vectors[own[asked]], self.vectors[block], [self.ids[i] for i in block.tolist()], found, keep)
                for i, x in zip(own[asked].tolist(), found, strict=True):
                    best[i] = x
        return best


def closest(vectors: np.ndarray, block: np.ndarray, ids: list[list[int]], best: list[list[tuple[float, int]]], keep: int) -> None:
    """Merges a block of rows into each query's ``keep`` best (distance, id).

    A matrix product finds who can be among the best, with room for its rounding; their distances are then computed exactly.
    """
    norms = (block**2).sum(axis=1)
    for first in range(0, len(vectors), BLOCK):
        asked = vectors[first : first + BLOCK]
        own = (asked**2).sum(axis=1)[:, None]
        square = own + norms[None, :] - 2 * (asked @ block.T)
        slack = 1e-9 * (own + norms.max())
        bound = np.array([[best[first + q][-1][0] ** 2 if len(best[first + q]) >= keep else np.inf] for q in range(len(asked))])
        if len(block) > keep:
            bound = np.minimum(bound, np.partition(square, keep - 1, axis=1)[:, keep - 1 : keep])
        rows, columns = np.nonzero(square <= bound + slack)
        far = np.sqrt(((asked[rows] - block[columns]) ** 2).sum(axis=1)).tolist()
        ends = np.searchsorted(rows, np.arange(len(asked) + 1)).tolist()
        columns = columns.tolist()
        for q, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if b > a:
                more = [(far[x], i) for x in range(a, b) for i in ids[columns[x]]]
                best[first + q] = sorted(best[first + q] + more)[:keep]


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all numbers finite."""
    finite = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(table: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of ``table`` (vec_id, embedding) for those of its rows for which ``queries`` (over vec_id) holds.

    Result: query_id, rank (from 1), vec_id, score, the Euclidean distance in double precision; nearest first, ties
    by vec_id; fewer rows if there are fewer candidates. A row's own vec_id is no candidate. Vectors that are
    null, zero or hold null or non-finite numbers take no part, nor do those of another length than most, nor rows with a
    null vec_id. Repeated rows count once; a vec_id with several vectors is a query with each of them, and each gives ranks
    of its own under the one query_id. An empty table gives no rows. Extra columns are ignored.
    """
    spark = table.sparkSession
    rows = pick(table, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    width, n = lengths["d"], lengths["n"]
    rows = rows.filter(F.size("vector") == width).withColumn("key", F.xxhash64("vector", F.lit(1))).withColumn("check", F.xxhash64("vector", F.lit(2))).distinct()
    # a vector's k + 1 smallest ids are all that a query can need: k and its own
    least = F.row_number().over(Window.partitionBy("key", "check").orderBy("vec_id"))
    distinct = stash(rows.withColumn("nth", least).filter(F.col("nth") <= k + 1).groupBy("key", "check").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")), "vectors")
    asked = rows.filter(queries).select("vec_id", "key", "check", "vector")
    sought = stash(asked.groupBy("key", "check").agg(F.first("vector").alias("vector")), "queries")
    size = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // width))
    share = min(1.0, size / n)
    sample = distinct.filter(F.pmod("check", F.lit(1 << 20)) < int(share * (1 << 20))).select("vector").limit(2 * size).toArrow()
    points = _vectors(sample.column("vector").combine_chunks()) if sample.num_rows else np.zeros((0, width))
    points = points[np.lexsort(points.T)]
    forest = Forest.fit(points, min(k, max(1, len(points) - 1)), share, distinct if share < 1 else None)
    bundles = [Bundles.plan(t, share) for t in forest.trees]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            own, keys, ids = _vectors(batch.column("vector")), batch.column("key").to_pylist(), batch.column("ids").to_pylist()
            for t, tree in enumerate(forest.trees):
                leaf = tree.leaf_of(own)
                bundle = bundles[t].of[leaf]
                part = np.array(keys) % bundles[t].parts[bundle]
                yield _rows([np.full(len(own), t), bundle, part], HELD, leaf[:, None].tolist(), keys, ids, list(own))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, check, own in zip(batch.column("key").to_pylist(), batch.column("check").to_pylist(), _vectors(batch.column("vector")) if batch.num_rows else [], strict=True):
                looks: dict[tuple[int, int], list[int]] = {}
                for t, leaf, _ in forest.search(own):
                    looks.setdefault((t, int(bundles[t].of[leaf])), []).append(leaf)
                at = [(t, b, p, leaves) for (t, b), leaves in looks.items() for p in range(bundles[t].parts[b])]
                m = len(at)
                yield _rows(list(np.array([x[:3] for x in at]).T), ASKING, [x[3] for x in at], [key] * m, [[check]] * m, [own] * m)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(c).to_numpy() for c in ("tree", "bundle", "part", "kind")], axis=1)
            begin = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(axis=1)))
            for a, b in zip(begin, np.append(begin[1:], len(where)), strict=True):
                if tuple(where[a, :3]) != place:
                    place, waiting, held = tuple(where[a, :3]), [], None
                run = batch.slice(a, b - a)
                if where[a, 3] == HELD:
                    waiting.append(run)
                    continue
                if waiting:
                    held, waiting = Held.of(waiting, forest.widen), []
                if held is None:
                    continue
                keys, checks = run.column("key").to_pylist(), run.column("ids").to_pylist()
                out = [(key, check[0], i, d) for key, check, found in zip(keys, checks, held.nearest(run, k + 1), strict=True) for d, i in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=["key", "check", "vec_id", "score"])

    met = distinct.select("key", "ids", "vector").mapInArrow(index, ROW).union(sought.mapInArrow(probe, ROW))
    met = met.repartition("tree", "bundle", "part").sortWithinPartitions("tree", "bundle", "part", "kind")
    pairs = met.mapInArrow(compare, "key long, check long, vec_id long, score double").distinct()
    by_score = F.row_number().over(Window.partitionBy("key", "check").orderBy("score", "vec_id"))
    found = stash(pairs.withColumn("nth", by_score).filter(F.col("nth") <= k + 1).groupBy("key", "check").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found")), "found")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    joined = asked.select(F.col("vec_id").alias("query_id"), "key", "check").join(found, ["key", "check"])
    ranked = joined.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
