"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints link at three or fewer differing bits. Cut into two halves, one half of a linked pair
differs by at most one bit, so the pair agrees on one of that half's 32 variants with one bit made a
wildcard. Each distinct fingerprint is indexed under its 64 variants; rows that meet under an equal
key are verified on all 64 bits. Copies share a fingerprint and are one entry of the index.

Verified links leave a key's group as a spanning forest, not as all pairs. A group over ``BLOCK`` members
is never held: its members go on to a second index, whose keys add the same kind of variant of the other
half, in two quarters. A group there agrees on 46 of 64 bits and so has at most 2**18 members, however
large the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.llm.common import pick, small, stash
from contestkit.llm.graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Members of a key's group that are compared directly.
BLOCK = 256

#: Fingerprints that a task of their own is not left with: those of more than one in so many rows.
HOT = 10_000

#: One byte's bits, each in a byte of its own.
_SPREAD = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], dtype=np.uint64)


def _majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """For each run of ``counts`` hashes the 64-bit majority (over half); empty runs give zero."""
    out = np.zeros(len(counts), dtype=np.uint64)
    sizes = np.array(counts, dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    # byte lanes hold up to 255, so runs are summed in pieces of at most 255 first
    pieces = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    nth = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], np.repeat(begin, pieces) + nth * 255, axis=0)
    bits = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
    over = (2 * bits > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _shingle_digests(text: bytes, width: int) -> list[bytes]:
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white space characters
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(s), SEED) for s in zip(*[words[k:] for k in range(width)], strict=False)]


def fingerprint(width: int = SHINGLE) -> Callable[[Column], Column]:
    """Column function: text to its signed 64-bit SimHash. Null, empty and blank texts give 0."""

    def of(texts: pa.Array) -> pa.Array:
        digests: list[bytes] = []
        counts: list[int] = []
        done = [np.zeros(0, np.uint64)]

        def flush() -> None:
            done.append(_majority(np.frombuffer(b"".join(digests), dtype=">u8").astype("<u8"), counts))
            digests.clear()
            counts.clear()

        for x in texts.cast(pa.binary()):
            own = _shingle_digests(x.as_py() or b"", width)
            counts.append(len(own))
            digests += own
            if len(digests) > 50_000:
                flush()
        flush()
        return pa.array(np.concatenate(done).view(np.int64))

    return F.arrow_udf(of, "long")


def _pairs_linked(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[:, None] ^ others[None, :]) <= MAX_BITS


def spanning_links(values: np.ndarray) -> list[tuple[int, int]]:
    """Links (larger, smaller) that join the same fingerprints as all verified pairs of ``values``.

    Compares block by block and stops once all are joined; keeps the members alone.
    """
    n = len(values)
    above = np.arange(n)

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = int(above[x])
        return x

    links = []
    for at in range(0, n, BLOCK):
        for other in range(at, n, BLOCK):
            if len(links) == n - 1:
                return links
            while (above[above] != above).any():
                above[:] = above[above]
            apart = above[at : at + BLOCK, None] != above[None, other : other + BLOCK]
            i, j = np.nonzero(apart & _pairs_linked(values[at : at + BLOCK], values[other : other + BLOCK]))
            for a, b in zip((i + at).tolist(), (j + other).tolist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    links.append((int(values[a]), int(values[b])))
    return links


def _as_batch(names: list[str], *columns: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in columns], names=names)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None) -> Iterator[tuple[np.ndarray, bool]]:
    """Fingerprints of each run of equal keys that has two members or more, from rows sorted by the keys.

    With ``most``, a longer run comes in parts of that size, marked True.
    """
    held_key, held, long = None, [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        fps = batch.column("fp").to_numpy().view(np.uint64)
        new = np.ones(len(fps), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(fps))
        keep = (ends - at > 1) | (at == 0) | (ends == len(fps))
        for a, b in zip(at[keep].tolist(), ends[keep].tolist(), strict=True):
            key = tuple(int(c[a]) for c in cols)
            if key != held_key:
                if held and (long or sum(map(len, held)) > 1):
                    yield np.concatenate(held), long
                held_key, held, long = key, [], False
            held.append(fps[a:b].copy())
            while most and sum(map(len, held)) > most:
                joined = np.concatenate(held)
                yield joined[:most], True
                held, long = [joined[most:]], True
    if held and (long or sum(map(len, held)) > 1):
        yield np.concatenate(held), long


def _link_groups(rows: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """(a, b, kind) from rows (keys..., fp): kind 1 links a and b; kind 0: a is a member of a group over ``most``."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for fps, long in _grouped(batches, keys, most):
            if long:
                same = fps.view(np.int64)
                yield _as_batch(["a", "b", "kind"], same, same, np.zeros(len(same)))
                continue
            out += [(a, b, 1) for a, b in spanning_links(fps)]
            if len(out) > 50_000:
                yield _signed(out)
                out = []
        yield _signed(out)

    def _signed(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        table = np.array(out, dtype=object).reshape(-1, 3)
        a, b = (table[:, k].astype(np.uint64).view(np.int64) for k in (0, 1))
        return _as_batch(["a", "b", "kind"], a, b, table[:, 2].astype(np.int64))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link, "a long, b long, kind long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): verified links between distinct fingerprints ``prints`` (fp long) that join all that are linked."""
    wild = F.expr("explode(sequence(0, 63))").alias("v")
    half = F.expr("shiftright(fp, 32 * (v div 32)) & 4294967295L")
    rows = prints.select("fp", wild).select(F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(half.bitwiseAND(F.expr("~shiftleft(1L, v % 32)"))).alias("key"), "fp")
    first = stash(_link_groups(rows, ["key"], BLOCK), "links")
    dense = first.filter("kind = 0").select(F.col("a").alias("fp")).distinct()
    # Members of dense groups meet again, under each half's variant together with a quarter's variant of the other half.
    finer = (
        dense.select("fp", wild)
        .select("fp", "v", F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(half.bitwiseAND(F.expr("~shiftleft(1L, v % 32)"))).alias("key"), F.expr("shiftright(fp, 32 * (1 - v div 32)) & 4294967295L").alias("rest"))
        .select("fp", "key", "rest", F.expr("explode(sequence(0, 31))").alias("u"))
        .select("key", F.expr("(shiftleft(cast(u as bigint), 32) | (shiftright(rest, 16 * (u div 16)) & 65535L & ~shiftleft(1L, u % 16)))").alias("sub"), "fp")
    )
    second = _link_groups(finer, ["key", "sub"], None)
    return first.filter("kind = 1").select("a", "b").union(second.select("a", "b")).distinct()


def with_components(prints: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) of every fingerprint of ``prints`` (doc_id, fp), a written table; the result is one too.

    n: rows with the fingerprint; root: the component's smallest fingerprint; component_id: the smallest doc_id
    of all fingerprints reachable over links, null if none has a doc_id.
    """
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    linked = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return stash(rooted.join(ids, "root").select("fp", "n", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows repeat.
    A null doc_id stays null and never is a component's id. An empty table gives no rows. Extra columns
    are ignored.
    """
    prints = stash(pick(docs, "doc_id", "text").select("doc_id", fingerprint(width)("text").alias("fp")), "fingerprints")
    found = with_components(prints).select("fp", "n", "component_id")
    # A fingerprint that a HOT-th of all rows has would fill one task: there are at most about HOT such, so they are broadcast.
    least = max(1, prints.count() // HOT)
    hot = F.broadcast(found.filter(F.col("n") >= least).drop("n")) if least > 1 else None
    rest = found.filter(F.col("n") < least).drop("n") if least > 1 else found.drop("n")
    joined = prints.join(rest, "fp") if hot is None else prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(rest, "fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, with all columns.

    It is the row with the smallest doc_id (null last); ties go by hashes of the whole row, so the choice is
    repeatable, and of rows that are equal in every column one stays. Each row is judged by its own text: rows that
    share a doc_id but not a component stay apart. Null, empty and blank texts are one component. An empty table
    gives no rows.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    doc_id, text = (f"c{columns.index(n)}" for n in ("doc_id", "text"))
    whole = [F.to_json(c.name) if "map<" in c.dataType.simpleString() else F.col(c.name) for c in plain.schema]
    # nulls are skipped by the hash, so each value's hash enters; with the text's length that tells columns apart
    marks = [F.xxhash64(F.lit(seed), *[x for i, c in enumerate(whole) for x in (F.lit(i), c)]) for seed in (1, 2)]
    keyed = plain.select("*", marks[0].alias("m1"), marks[1].alias("m2"))
    prints = stash(keyed.select(F.col(doc_id).alias("doc_id"), "m1", "m2", fingerprint(width)(text).alias("fp")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "m1", "m2")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    chosen = stash(first.join(with_components(prints).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.m1", "first.m2"), "kept")
    counted = prints.groupBy("m1", "m2").agg(F.count("*").alias("n")).join(chosen.withColumn("stays", F.lit(True)), ["m1", "m2"], "left")
    dropped = stash(counted.filter("stays is null").select("m1", "m2"), "dropped")
    repeated = stash(counted.filter("stays and n > 1").select("m1", "m2"), "repeated")
    kept = keyed.join(small(dropped), ["m1", "m2"], "left_anti")
    names = plain.columns
    if not repeated.take(1):
        return kept.select(*names).toDF(*columns)
    repeated = small(repeated)
    once = kept.join(repeated, ["m1", "m2"], "left_anti")
    equal = kept.join(repeated, ["m1", "m2"], "left_semi").dropDuplicates(["m1", "m2"])
    return once.select(*names).union(equal.select(*names)).toDF(*columns)
