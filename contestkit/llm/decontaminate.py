"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask is a set of word offsets; the words between them are ignored, so a seed survives a
substituted word there. The masks are chosen so that every overlap that passes the verification has a seed. Every position of every text is hashed under each mask and joined
with the same hashes of the benchmark; the first two words that a mask reads are looked up before the rest is hashed. Around each hit the two texts are laid over each other word by word
and the overlap is verified: some ``OVERLAP`` words in a row of which a share of ``SIMILARITY`` agree.

The benchmark's hashes are broadcast in blocks of a bounded number of rows, so that no text is
shuffled; a larger benchmark takes more blocks, each a scan of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.llm.common import pick, small, stash

#: Offsets of the words that each mask reads. Of 12 words in a row any two may differ and one of the first three
#: masks still fits between them; of 10 words, one of the second five. So no overlap is lost.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 8, 9))
MASKS_OF_10 = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 5, 6, 7), (0, 1, 3, 4, 7, 8), (0, 1, 2, 3, 5, 7), (0, 2, 4, 5, 6, 7))
#: Words in a row that are verified, and the share of them that must agree.
OVERLAP, SIMILARITY = 12, 0.8
#: Most hashes of the benchmark in one broadcast: about 20 MB.
BLOCK_ROWS = 400_000


@dataclass(frozen=True)
class Mask:
    """Word offsets to read, and the least and most words of the items that it is for."""

    offsets: tuple[int, ...]
    least: int
    most: int

    @property
    def gap(self) -> int:
        """From the first word it reads to the second; zero if there is one only."""
        return self.offsets[1] if len(self.offsets) > 1 else 0


def masks_for(lengths: list[int]) -> list[Mask]:
    """The masks for a benchmark whose items under ``OVERLAP`` words have these lengths.

    Items of 10 or 11 words may differ in two words; those of 5 to 9 in one, which one mask each leaves out; shorter ones in none.
    """
    masks = [Mask(m, OVERLAP, 1 << 30) for m in MASKS]
    for n in sorted(set(lengths)):
        if n >= 10:
            masks += [Mask(m, n, n) for m in MASKS_OF_10]
        elif n >= 5:
            masks += [Mask(m, n, n) for m in dict.fromkeys(tuple(k - (out == 0) for k in range(n) if k != out) for out in range(n))]  # all begin at 0
        else:
            masks.append(Mask(tuple(range(n)), n, n))
    return masks


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(df: DataFrame, key: str) -> DataFrame:
    tokens = df.select(key, words(F.col("text")).alias("w"))
    return tokens.select(key, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def _constant(values: list[int | None]) -> Column:
    return F.array(*[F.lit(x).cast("int") for x in values])


def _pairs(hashed: DataFrame, masks: list[Mask]) -> DataFrame:
    """Adds (at, gap, pair) for every position: the hash of its word and the one ``gap`` further on, the first two that a mask reads."""
    gaps = sorted({m.gap for m in masks})
    n = len(gaps)
    spread = hashed.filter(F.size("h") > min(m.offsets[-1] for m in masks)).withColumn("v", F.explode(F.sequence(F.lit(0), F.size("h") * n - 1)))
    placed = spread.withColumn("at", F.expr(f"v div {n}").cast("int")).withColumn("gap", F.get(_constant(gaps), F.col("v") % n)).drop("v")
    return placed.withColumn("pair", F.xxhash64("gap", F.get("h", F.col("at")), F.get("h", F.col("at") + F.col("gap"))))


def _seeds(placed: DataFrame, masks: list[Mask]) -> DataFrame:
    """Adds mask and seed for every mask that begins with the row's gap and fits.

    Offsets are looked up by the mask's number in constant arrays, so one hash expression serves all masks and
    the generated code stays small enough for the JIT compiler. Slots that a short mask lacks are null, which the hash skips.
    """
    slots = [_constant([m.offsets[j] if j < len(m.offsets) else None for m in masks]) for j in range(max(len(m.offsets) for m in masks))]
    own = F.when(F.col("gap").isNull(), _constant([]))
    for gap in sorted({m.gap for m in masks}):
        own = own.when(F.col("gap") == gap, _constant([k for k, m in enumerate(masks) if m.gap == gap]))
    spread = placed.withColumn("mask", F.explode(own))
    fitting = spread.filter(F.col("at") + F.get(_constant([m.offsets[-1] for m in masks]), F.col("mask")) < F.size("h"))
    return fitting.withColumn("seed", F.xxhash64("mask", *[F.get("h", F.col("at") + F.get(slot, F.col("mask"))) for slot in slots])).drop("gap")


def _found(hashed: DataFrame, items: DataFrame) -> DataFrame:
    """(key, rep, doc_start, aligned, agreeing): the best verified overlap of each text of ``hashed`` (key, h) with each of ``items`` (rep, h), a written table."""
    short = [r["n"] for r in items.select(F.size("h").alias("n")).filter(F.col("n") < OVERLAP).distinct().collect()]  # eleven values at most
    masks = masks_for(short)
    own = F.size("h").between(F.get(_constant([m.least for m in masks]), F.col("mask")), F.get(_constant([m.most for m in masks]), F.col("mask")))
    seeds = stash(_seeds(_pairs(items, masks), masks).filter(own).select("pair", "seed", "rep", F.col("at").alias("item_at"), F.size("h").alias("item_n")), "seeds")
    blocks = max(1, -(-seeds.count() // BLOCK_ROWS))
    shift = F.col("at") - F.col("item_at")
    begin = F.greatest(shift, F.lit(0))
    covered = F.slice("h", begin + 1, F.least(F.col("item_n") + shift, F.size("h")) - begin)
    found = []
    for block in range(blocks):
        part = seeds.filter(F.pmod("pair", F.lit(blocks)) == block)  # about BLOCK_ROWS rows of five numbers
        near = _pairs(hashed, masks).join(F.broadcast(part.select("pair").distinct()), "pair", "left_semi")
        met = _seeds(near, masks).drop("pair", "mask").join(F.broadcast(part.drop("pair")), "seed")
        found.append(met.select("key", "rep", shift.alias("shift"), covered.alias("covered")))
    hits = reduce(DataFrame.union, found).distinct()
    first = F.greatest(-F.col("shift"), F.lit(0))
    same = F.zip_with(F.slice("h", first + 1, F.size("covered")), "covered", lambda a, b: (a == b).cast("int"))
    laid = hits.join(items, "rep").select("key", "rep", F.greatest("shift", F.lit(0)).alias("doc_start"), F.size("h").alias("item_n"), same.alias("same"))
    need = F.least("item_n", F.lit(OVERLAP))
    enough = F.exists(
        F.sequence(F.lit(0), F.size("same") - need),
        lambda s: F.aggregate(F.slice("same", s + 1, need), F.lit(0), lambda total, x: total + x) >= F.ceil(need * F.lit(SIMILARITY)),
    )
    verified = laid.filter(F.size("same") >= need).filter(enough).withColumn("agreeing", F.aggregate("same", F.lit(0), lambda total, x: total + x))
    best = F.max(F.struct("agreeing", F.size("same").alias("aligned"), (-F.col("doc_start")).alias("back")))
    return verified.groupBy("key", "rep").agg(best.alias("b")).select("key", "rep", (-F.col("b.back")).alias("doc_start"), F.col("b.aligned").alias("aligned"), F.col("b.agreeing").alias("agreeing"))


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, h) of the distinct items by their words, and (rep, item_id) of all items; both written tables. Items without words are left out."""
    own = F.concat_ws("-", F.xxhash64("h"), F.xxhash64("h", F.lit(1)))
    members = stash(_hashed(pick(benchmark, "item_id", "text"), "item_id").filter(F.size("h") > 0).withColumn("rep", own), "benchmark-items")
    return stash(members.groupBy("rep").agg(F.first("h").alias("h")), "items"), members.select("rep", "item_id").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text).

    One row per doc_id and item_id: doc_start, the first word of the best overlap's aligned part in the text;
    aligned, its length in words; agreeing, how many of them are equal. An item of fewer than ``OVERLAP`` words
    must be there as a whole, one of fewer than five without any difference: an item of one word overlaps every text
    that holds the word. Items of equal words are searched once. Rows that repeat a doc_id give one result for all
    of them. Null and empty texts overlap nothing; rows with a null doc_id or item_id are reported under null.
    Empty tables give no rows. Extra columns are ignored.
    """
    items, members = _items(benchmark)
    found = _found(_hashed(pick(docs, "doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "key"), items)
    return found.join(members, "rep").select(F.col("key").alias("doc_id"), "item_id", "doc_start", "aligned", "agreeing")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose own text overlaps the benchmark; all columns stay.

    Each row is judged by its text alone, whatever its doc_id: a null or repeated doc_id changes nothing. Rows with a null or
    empty text stay; an empty table gives no rows.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = F.col(f"c{columns.index('text')}")
    key = lambda x: F.struct(F.xxhash64(x).alias("k1"), F.xxhash64(x, F.lit(1)).alias("k2"))  # noqa: E731  128 bits of the text
    rows = pick(docs, "text").select(key("text").alias("key"), words(F.col("text")).alias("w")).select("key", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    bad = small(stash(_found(rows, _items(benchmark)[0]).select("key.k1", "key.k2").distinct(), "contaminated"))
    marked = plain.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(text, F.lit(1))})
    return marked.join(bad, ["k1", "k2"], "left_anti").select(*plain.columns).toDF(*columns)


def oracle() -> str:
    """The same result in SQL, on words instead of hashes; masks for item lengths that the benchmark lacks read nothing."""

    def keys(id_: str, table: str, of_items: bool) -> str:
        parts = []
        for k, mask in enumerate(masks_for(list(range(1, OVERLAP)))):
            seed = f"'{k}|' || " + " || '|' || ".join(f"w[i + {o + 1}]" for o in mask.offsets)
            which = f"len(w) between {mask.least} and {mask.most}" if of_items else f"(select count(*) from b where len(w) between {mask.least} and {mask.most}) > 0"
            parts.append(f"select {id_}, w, i as at, {seed} as seed from {table}, range(len(w) - {mask.offsets[-1]}) as r(i) where len(w) > {mask.offsets[-1]} and {which}")
        return " union all ".join(parts)

    need = f"least(len(iw), {OVERLAP})"
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
with d as (select doc_id, {split} as w from documents), b as (select distinct item_id, {split} as w from benchmark),
dk as ({keys("doc_id", "d", False)}), bk as ({keys("item_id", "b", True)}),
hits as (select distinct dk.doc_id, bk.item_id, dk.w as dw, bk.w as iw, cast(dk.at - bk.at as integer) as shift from dk join bk using (seed)),
laid as (select doc_id, item_id, iw, greatest(shift, 0) as doc_start,
  list_transform(range(greatest(-shift, 0), least(len(iw), len(dw) - shift)), lambda k: case when iw[k + 1] = dw[k + shift + 1] then 1 else 0 end) as same from hits),
ok as (select *, list_sum(same) as agreeing, len(same) as aligned from laid where len(same) >= {need}
  and list_max(list_transform(range(0, len(same) - {need} + 1), lambda s: list_sum(same[s + 1 : s + {need}]))) >= ceil({need} * {SIMILARITY})),
best as (select *, row_number() over (partition by doc_id, item_id order by agreeing desc, aligned desc, doc_start) as n from ok)
select doc_id, item_id, cast(doc_start as integer) as doc_start, cast(aligned as integer) as aligned, cast(agreeing as integer) as agreeing from best where n = 1"""


def least_agreeing(words_in_item: int) -> int:
    """How many words must agree for an item of that many words."""
    return math.ceil(min(words_in_item, OVERLAP) * SIMILARITY)
