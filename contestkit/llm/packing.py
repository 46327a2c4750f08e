"""Best-fit packing by minimum bin slack.

Token lengths are at most the capacity, so the histogram of lengths has at most that many
entries whatever the corpus holds. The driver packs the histogram only: for each bin a bitset
subset-sum finds the fullest combination around the longest length left, and the same
combination is taken off as often as the counts allow. The plan is a list of rank intervals; pieces
find their place by their rank among the pieces of equal length. Ranks are dealt out in hashed
buckets, so a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestkit.llm.common import chunks, pick, stash

CAPACITY = 2048
END_ID = 0
#: Pieces of one length and one bucket that a task ranks, on average at most.
RANKED_TOGETHER = 4_000
VOCABULARY = "byte_bpe_50k.tiktoken"
#: White-space characters in a row from which the fast encoder is not used; it works up to about 990,000.
LONG_RUN = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def _tokenizer(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """Text to the ids of the tokenizer with the public vocabulary of that file name; added tokens in a text have their own ids.

    A rank file's encoder is several times faster and gives the same ids (the tests go through the whole vocabulary),
    except that it knows no added tokens and fails on runs of about a million white-space characters. Texts with
    an added token or a run of ``LONG_RUN`` go through the tokenizer of the JSON file of the same name.
    """
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".json"):
        return _tokenizer(path)
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = path.removesuffix(".tiktoken") + ".json"
    with open(whole, encoding="utf-8") as file:
        added = [x["content"] for x in json.load(file)["added_tokens"]]
    long_run = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")  # tried at the start of a run only, so linear
    exact: list[Callable[[str], list[int]]] = []  # loaded when the first text needs it

    def encode(text: str) -> list[int]:
        if any(x in text for x in added) or len(text) >= LONG_RUN and long_run.search(text):
            if not exact:
                exact.append(_tokenizer(whole))
            return exact[0](text)
        return fast(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text): its ids and ``end_id``, cut at the capacity.

    A null text counts as empty and gives one piece that holds ``end_id`` alone.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in chunks(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                rows += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(values, type=kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, "doc_id", "text").mapInArrow(pieces, PIECES)


def fullest(room: int, counts: dict[int, int], order: list[int]) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room``.

    A bitset holds the sums reached; bit s is set once s can be filled. Long lengths come first, so
    that of equally full combinations one with long pieces is found and short ones remain for later.
    """
    reach, steps = 1, []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for length in order:
        left = min(counts[length], room // length)
        take = 1
        while left and not reach & goal:
            take = min(take, left)
            before = reach
            reach |= (reach << (length * take)) & mask
            if reach != before:
                steps.append((length, take, before))
            left -= take
            take *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination as length -> pieces, bins of it), until the histogram is empty."""
    counts = {length: n for length, n in histogram.items() if n}
    order = sorted(counts, reverse=True)
    plan = []
    while order:
        seed = order[0]
        counts[seed] -= 1
        room = capacity - seed
        bin_ = fullest(room, counts, [x for x in order if x <= room and counts[x]]) if room else {}
        counts[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(counts[length] // n for length, n in bin_.items())
        for length, n in bin_.items():
            counts[length] -= n * times
        plan.append((bin_, times))
        order = [x for x in order if counts[x]]
    return plan


@dataclass(frozen=True)
class Places:
    """Rank intervals by (length, first rank), as arrays; at most 63 lengths for each combination."""

    key: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, plan: list[tuple[dict[int, int], int]]) -> Places:
        rows, used, sequence = [], {}, 0
        for bin_, times in plan:
            offset = 0
            for length in sorted(bin_, reverse=True):
                n, first = bin_[length], used.get(length, 0)
                rows.append(((length << 44) + first, first, n, sequence, offset))
                used[length] = first + n * times
                offset += n * length
            sequence += times
        return cls(*(np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, np.int64)] * 5)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to the rows of a stored table of ``token_pieces``.

    Reads ``pieces`` more than once: pass a written table.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = Places.of(minimum_bin_slack(histogram, capacity))
    buckets = max(1, -(-sum(histogram.values()) // RANKED_TOGETHER))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Result, one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null or
    empty text: one piece with the end id. Repeated rows are packed as often as they occur; a null
    doc_id stays null. Equal lengths are interchangeable, ties go by doc_id, piece, start, crc. An
    empty table gives no rows. Extra columns are ignored.
    """
    return pack(stash(token_pieces(docs, capacity, vocabulary=vocabulary), "pieces"), capacity)
