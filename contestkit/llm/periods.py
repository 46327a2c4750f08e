"""Periodic runs of words: stretches that repeat one unit three times or more, and texts without the repeats.

A run is a maximal stretch with smallest period q of at least ``least`` words and ``times`` periods. Words are interned
to numbers of the text; a text is halved again and again, and the runs across each midpoint come from two Z-functions, one
of the right half over the segment and one of the left half, reversed, over the reversed segment: at distance d the first tells how far
the match goes on after the midpoint, the second how far it reached before it. A run lies within the first segment whose midpoint it
crosses, so a repetition that a segment's border cuts is left to the segment above. The same stretch is found for each multiple
of its period; the smallest stays.

In any run two stretches of ``least - least / times`` words are equal. So texts and segments in which no such window occurs twice
are passed over, and a Z-function is worked out only where at least half of such a window agrees (by hash; the
Z-function itself compares words). All this is exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 24
TIMES = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def intern(words: Iterable[str]) -> list[int]:
    """Numbers of the words, by first use."""
    known: dict[str, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` ids; equal windows have equal hashes."""
    part = (ids.astype(np.uint64) + np.uint64(1)) * _SPREAD
    part ^= part >> np.uint64(29)
    size, out, done = 1, None, 0
    while True:
        if width & size:
            if out is None:
                out = part
            else:
                k = len(part) - done
                out = (out[:k] * (_SPREAD + np.uint64(2 * done)) + part[done:]) if k > 0 else out[:0]
            done += size
        if done == width:
            return out[: max(0, len(ids) - width + 1)]
        k = len(part) - size
        part = (part[:k] * (_SPREAD + np.uint64(2 * size)) + part[size:]) if k > 0 else part[:0]
        size *= 2


def _repeated(hashes: np.ndarray) -> np.ndarray | None:
    """How many of the windows before each place occur more than once; None if none does."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return None
    marks = np.zeros(len(hashes), dtype=bool)
    marks[order[1:][same]] = True
    marks[order[:-1][same]] = True
    return np.concatenate([[0], np.cumsum(marks)])


def z_values(w: list[int], m: int, hi: int, places: list[int]) -> dict[int, int]:
    """For each of the rising ``places`` j but m: how many words from m on equal those from j on, before ``hi``; by distance j - m.

    The pattern w[m:hi] is first matched with itself, then with what lies before it; inside a box that is known to equal
    the pattern's beginning, its own values are taken, so time is linear.
    """
    out: dict[int, int] = {}
    for part in ([j for j in places if j > m], [j for j in places if j < m]):
        left = right = 0
        for j in part:
            k = min(right - j, out.get(j - left, 0)) if j < right else 0
            stop = hi - max(j, m)
            while k < stop and w[j + k] == w[m + k]:
                k += 1
            out[j - m] = k
            if j + k > right:
                left, right = j, j + k
    return out


def find_runs(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, width = len(ids), max(2, least * (times - 1) // times)
    if n < least:
        return []
    numbers = np.array(ids)
    before = _repeated(window_hashes(numbers, width))
    if before is None:
        return []
    seed = (width + 1) // 2
    hashes, back = window_hashes(numbers, seed), ids[::-1]
    found: dict[tuple[int, int], int] = {}
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < least or before[hi - width + 1] == before[lo]:
            continue
        m = (lo + hi) // 2
        stack += [(lo, m), (m, hi)]
        inside = hashes[lo : hi - seed + 1]
        # places from which, and up to which, as many words agree with those at the midpoint
        after = (np.flatnonzero(inside == hashes[m]) + lo).tolist() if m + seed <= hi else []
        until = (np.flatnonzero(inside == hashes[m - seed]) + lo + seed).tolist() if m - seed >= lo else []
        if len(after) < 2 and len(until) < 2:
            continue
        ahead = z_values(ids, m, hi, after)
        behind = {-d: k for d, k in z_values(back, n - m, n - lo, [n - j for j in reversed(until)]).items()}
        for d in ahead.keys() | behind.keys():
            f, k, q = ahead.get(d), behind.get(d), abs(d)
            if f is None:
                f, stop = 0, hi - max(m, m + d)
                while f < stop and ids[m + f] == ids[m + d + f]:
                    f += 1
            if k is None:
                k, stop = 0, min(m, m + d) - lo
                while k < stop and ids[m - 1 - k] == ids[m + d - 1 - k]:
                    k += 1
            length = q + k + f
            if length < max(least, times * q):
                continue
            start = min(m, m + d) - k
            end = start + length
            if (start == lo > 0 and ids[lo - 1] == ids[lo - 1 + q]) or (end == hi < n and ids[hi] == ids[hi - q]):
                continue
            found[start, length] = min(q, found.get((start, length), q))
    return sorted((s, length, q) for (s, length), q in found.items())


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    out, at = [], 0
    for a, b in sorted((s + q, s + length) for s, length, q in runs):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return out + words[at:]


_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(least: int = LEAST, times: int = TIMES) -> Callable[[Column], Column]:
    """Column function: text to struct (n_words long, runs array of (start, length, period) by start, then period, kept string).

    ``kept`` are the words outside repeats, joined by one space. A null, empty or blank text has no word, no run and
    an empty ``kept``. A text is judged by itself alone, whatever its length: repeated rows have equal results.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    whole = [pa.int64(), pa.list_(run), pa.string()]

    def of(texts: pa.Array) -> pa.Array:
        n, runs, kept = [], [], []
        for x in texts:
            words = words_of(x.as_py())
            own = find_runs(intern(words), least, times)
            n.append(len(words))
            runs.append([{"start": s, "length": length, "period": q} for s, length, q in own])
            kept.append(" ".join(kept_words(words, own) if own else words))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip((n, runs, kept), whole, strict=True)], names=["n_words", "runs", "kept"])

    return F.arrow_udf(of, f"struct<n_words:bigint,runs:{_RUN},kept:string>")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; of equal ones the first by start, then period. Null for none."""

    def better(a: Column, b: Column) -> Column:
        left, right = (x["length"].cast("decimal(19,0)") * y["period"].cast("decimal(19,0)") for x, y in ((a, b), (b, a)))
        return F.when(a.isNull() | (left < right), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def runs_text(runs: Column) -> Column:
    """start,length,period and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(text: Column, doc_id: Column) -> Column:
    """The text in which a tenth of the documents, by a hash of the id, repeat a unit of their own words to the end; others unaltered.

    With h = crc32 of the id as text and g = floor(h / 10): if h % 10 is 0 and there are n > 0 words, then from word a = g % n on, word i
    becomes word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)). A null id changes nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    units = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.coalesce(F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(units, F.lit(1), n - a)), " "), text)


def oracle() -> str:
    """DuckDB SQL for the rows of the query on the table documents, whose ids neither repeat nor are null.

    Runs come from equal windows of sixteen words: those at one distance that follow each other are one stretch. CRC-32 is worked out bit by bit.
    """
    step = "case when o >= 0 then xor(c, o) else xor(c >> 1, 3988292384 * (c & 1)) end"
    bits = "list_transform(range(9), lambda k: case when k = 0 then ascii(b)::bigint else -1 end)"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda b: {bits}))), lambda c, o: {step}), 4294967295)"
    return f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, coalesce({crc}, 1) as h from documents),
e as (select doc_id, w, len(w) as n, h, h // 10 as g from d), f as (select *, case when h % 10 = 0 and n > 0 then g % n else n end as a from e),
u as (select *, 1 + (n - a) // (3 + g % 8) as p from f),
x as (select doc_id, n, list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) as w from u),
gram as (select doc_id, n, unnest(list_transform(range(greatest(n - 15, 0)), lambda i: {{'i': i, 'k': array_to_string(w[i + 1:i + 16], ' ')}}), recursive := true) from x),
pair as (select l.doc_id, l.i, r.i - l.i as q, l.n from gram l join gram r on l.doc_id = r.doc_id and l.k = r.k and r.i > l.i and 3 * (r.i - l.i) <= l.n),
island as (select doc_id, q, min(i) as start, max(i) + 16 - min(i) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as part from pair) group by doc_id, q, part),
run as (select doc_id, start, length, min(q) as period from island where length >= greatest(24, 3 * q) group by doc_id, start, length),
told as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as text, first({{'start': start, 'length': length, 'period': period}} order by length / period desc, start, period) as top from run group by doc_id),
word as (select doc_id, unnest(w) as v, unnest(range(n)) as i from x where doc_id in (select doc_id from run)),
gone as (select distinct word.doc_id, word.i from word join run on run.doc_id = word.doc_id and word.i >= run.start + run.period and word.i < run.start + run.length),
kept as (select doc_id, string_agg(v, ' ' order by i) as text from word anti join gone using (doc_id, i) group by doc_id)
select x.doc_id, coalesce(n_runs, 0)::bigint as n_runs, top.start::bigint as start, top.length::bigint as length, top.period::bigint as period, (1000 * top.length // top.period)::bigint as exponent_milli,
 sha256(coalesce(told.text, '')) as runs_sha256, sha256(case when told.doc_id is null then array_to_string(x.w, ' ') else coalesce(kept.text, '') end) as collapsed_sha256
 from x left join told using (doc_id) left join kept using (doc_id)"""
