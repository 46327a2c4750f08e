"""Secret scans with an incremental blob ledger.

Every text is addressed by its SHA-256. The ledger, a Parquet table in the shared folder, holds for
each blob which versions of which rules have scanned it and what they found. A run scans the pairs
of blob and rule version that the ledger lacks, appends them, and joins the findings back to all
rows that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestkit.llm.common import chunks, fresh_path, pick, stash

LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"
#: Up to this many blobs with findings, holding up to this many spans, are broadcast to the rows.
BROADCAST_BLOBS, BROADCAST_SPANS = 200_000, 1_000_000


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A new ``version`` makes the ledger scan all blobs again for this kind."""

    kind: str
    version: int
    find: Callable[[str], list[tuple[int, int]]]

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 or more
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
_WORDS = ("passw", "secret", "token", "api")


def find_assign(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]


def find_access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []


def find_hex(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX.finditer(text)]


def find_pem(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PEM.finditer(text)] if "-----BEGIN" in text else []


def find_jwt(text: str) -> list[tuple[int, int]]:
    """Three parts of eight characters or more with dots between, of which the first two begin with eyJ after which the eight are counted.

    The first may begin within a longer run. Dotted runs are cut once, so time is linear.
    """
    found = []
    for run in _DOTTED.finditer(text) if "eyJ" in text else ():
        parts, at, done = run[0].split("."), run.start(), -1
        for k, part in enumerate(parts[:-2]):
            begin = part.find("eyJ")
            if k > done and begin >= 0 and len(part) - begin >= 11 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) >= 11 and len(parts[k + 2]) >= 8:
                found.append((at + begin, at + len(part) + len(parts[k + 1]) + len(parts[k + 2]) + 2))
                done = k + 2
            at += len(part) + 1
    return found


BASE_KINDS = ("assign", "access", "hex")
RULES = (Rule("assign", 1, find_assign), Rule("access", 1, find_access), Rule("hex", 1, find_hex), Rule("pem", 1, find_pem), Rule("jwt", 1, find_jwt))


def blob_id(text: Column) -> Column:
    """The content address; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per blob: all rule versions that have scanned it, and all findings."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LEDGER)
    return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))


def unseen(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, rules) of the blobs of ``docs`` with the rule versions that have not scanned them, as a rule one row a blob.

    Only blob ids, counts and doc_ids are shuffled. A text stays where it is read if the blobs that differ from the common case (new, and without copies), or else
    those to be scanned, are BROADCAST_BLOBS at most; beyond both, texts are joined by a shuffle. Of copies the one with the smallest doc_id is
    scanned; copies that share it as well are scanned each, and their equal findings count once.
    """
    spark = docs.sparkSession
    keys = F.array(*[F.lit(r.key) for r in rules])
    texts = pick(docs, "text") if "doc_id" not in docs.columns else pick(docs, "text", "doc_id")
    rows = texts.select(F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") if "doc_id" in texts.columns else F.lit(None).cast("long")).alias("doc_id")).withColumn("blob", blob_id(F.col("text")))
    copies = rows.groupBy("blob").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
    known = read_ledger(spark, ledger).select("blob", F.col("rules").alias("seen"))
    missing = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")
    judged = stash(copies.join(known, "blob", "left").select("blob", "n", "keeper", missing), "blobs")
    special, wanted = (F.size("rules") < len(rules)) | (F.col("n") > 1), F.size("rules") > 0
    sizes = judged.agg(F.count_if(special).alias("special"), F.count_if(wanted).alias("wanted")).first()
    if sizes["special"] <= BROADCAST_BLOBS:
        joined = rows.join(F.broadcast(judged.filter(special)), "blob", "left").withColumn("rules", F.coalesce("rules", keys)).filter(wanted)
    else:
        side = judged.filter(wanted)
        joined = rows.join(F.broadcast(side) if sizes["wanted"] <= BROADCAST_BLOBS else side, "blob")
    return joined.filter(F.coalesce(F.col("n") == 1, F.lit(True)) | F.col("keeper").eqNullSafe(F.col("doc_id"))).select("blob", "text", "rules")


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the unseen pairs of blob and rule version among the rows of ``docs`` (text, maybe doc_id); appends them to the ledger."""
    todo = unseen(docs, ledger, rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = {r.key: r for r in rules}
        span = pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in chunks(batches, "text"):
            found = [
                [{"rule": key, "start": a, "end": b} for key in wanted for a, b in by_key[key].find(text)]
                for text, wanted in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, type=pa.list_(span))], names=["blob", "rules", "findings"])

    todo.mapInArrow(scan, LEDGER).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs where these rule versions found something.

    spans: structs (start, ord, end, kind), by start, then by the order of the rules.
    """
    keys = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = F.filter("findings", lambda x: x["rule"].isin([r.key for r in rules]))

    def span(x: Column) -> Column:
        order = F.try_element_at(keys, x["rule"])
        return F.struct(x["start"].alias("start"), order.alias("ord"), x["end"].alias("end"), F.get(kinds, order).alias("kind"))

    return read_ledger(spark, ledger).select("blob", F.array_sort(F.transform(current, span)).alias("spans")).filter(F.size("spans") > 0)


def small_or_stored(found: DataFrame) -> DataFrame:
    """``findings`` as a written table, to be broadcast only if its counts are within the stated bounds.

    Beyond them it stays a plain side of a shuffled join, whose hot blobs adaptive execution can split.
    """
    found = stash(found, "findings")
    size = found.agg(F.count("*").alias("blobs"), F.sum(F.size("spans")).alias("spans")).first()
    small = size["blobs"] <= BROADCAST_BLOBS and (size["spans"] or 0) <= BROADCAST_SPANS
    return F.broadcast(found) if small else found


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan_documents(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The secrets of every row of ``docs`` (doc_id, text): doc_id, blob, spans (never null).

    Without ``ledger`` a new one is begun in the shared folder. A null text counts as empty. Every
    row gets a result: repeated rows repeat, a null doc_id stays null. Copies of a text share
    one scan. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ledger = ledger or fresh_path(spark, "secret-ledger")
    update_ledger(docs, ledger, rules)
    found = small_or_stored(findings(spark, ledger, rules))
    paths = pick(docs, "doc_id", "text").select("doc_id", blob_id(F.col("text")).alias("blob"))
    none = F.array().cast(found.schema["spans"].dataType)
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def _covered(text: str, starts: list[int], ends: list[int], kinds: list[str]) -> str:
    out, at = [], 0
    for a, b, kind in zip(starts, ends, kinds, strict=True):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in its text replaced by ``[kind]``; all rows and columns stay.

    ``n_chars``, if there is such a column, follows the new length of a changed text. Of overlapping spans the
    first one's kind is shown. A null text stays null, repeated rows repeat, whatever their doc_id; an empty table gives
    no rows. Only texts with findings go through Python.
    """
    spark = docs.sparkSession
    ledger = ledger or fresh_path(spark, "secret-ledger")
    update_ledger(docs, ledger, rules)
    found = small_or_stored(findings(spark, ledger, rules))
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = F.col(f"c{columns.index('text')}")

    def cover(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, own in zip(texts, spans, strict=True):
            x, own = x.as_py(), own.as_py()
            out.append(x if x is None or not own else _covered(x, *([s[k] for s in own] for k in ("start", "end", "kind"))))
        return pa.array(out, pa.string())

    joined = plain.withColumn("blob", blob_id(text)).join(found, "blob", "left")
    hit = F.arrow_udf(cover, "string")(F.when(F.col("spans").isNotNull(), text), F.col("spans"))
    joined = joined.withColumn("clean", hit)
    out = []
    for i, name in enumerate(columns):
        column = F.col(f"c{i}")
        if name == "text":
            column = F.coalesce("clean", column)
        elif name == "n_chars":
            column = F.when(F.col("clean").isNull(), column).otherwise(F.length("clean")).cast(docs.schema[i].dataType)
        out.append(column.alias(name))
    return joined.select(*out)
