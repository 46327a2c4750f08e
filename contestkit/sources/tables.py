"""Sources and sinks of flat data (SRC-01 to SRC-09, SRC-11 to SRC-13, SNK-01 to SNK-07, HSH-05)."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestkit.functions.parse import any_date, clock_seconds, fight_minutes, landed_of_attempted, round_lengths
from contestkit.functions.text import bout_sides, canonical_column, canonical_payload, display_name, name_key, pair_key, weight_class
from contestkit.operators.history import keep_first
from contestkit.sources.versioned import Store, digest, write

#: field -> accepted spellings, best first, in canonical form (lower case, no spaces or underscores). Fixed values.
SPELLINGS = {
    "date": ("date", "eventdate", "fightdate"),
    "event": ("event", "eventname"),
    "fighter_a": ("redfighter", "rfighter", "fightera", "fighterred", "redcorner", "fighter1"),
    "fighter_b": ("bluefighter", "bfighter", "fighterb", "fighterblue", "bluecorner", "fighter2"),
    "winner": ("winner", "winnername", "resultwinner", "result"),
    "weight_class": ("weightclass", "division"),
    "method": ("method", "finish", "winby", "finishdetailsmethod", "victorymethod"),
    "round": ("round", "finishround", "lastround", "totalroundsfought"),
    "winner_fighter": ("winnerfighter", "winnername", "winnerfullname"),
    "loser_fighter": ("loserfighter", "loser", "losername"),
    "age_a": ("redage", "rage", "fighteraage"),
    "age_b": ("blueage", "bage", "fighterbage"),
    "height_a": ("redheightcms", "rheightcms", "redheight", "fighteraheight"),
    "height_b": ("blueheightcms", "bheightcms", "blueheight", "fighterbheight"),
    "reach_a": ("redreachcms", "rreachcms", "redreach", "fighterareach"),
    "reach_b": ("bluereachcms", "breachcms", "bluereach", "fighterbreach"),
}
PHYSICAL = ("age_a", "age_b", "height_a", "height_b", "reach_a", "reach_b")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; types are cast where they are used."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def mapping(columns: list[str], spellings: dict[str, tuple[str, ...]] = SPELLINGS) -> dict[str, str]:
    """field -> raw column: the first spelling that is there; no data is read (SRC-02)."""
    there = {canonical_column(c): c for c in reversed(columns)}
    return {field: there[s] for field, names in spellings.items() if (s := next((n for n in names if n in there), None))}


def with_row_id(raw: DataFrame) -> DataFrame:
    """source_row_id from 0: the position in the files, per partition and then counted on.

    Positions come from two passes, counts per partition and a prefix sum of those, so no task holds all rows.
    """
    placed = raw.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    return placed.join(F.broadcast(before), "part").withColumn("source_row_id", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def _need(found: dict[str, str], fields: tuple[str, ...]) -> None:
    if missing := [f for f in fields if f not in found]:
        raise ValueError(f"no column for {missing}")


def corners(raw: DataFrame) -> DataFrame:
    """Red and blue corners; the winner is a corner label or a name (SRC-04). raw has source_row_id."""
    found = mapping([c for c in raw.columns if c != "source_row_id"])
    _need(found, ("date", "fighter_a", "fighter_b", "winner"))
    col = lambda f: F.col(f"`{found[f]}`") if f in found else F.lit(None).cast("string")
    side = F.lower(F.trim(col("winner")))
    winner = F.when(side == "red", display_name(col("fighter_a"))).when(side == "blue", display_name(col("fighter_b"))).otherwise(display_name(col("winner")))
    return raw.select("source_row_id", col("date").alias("date"), col("event").alias("event"), display_name(col("fighter_a")).alias("fighter_a"), display_name(col("fighter_b")).alias("fighter_b"), winner.alias("winner"), col("weight_class").alias("weight_class"), col("method").alias("method"), col("round").alias("round"), *[col(f).try_cast("double").alias(f) for f in PHYSICAL])


def winners(raw: DataFrame) -> DataFrame:
    """Winner and loser columns: the winner is A on even rows and B on odd ones, so labels balance (SRC-05)."""
    found = mapping([c for c in raw.columns if c != "source_row_id"])
    _need(found, ("date", "winner_fighter", "loser_fighter"))
    col = lambda f: F.col(f"`{found[f]}`") if f in found else F.lit(None).cast("string")
    w, x = display_name(col("winner_fighter")), display_name(col("loser_fighter"))
    even = F.col("source_row_id") % 2 == 0
    return raw.select("source_row_id", col("date").alias("date"), col("event").alias("event"), F.when(even, w).otherwise(x).alias("fighter_a"), F.when(even, x).otherwise(w).alias("fighter_b"), w.alias("winner"), col("weight_class").alias("weight_class"), col("method").alias("method"), col("round").alias("round"), *[F.lit(None).cast("double").alias(f) for f in PHYSICAL])


#: Name -> function of a raw DataFrame (SRC-03, SRC-06).
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"corners": corners, "winners": winners, "converted": corners}


def adapter(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in ADAPTERS:
        raise ValueError(f"unknown source {name!r}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[name]


def convert_results(results: DataFrame, events: DataFrame) -> DataFrame:
    """Scraped results with their event's day (SRC-07): W/L is red, L/W blue, others undecided."""
    day = events.select(F.trim("EVENT").alias("event"), any_date(F.col("DATE")).alias("date"))
    sides = bout_sides(F.col("BOUT"))
    winner = F.when(F.trim("OUTCOME") == "W/L", "Red").when(F.trim("OUTCOME") == "L/W", "Blue").otherwise("")
    rows = results.withColumn("event", F.trim("EVENT")).join(day, "event").withColumn("sides", sides).filter("sides is not null")
    return rows.select("date", "event", F.col("sides")[0].alias("red_fighter"), F.col("sides")[1].alias("blue_fighter"), winner.alias("winner"), weight_class(F.col("WEIGHTCLASS")).alias("weight_class"), F.trim("METHOD").alias("method"), F.trim("ROUND").alias("round"))


def convert_stats(stats: DataFrame, results: DataFrame, events: DataFrame) -> DataFrame:
    """Per-round rows to one wide row a bout (SRC-08). Both corners must have rows and the minutes be positive."""
    of = lambda c: landed_of_attempted(F.col(c))
    sums = stats.groupBy(F.trim("EVENT").alias("event"), F.trim("BOUT").alias("bout"), name_key(F.col("FIGHTER")).alias("key")).agg(
        F.sum(F.coalesce(F.col("KD").try_cast("double"), F.lit(0.0))).alias("kd"), F.sum(of("`SIG.STR.`")["landed"]).alias("sig_str_landed"), F.sum(of("`SIG.STR.`")["attempted"]).alias("sig_str_attempted"),
        F.sum(of("TD")["landed"]).alias("td_landed"), F.sum(of("TD")["attempted"]).alias("td_attempted"), F.sum(F.coalesce(F.col("`SUB.ATT`").try_cast("double"), F.lit(0.0))).alias("sub_att"), F.sum(clock_seconds(F.col("CTRL"))).alias("ctrl_seconds"),
    )
    day = events.select(F.trim("EVENT").alias("event"), any_date(F.col("DATE")).alias("date"))
    minutes = F.round(fight_minutes(round_lengths(F.col("`TIME FORMAT`")), F.coalesce(F.col("ROUND").try_cast("int"), F.lit(1)), F.col("TIME")), 3)
    bouts = results.select(F.trim("EVENT").alias("event"), F.trim("BOUT").alias("bout"), bout_sides(F.col("BOUT")).alias("sides"), minutes.alias("total_minutes")).filter("sides is not null and total_minutes > 0")
    names = ("kd", "sig_str_landed", "sig_str_attempted", "td_landed", "td_attempted", "sub_att", "ctrl_seconds")
    corner = lambda c: sums.select("event", "bout", F.col("key").alias(f"{c}_key"), *[F.col(n).alias(f"{c}_{n}") for n in names])
    keyed = bouts.withColumn("red_key", name_key(F.col("sides")[0])).withColumn("blue_key", name_key(F.col("sides")[1]))
    return keyed.join(day, "event").join(corner("red"), ["event", "bout", "red_key"]).join(corner("blue"), ["event", "bout", "blue_key"]).select("date", "event", F.col("sides")[0].alias("red_fighter"), F.col("sides")[1].alias("blue_fighter"), "total_minutes", *[f"{c}_{n}" for c in ("red", "blue") for n in names])


def match_stats(wide: DataFrame, fights: DataFrame) -> DataFrame:
    """Two rows a bout from wide statistics (SRC-09, JOIN-03, JOIN-04). fights: fight_id, date, a_id, b_id, a_key, b_key.

    The bout is found by day and unordered pair, the last one of equal keys; corners are swapped to its sides; of rows for
    one bout the last (row_id) counts.
    """
    last = fights.groupBy("date", pair_key(F.col("a_key"), F.col("b_key")).alias("pair")).agg(F.max_by(F.struct("fight_id", "a_id", "b_id", "a_key"), "fight_id").alias("f"))
    keyed = wide.withColumn("red_key", name_key(F.col("red_fighter"))).withColumn("pair", pair_key(F.col("red_key"), name_key(F.col("blue_fighter"))))
    joined = keyed.join(last, ["date", "pair"])
    names = ("kd", "sig_str_landed", "sig_str_attempted", "td_landed", "td_attempted", "sub_att", "ctrl_seconds")
    line = lambda corner, entity: F.struct(entity.alias("entity"), F.col("total_minutes").cast("double").alias("minutes"), *[F.col(f"{corner}_{n}").cast("double").alias(n) for n in names])
    straight = F.col("red_key") == F.col("f.a_key")
    red, blue = F.when(straight, F.col("f.a_id")).otherwise(F.col("f.b_id")), F.when(straight, F.col("f.b_id")).otherwise(F.col("f.a_id"))
    rows = joined.select("row_id", F.col("f.fight_id").alias("fight_id"), F.explode(F.array(line("red", red), line("blue", blue))).alias("r")).select("row_id", "fight_id", "r.*")
    return keep_first(rows.withColumn("back", -F.col("row_id")), ("fight_id", "entity"), ("back",)).drop("back", "row_id")


def there(spark: SparkSession, path: str, kind: str = "parquet") -> bool:
    """Whether a table of the format (Parquet, if none is named) is stored there."""
    try:
        spark.read.format(kind).load(path)
    except AnalysisException:
        return False
    return True


def append_new(rows: DataFrame, path: str, keys: tuple[str, ...], on_conflict: str = "ignore") -> int:
    """Appends the rows whose keys the Parquet table lacks; files already written never change (SNK-02, SNK-05)."""
    spark = rows.sparkSession
    once = rows.dropDuplicates(list(keys))
    stored = spark.read.parquet(path) if there(spark, path) else None
    new = once if stored is None else once.join(stored.select(*keys), list(keys), "left_anti")
    if on_conflict == "error" and stored is not None and once.join(stored.select(*keys), list(keys), "left_semi").take(1):
        raise ValueError("a key is already stored")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def read_only(spark: SparkSession, path: str) -> DataFrame:
    """A stored table's rows, with no way to write them back (SRC-12): a path that holds nothing is an error, never begun."""
    if not there(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parsed documents of JSON files, one row a file (SRC-13); a file that is no JSON is an error that names it."""
    texts = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    if bad := [r["path"] for r in texts.filter(F.try_parse_json("value").isNull()).select("path").take(3)]:
        raise ValueError(f"no JSON: {bad}")
    return texts.select("path", F.from_json("value", schema).alias("document"))


def write_documents(rows: DataFrame, path: str) -> None:
    """A file a row of the ``value`` column, all in one folder. Tasks move their files into place themselves, the driver does not move them one by one."""
    once = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
    rows.select("value").repartition(rows.sparkSession.sparkContext.defaultParallelism * 2).write.mode("errorifexists").options(**once).text(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, md5, sha256) of the files below ``path`` (HSH-05); executors read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def tree_digest(spark: SparkSession, path: str) -> str | None:
    """One digest of a folder: of its files' digests, in order, names aside; null for none."""
    each = digests(spark, path).agg(F.array_join(F.array_sort(F.collect_list("sha256")), "|").alias("all"))  # one short text a file
    return each.select(F.when(F.col("all") != "", F.sha2("all", 256)).alias("d")).first()["d"]


def outside(path: str, protected: tuple[str, ...]) -> str:
    """``path``, if it lies neither in nor above a protected folder (SNK-07)."""
    norm = lambda p: posixpath.normpath(re.sub(r"^file:/+", "/", p)) + "/"
    if clash := [p for p in protected if norm(path).startswith(norm(p)) or norm(p).startswith(norm(path))]:
        raise ValueError(f"{path} would touch protected {clash}")
    return path


def rebuild(rows: DataFrame, path: str, protected: tuple[str, ...]) -> DataFrame:
    """Writes a rebuilt table beside the official ones: never into a protected folder, never over anything (SNK-07). The rows as stored."""
    rows.write.mode("errorifexists").parquet(outside(path, protected))
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def current(spark: SparkSession, target: str) -> str | None:
    """The version that readers of ``target`` see: the newest entry of its log."""
    return _entry(spark, target)[1]


def _entry(spark: SparkSession, target: str) -> tuple[int, str | None]:
    """(number, path) of the newest entry; (-1, None) for none."""
    store = Store(spark, f"{target}/log")
    numbers = store.numbers()
    return (numbers[-1], store.note(numbers[-1])) if numbers else (-1, None)


def promote(staged: DataFrame, target: str, checks: dict[str, Column], after: Callable[[DataFrame], bool] | None = None) -> str:
    """Makes ``staged`` the current version of ``target`` (SNK-06); returns its path.

    The rows go to a version of their own; all checks must hold for all rows, and what is stored must hold as many rows with the
    same digest as were written. Only then does a log entry point readers to it; if somebody else promoted in the meantime, that is a ``Conflict`` and theirs
    stays. The version before is never touched and so is the backup: if ``after``, which sees the rows as readers do, is not true, an entry for that version is added and the error raised.
    """
    spark, target = staged.sparkSession, target.rstrip("/")
    number, before = _entry(spark, target)
    path = f"{target}/version={uuid.uuid4().hex}"
    sent = write(staged, path)
    written = spark.read.schema(staged.schema).parquet(path)
    failed = written.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in checks.items()]).first().asDict() if checks else {}
    if bad := {n: k for n, k in failed.items() if k}:
        raise ValueError(f"not promoted, {path} stays aside: {bad}")
    if digest(written) != sent:
        raise ValueError(f"not promoted, {path} differs from what was to be written")
    _point(spark, target, number + 1, path)
    if after is not None and not after(spark.read.schema(staged.schema).parquet(current(spark, target))):
        _point(spark, target, number + 2, before)
        raise ValueError(f"{path} failed after promotion; {'back to ' + before if before else 'nothing to go back to'}")
    return path


def _point(spark: SparkSession, target: str, number: int, path: str | None) -> None:
    Store(spark, f"{target}/log").put(number, path or "")


def write_report(report: dict, folder: str | Path, name: str) -> tuple[Path, Path]:
    """A report of collected figures as JSON and as Markdown (SNK-03): scalars as a list, lists of rows as tables, the rest nested."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    files = folder / f"{name}.json", folder / f"{name}.md"
    files[0].write_text(json.dumps(report, indent=2, sort_keys=True, default=str, allow_nan=False), encoding="utf-8")
    files[1].write_text("\n".join(_markdown(name, report, 1)) + "\n", encoding="utf-8")
    return files


def _markdown(title: str, part: object, level: int) -> Iterator[str]:
    yield f"{'#' * min(level, 6)} {title}\n"
    if isinstance(part, dict):
        flat = {k: v for k, v in part.items() if not isinstance(v, dict | list)}
        yield from [f"- **{k}**: {v}" for k, v in flat.items()]
        yield ""
        for k, v in part.items():
            if k not in flat:
                yield from _markdown(k, v, level + 1)
    elif part and all(isinstance(r, dict) for r in part):
        columns = list(dict.fromkeys(k for r in part for k in r))
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
        yield "| " + " | ".join(columns) + " |"
        yield "|" + "---|" * len(columns)
        yield from ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in part]
        yield ""
    else:
        yield from [f"- {v}" for v in part]
        yield ""


def archive_key(payload: Column) -> Column:
    """Content address of a JSON text (SNK-04), the same however its keys are ordered and its numbers written; of its very text if it is no JSON."""
    return F.sha2(F.coalesce(canonical_payload(payload), payload), 256)


def archive(payloads: DataFrame, path: str) -> int:
    """Content-addressed append of a ``payload`` column."""
    return append_new(payloads.withColumn("payload_hash", archive_key(F.col("payload"))), path, ("payload_hash",))


def write_csv(rows: DataFrame, path: str) -> None:
    """Null is an empty cell, a quote within one is doubled (SNK-01)."""
    rows.write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
