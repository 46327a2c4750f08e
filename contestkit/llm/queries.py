"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestkit.llm import archives, decontaminate, html, langid, neighbours, packing, periods, quality, secrets, simhash, toxicity, urls, whitening
from contestkit.llm.common import pick


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, of: int, part: int) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == part, F.lit(False))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out("doc_id", 3, 1))
    scored = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), toxicity.toxicity(model)(F.col("text")).alias("t"))
    score = F.col("t.score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.col("t.passages").alias("passages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document."""
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE_KINDS))

    def n(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(n, secrets.BASE_KINDS), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url", "html").select("page_id", "url", html.main_text()(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every row whose id is divisible by 100."""
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out("doc_id", 5, 0)))
    found = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), langid.language(model)(F.col("text")).alias("t"))
    return found.select("doc_id", "held_out", F.col("t.lang").alias("lang_pred"), F.col("t.score").alias("score"), F.array_sort(F.map_entries("t.mixture")).alias("mixture"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document and whether it is sampled."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps of documents and benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which repeat a unit to the end."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = docs.select("doc_id", periods.periodic_runs()(periods.planted(F.col("text"), F.col("doc_id"))).alias("t"))
    found = found.select("doc_id", "t.runs", "t.kept", periods.strongest(F.col("t.runs")).alias("top"))
    exponent = F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("long")
    digests = F.sha2(periods.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", exponent.alias("exponent_milli"), *digests)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.by_component(*whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of every page in WARC archives that are converted from ARC archives and read back."""
    return archives.archived_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_toxic_segments, op3_secret_scan, op4_html_extraction, op5_nearest_neighbours, op6_language_mixture, op7_importance_resampling, op8_simhash_near_dedup, op9_benchmark_decontamination, op10_best_fit_packing, op11_periodic_runs, op12_embedding_whitening, op13_warc)}
ORACLES: dict[str, str] = {"op9_benchmark_decontamination": decontaminate.oracle(), "op11_periodic_runs": periods.oracle(), "op13_warc": archives.oracle()}
