"""URL filter: rules first, else gradient-boosted trees on lexical features; all in DataFrame functions.

The trees learn from labelled URLs: length, depth, digit ratio, entropy, parameter counts, and for the host's
suffix how often its labelled URLs are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestkit.llm.common import pick, stash, uneven_join

#: At most about this many labelled URLs, taken by a hash of the URL, fit the trees.
FIT_ROWS = 20_000
ROUNDS, DEPTH, SEED = 20, 4, 5
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "parameter_length", "host_labels", "suffix_share", "suffix_weight")


@dataclass(frozen=True)
class Rule:
    """host/path: fits the host and its subdomains where the URL's path starts with the rule's."""

    text: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        at, _, rest = self.text.partition("/")
        return ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)


RULES = (Rule("org/", True), Rule("example.org/es/", False), Rule("example.org/en/1", False), Rule("com/fr/", True), Rule("com/de/", False))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule text, allow) of the longest rule that fits, else null; of equally long ones a block wins."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.text), not r.allow, r.text)):
        fits = rule.fits(host, path)
        text, allow = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.allow).otherwise(allow)
    return text, allow


def _entropy(text: Column) -> Column:
    """Bits a character, over the distinct characters of the text."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    letters = F.array_distinct(F.split(text, ""))
    summed = F.aggregate(letters, F.lit(0.0), lambda total, c: total - F.when(c != "", share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(F.length(text) > 0, summed).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """Adds host, path, suffix and the lexical features to rows with a ``url``; null counts as empty."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    with_parts = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return with_parts.select(
        "*",
        F.substring_index("host", ".", -1).alias("suffix"),
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        (digits / F.greatest(F.length(url), F.lit(1))).alias("digit_ratio"),
        _entropy(url).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("parameter_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
    )


@dataclass(frozen=True)
class Model:
    """Fitted trees, the suffix statistics of all labelled rows (a table), or a constant verdict."""

    trees: PipelineModel | None
    suffixes: DataFrame | None
    constant: bool = True

    def allow(self, featured: DataFrame) -> DataFrame:
        """Adds ``learned``, a boolean, to rows with the lexical features."""
        if self.trees is None:
            return featured.withColumn("learned", F.lit(self.constant))
        return self.trees.transform(_with_suffixes(featured, self.suffixes)).withColumn("learned", F.col("prediction") == 1.0)


def _with_suffixes(featured: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds a suffix's statistics; unknown ones are even. Beyond FIT_ROWS suffixes the frequent ones are broadcast apart from the others."""
    if suffixes.count() <= FIT_ROWS:
        joined = featured.join(F.broadcast(suffixes), "suffix", "left")
    else:
        counts = featured.groupBy("suffix").agg(F.count("*").alias("n"))
        joined = uneven_join(featured, suffixes, "suffix", counts, featured.count())
    share, weight = _statistics(F.coalesce("suffix_allowed", F.lit(0)), F.coalesce("suffix_rows", F.lit(0)))
    return joined.withColumns({"suffix_share": share, "suffix_weight": weight}).drop("suffix_allowed", "suffix_rows")


def _statistics(allowed: Column, rows: Column) -> tuple[Column, Column]:
    """Share of allowed rows, drawn to a half, and weight of a suffix."""
    return (allowed + 1) / (rows + 2), F.log1p(rows.cast("double"))


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on ``labelled`` (url, allow boolean): suffix statistics on all rows, trees on at most about ``fit_rows`` distinct URLs.

    A URL that fits the trees has its suffix's statistics without its own rows, so that they do not tell its label. Rows with a null url or label are
    left out; of a URL with both labels the block counts for the trees. With one class only, or none, the verdict is that class, else allow.
    """
    rows = pick(labelled, "url", "allow").dropna()
    share = min(1.0, fit_rows / max(1, rows.agg(F.approx_count_distinct("url")).first()[0]))
    part = rows.filter(F.pmod(F.xxhash64("url", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20)))  # sampled before anything is shuffled
    allowed = F.sum(F.col("allow").cast("long"))
    own = part.groupBy("url").agg(F.min("allow").alias("allow"), allowed.alias("own_allowed"), F.count("*").alias("own_rows"))
    sample = stash(lexical(own), "url-features")
    classes = [r["allow"] for r in sample.select("allow").distinct().collect()]
    if len(classes) < 2:
        return Model(None, None, classes[0] if classes else True)
    suffixes = rows.select(F.substring_index(host_of(F.col("url")), ".", -1).alias("suffix"), "allow").groupBy("suffix").agg(allowed.alias("suffix_allowed"), F.count("*").alias("suffix_rows"))
    suffixes = stash(suffixes, "url-suffixes")
    without = _statistics(F.col("suffix_allowed") - F.col("own_allowed"), F.col("suffix_rows") - F.col("own_rows"))
    needed = suffixes.join(F.broadcast(sample.select("suffix").distinct()), "suffix", "left_semi")  # as many as the sample has at most
    table = sample.join(F.broadcast(needed), "suffix").withColumns(dict(zip(("suffix_share", "suffix_weight"), without, strict=True))).withColumn("label", F.col("allow").cast("double"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(assembler.transform(table.coalesce(4)))
    return Model(PipelineModel([assembler, trees]), suffixes)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every row of ``pages`` (page_id, url).

    Without ``model`` the trees learn from the URLs that the rules decide. A null url or one without ``://`` has an empty
    host and path, fits no rule and is judged by the trees. Repeated rows repeat, a null page_id stays null. An
    empty table gives no rows. Extra columns are ignored.
    """
    rows = pick(pages, "page_id", "url")
    rule, allow = judged(F.col("host"), F.col("path"), rules)
    if model is None:
        decided = rows.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("url", allow.alias("allow"))
        model = train(decided)
    learned = model.allow(lexical(rows))
    return learned.select("page_id", "host", "path", rule.alias("rule"), F.when(F.coalesce(allow, "learned"), "allow").otherwise("block").alias("verdict"))
