"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest.

The trees are learnt from labelled URLs, given ones and those that a rule speaks of, and judge the others. They are fitted on at most
``FIT_ROWS`` labelled URLs, picked by hash; counts of suffixes are those of all URLs with a host, their block rates
those of all labelled URLs, and every URL is judged. A labelled URL sees the rate without the labels of its own fold,
so that the rate tells the trees no more of it than of a new URL.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; equal URLs get equal
verdicts; with labels of a single kind the others get that label (allow if there is none), and a sample of a single
kind gives all URLs the block rate of the labelled ones; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliogrid.llm.common import ascii_lower, materialize, table

# Rules of the given policy, host and path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Labelled URLs that the trees are fitted on, at most.
FIT_ROWS = 20_000
#: Bytes of suffix statistics up to which they are broadcast, and the part of all URLs from which a suffix is frequent.
BROADCAST_BYTES = 8 << 20
FREQUENT = 1 / 2000
#: Parts of the labelled URLs of which each is left out of the block rates that its own URLs see.
FOLDS = 5
FEATURES = ("n_chars", "host_chars", "path_chars", "n_labels", "depth", "digit_ratio", "host_digit_ratio", "entropy", "n_params", "n_hyphens", "is_https", "has_www", "suffix_log_count", "suffix_block_rate")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def fits(rule: str, host: Column, path: Column) -> Column:
    """A rule fits its host and all subdomains where the path starts with the rule's."""
    at = rule.index("/")
    return ((host == rule[:at]) | host.endswith(f".{rule[:at]}")) & path.startswith(rule[at:])


def longest_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null where none fits. For curated lists of some dozen rules."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, verdict = F.when(fits(rule, host, path), rule).otherwise(name), F.when(fits(rule, host, path), what).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    n = F.char_length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))).cast("double"))
    total = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a + c * F.log2(c))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    """The last label of a host, null without a host."""
    return F.when(host != "", F.substring_index(host, ".", -1))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features that one URL has by itself, and its suffix."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    share = lambda c: F.coalesce(count(c, "[0-9]") / F.nullif(F.char_length(c), F.lit(0)), F.lit(0.0))
    return urls.select(
        "*", F.char_length(url).cast("double").alias("n_chars"), F.char_length(host).cast("double").alias("host_chars"), F.char_length(path).cast("double").alias("path_chars"),
        count(host, r"[^.]+").alias("n_labels"), count(path, r"/[^/]").alias("depth"), share(url).alias("digit_ratio"), share(host).alias("host_digit_ratio"), entropy(url).alias("entropy"),
        count(url, r"[?&][^=&#]+=").alias("n_params"), count(host, "-").alias("n_hyphens"), url.startswith("https").cast("double").alias("is_https"), host.startswith("www.").cast("double").alias("has_www"),
        suffix_of(host).alias("suffix"),
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def suffix_statistics(hosted: DataFrame) -> DataFrame:
    """``suffix, n, labelled, blocked`` over all URLs, and what each fold has of the last two; combined before it is shuffled."""
    by = lambda f, c: F.array(*(f(F.when(_fold() == i, c)) for i in range(FOLDS)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    label = F.col("label")
    return hosted.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), total(label).alias("blocked"), by(F.count, label).alias("labelled_by"), by(total, label).alias("blocked_by"))


def with_suffix_statistics(urls: DataFrame, stats: DataFrame, prior: float, total: int, small: bool) -> DataFrame:
    """Adds the statistics of each URL's suffix. Those that are not small are shuffled, but for frequent suffixes, which are few."""
    of = stats.select("suffix", F.log1p(F.col("n").cast("double")).alias("suffix_log_count"), "labelled", "blocked", "labelled_by", "blocked_by", "n")
    if small:
        known = urls.join(F.broadcast(of.drop("n")), "suffix", "left")
    else:
        often = of.filter(F.col("n") >= total * FREQUENT).drop("n")
        seldom = of.filter(F.col("n") < total * FREQUENT).drop("n")
        # URLs without a host have no statistics and are not gathered either
        rest = urls.filter("suffix IS NOT NULL").join(F.broadcast(often.select("suffix")), "suffix", "left_anti").join(seldom.hint("merge"), "suffix")
        known = urls.join(F.broadcast(often), "suffix").unionByName(rest).unionByName(urls.filter("suffix IS NULL"), allowMissingColumns=True)
    other = lambda c: F.col(c) - F.when(F.col("label").isNotNull(), F.get(f"{c}_by", _fold())).otherwise(0)
    known = known.withColumn("suffix_block_rate", (other("blocked") + 10 * prior) / (other("labelled") + 10))
    return known.fillna({"suffix_log_count": 0.0, "suffix_block_rate": prior})


def judge_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, fit_rows: int = FIT_ROWS, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per URL: ``id_col, host, path, rule, verdict, block_probability``.

    ``labels(url, block)`` are labelled URLs beside those of the rules, which come first; of several labels block counts.
    """
    host, path = parsed(F.col("url"))
    urls = pages.select(F.col(id_col), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    ruled = urls.withColumns({"rule": name, "ruled": verdict}).withColumn("label", (F.col("ruled") == "block").cast("double"))
    if labels is not None:
        given = labels.groupBy("url").agg(F.max("block").cast("double").alias("given"))
        ruled = ruled.join(given, "url", "left").withColumn("label", F.coalesce("label", "given")).drop("given")
    hosted = ruled.filter("host <> ''")
    stats = materialize(suffix_statistics(hosted), "url-suffixes")
    total, labelled, blocked, held = stats.agg(F.sum("n"), F.sum("labelled"), F.sum("blocked"), F.sum(F.octet_length("suffix") + 48 + 16 * FOLDS)).first()
    # bounded by fit_rows: the sample and the model
    sample = materialize(lexical(hosted.filter("label IS NOT NULL").orderBy(F.xxhash64("url", id_col)).limit(fit_rows)), "url-sample")
    prior = blocked / labelled if labelled else 0.0
    if sample.select("label").distinct().count() < 2:
        judged = ruled.withColumn("block_probability", F.lit(prior))
    else:

        def whole(df: DataFrame) -> DataFrame:
            known = with_suffix_statistics(df, stats, prior, total, held <= broadcast_bytes)
            return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)

        model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, featuresCol="features", labelCol="label").fit(whole(sample).select("features", "label"))
        judged = model.transform(whole(lexical(ruled))).withColumn("block_probability", vector_to_array("probability")[1])
    said = F.coalesce(F.col("ruled"), F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", "rule", said.alias("verdict"), "block_probability")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES: dict[str, str] = {}
