"""URL filters: rules by host and path, and gradient-boosted trees for the URLs that no rule decides.

The trees look at lexical features only: lengths, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffix. They are trained on the URLs that the rules label. A labelled URL
takes its suffix's share of blocked URLs from the other folds only, so that no label, its own or a
copy's, can be read off that feature; a URL without a label takes it from all labelled ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, keep, materialise, scratch, split_join

# Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "has_fragment", "secure", "suffix_log", "suffix_blocked")
#: Labelled URLs that training reads, in expectation, and the shape of the trees.
SAMPLE_URLS = 20_000
TREES, DEPTH = 10, 3
#: Labelled URLs that the prior counts as, in a suffix's share of blocked ones.
PRIOR = 20.0
#: Parts, by a hash of the URL, that labels are kept apart in.
FOLDS = 5


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct (verdict, rule); null if none does.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    known = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    fits = F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.array_max(fits)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.length(url)
    # Per distinct character its share p, as -p * log2(p).
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / F.greatest(size, F.lit(1)))
    entropy = F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": size,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(size, F.lit(1)),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "secure": url.startswith("https").cast("int"),
    }


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def featured_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, url, host, path, suffix, rule, ruled (the rule's verdict), label, fold and the lexical features."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parsed = pages.select("page_id", url.alias("url")).withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    ruled = parsed.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("suffix", suffix(F.col("host")))
    label = F.when(F.col("match.verdict") == "block", 1.0).when(F.col("match.verdict") == "allow", 0.0)
    lexical = [c.cast("double").alias(n) for n, c in lexical_features(F.col("url"), F.col("host"), F.col("path")).items()]
    return ruled.select("page_id", "url", "host", "path", "suffix", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("ruled"), label.alias("label"), fold_of(F.col("url")).alias("fold"), *lexical)


def with_suffix_statistics(featured: DataFrame, labelled: Column) -> DataFrame:
    """Adds suffix_log and suffix_blocked to materialised rows: how many URLs the suffix has, and their blocked share.

    Only labels of rows where ``labelled`` holds count; such a row gets the share without its own fold.
    """
    known = F.when(labelled, F.col("label"))
    by_fold = featured.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("urls"), F.count(known).alias("labelled"), F.coalesce(F.sum(known), F.lit(0.0)).alias("blocked"))
    # One row per suffix: its folds are in a map, so nothing but the suffix is joined on.
    folds = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("labelled", "blocked"))))
    stats = by_fold.groupBy("suffix").agg(F.sum("urls").alias("n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), folds.alias("folds"))
    stats = materialise(stats, "url-suffixes")
    total = stats.agg(F.sum("all_labelled"), F.sum("all_blocked")).first()
    prior = (total[1] or 0.0) / max(total[0] or 0, 1)
    joined = split_join(featured, stats, ["suffix"], "url", hot_keys(stats.select("suffix", "n"), ["suffix"]))
    own = F.when(labelled & F.col("label").isNotNull(), F.col("folds")[F.col("fold")])
    blocked = F.col("all_blocked") - F.coalesce(own["blocked"], F.lit(0.0))
    counted = F.col("all_labelled") - F.coalesce(own["labelled"], F.lit(0))
    share = (blocked + PRIOR * prior) / (counted + PRIOR)
    return joined.withColumn("suffix_log", F.log1p("n")).withColumn("suffix_blocked", share).drop("n", "all_labelled", "all_blocked", "folds")


def fit_trees(assembled: DataFrame, labelled: int, sample_urls: int):
    """Boosted trees learnt from about ``sample_urls`` of the rows with a label, chosen by a hash of the URL."""
    with_label = assembled.where(F.col("label").isNotNull())
    chosen = F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(min(1.0, sample_urls / max(labelled, 1)) * (1 << 20))
    sample = materialise(with_label.where(chosen).select("features", "label"), "url-sample")
    if sample.select("label").distinct().count() < 2:  # one verdict is too rare for the sample: as many of each
        counts = {r["label"]: r["n"] for r in with_label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        share = F.when(F.col("label") == 1.0, sample_urls / counts[1.0]).otherwise(sample_urls / counts[0.0])
        chosen = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < F.least(share, F.lit(1.0)) * (1 << 30)
        sample = materialise(with_label.where(chosen).select("features", "label"), "url-sample")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label").fit(sample)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, sample_urls: int = SAMPLE_URLS) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict, block_score (null where a rule decides).

    A null URL, or one without ``://``, has empty host and path; every URL gets a verdict. Where the
    rules label nothing, or everything alike, that verdict, or allow, goes to the rest. Repeated rows
    are judged alike; columns other than page_id and url take no part; an empty table gives an empty result.
    """
    featured = materialise(featured_urls(pages, rules), "urls")
    total = featured.agg(F.count("label").alias("labelled"), F.sum("label").alias("blocked")).first()
    labelled, blocked = total["labelled"], total["blocked"] or 0.0
    if not 0 < blocked < labelled:
        only = F.lit("block" if labelled and blocked else "allow")
        return featured.select("page_id", "host", "path", "rule", F.coalesce("ruled", only).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    with scratch(pages.sparkSession):
        assembled = _assembled(with_suffix_statistics(featured, F.lit(True)))
        scored = fit_trees(assembled, labelled, sample_urls).transform(assembled).withColumn("p", vector_to_array("probability")[1])
        method = F.when(F.col("p") >= 0.5, "block").otherwise("allow")
        judged = scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.when(F.col("rule").isNull(), F.col("p")).alias("block_score"))
        return keep(judged, "url-verdicts")


def held_out_quality(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, sample_urls: int = SAMPLE_URLS) -> DataFrame:
    """One row on the labelled URLs of fold 0, judged by trees and statistics of the other folds' labels: urls, blocked, agree, missed (blocked, judged allow), spoiled (allowed, judged block)."""
    spark = pages.sparkSession
    with scratch(spark):
        featured = materialise(featured_urls(pages, rules), "urls")
        taught = F.col("fold") > 0
        assembled = _assembled(with_suffix_statistics(featured, taught))
        train = assembled.where(taught)
        held = assembled.where(~taught & F.col("label").isNotNull())
        judged = fit_trees(train, train.where(F.col("label").isNotNull()).count(), sample_urls).transform(held)
        same = F.col("prediction") == F.col("label")
        counts = (F.count(F.lit(1)).alias("urls"), F.count_if(F.col("label") == 1.0).alias("blocked"), F.count_if(same).alias("agree"), F.count_if(~same & (F.col("label") == 1.0)).alias("missed"), F.count_if(~same & (F.col("label") == 0.0)).alias("spoiled"))
        return keep(judged.agg(*counts), "url-quality")
