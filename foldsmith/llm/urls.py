"""URL filtering: rules first, then gradient-boosted trees on lexical features. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.llm._sample import bounded_sample
from foldsmith.session import materialize

#: (verdict, host, path): the rules of the production query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Labelled URLs that the trees are trained on at most; suffixes whose statistics are broadcast at most.
SAMPLE, SUFFIXES = 20_000, 100_000
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_host_labels", "f_suffix_n", "f_suffix_rate"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or one without '://'."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls; equally long rules go by their text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL's characters."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    without = lambda c: n - F.length(F.replace(url, c, F.lit("")))
    share = lambda c: without(c) / n
    chars = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    return {
        "f_length": n,
        "f_depth": F.size(F.split(path, "/")).cast("double"),
        "f_digits": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n,
        "f_entropy": F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log(share(c))),
        "f_params": (F.size(F.split(url, "[?&]")) - 1).cast("double"),
        "f_host_labels": F.size(F.split(host, r"\.")).cast("double"),
    }


def with_suffix_statistics(base: DataFrame, limit: int = SUFFIXES) -> DataFrame:
    """base (host, _label and others) with f_suffix_n and f_suffix_rate: log(1 + count) and share of blocked among the
    labelled rows of the host's last label, (n + 1) / (m + 2).

    Up to `limit` suffixes are broadcast. Beyond it the frequent ones are, each at least 1 / limit of the labelled
    rows and so no more than `limit`, and all other rows meet their suffix in a shuffle.
    """
    base = base.withColumn("_suffix", F.substring_index("host", ".", -1))
    stats = base.where("_label IS NOT NULL").groupBy("_suffix").agg(F.count("*").alias("_n"), F.count_if(F.col("_label") == "block").alias("_bad"))
    stats = materialize(stats, "url-suffixes")
    size = stats.agg(F.count("*"), F.sum("_n")).first()
    values = stats.select("_suffix", F.log1p("_n").alias("f_suffix_n"), ((F.col("_bad") + 1) / (F.col("_n") + 2)).alias("f_suffix_rate"))
    if size[0] <= limit:
        known = base.join(F.broadcast(values), "_suffix", "left")
    else:
        often = stats.where(F.col("_n") >= size[1] / limit).select("_suffix")
        frequent = base.join(F.broadcast(often), "_suffix", "left_semi").join(F.broadcast(values.join(often, "_suffix")), "_suffix")
        known = frequent.unionByName(base.join(F.broadcast(often), "_suffix", "left_anti").join(values, "_suffix", "left"))
    return known.fillna({"f_suffix_n": 0.0, "f_suffix_rate": 0.5})


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; other columns are left out.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. URLs that a rule
    fits are the labelled ones: a sample of SAMPLE of them trains the trees, which judge all others. Null and empty URLs, and
    those without '://', have an empty host and path and go to the trees too. Repeated rows and null ids
    keep a row each, an empty table gives none. With labels of one kind only that is the verdict; with none, `allow`.
    """
    host, path = host_and_path(F.col(url))
    base = pages.select(F.col(page_id), F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("_label"))
    known = with_suffix_statistics(base)
    full = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known.select("*", *(c.alias(k) for k, c in lexical(F.col("_url"), F.col("host"), F.col("path")).items())))
    labelled = full.where("_label IS NOT NULL").select(page_id, "_url", "features", (F.col("_label") == "block").cast("double").alias("label"))
    sample = materialize(bounded_sample(labelled, [page_id, "_url"], SAMPLE).select("features", "label"), "url-sample")
    kinds = [r.label for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        only = "block" if kinds == [1.0] else "allow"
        return base.select(page_id, "host", "path", "rule", F.coalesce("_label", F.lit(only)).alias("verdict"))
    model = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.3, seed=7, cacheNodeIds=False).fit(sample)
    own = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return model.transform(full).select(page_id, "host", "path", "rule", F.coalesce("_label", own).alias("verdict"))
