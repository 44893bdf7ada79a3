"""URL filters: given rules first, then association rules that FP-growth mines from URL tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules of the contract: verdict and rule (host, then path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
DEFAULT = "allow"
VERDICT = "verdict="


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. A rule fits its host and all subdomains."""
    table = F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.split("/")[0]).alias("host"), F.lit("/" + r.split("/", 1)[1]).alias("path")) for v, r in rules])

    def fits(r: Column) -> Column:
        return ((host_ == r["host"]) | host_.endswith(F.concat(F.lit("."), r["host"]))) & path_.startswith(r["path"])

    best = F.array_max(F.filter(table, fits))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """Distinct tokens of a URL: scheme, labels and ending of the host, parts of the path, names in the query; digits as #."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\d+", "#")
    parts = lambda c, by, name: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(name), x))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.lower(F.substring_index(x, "=", 1))))
    found = F.concat(F.array(F.concat(F.lit("scheme="), F.lower(scheme)), F.concat(F.lit("end="), F.substring_index(host_, ".", -1))), parts(plain(host_), r"\.", "host="), parts(plain(path_), "/", "path="), names)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(anchor, antecedent, verdict, confidence, support): token combinations that decide a verdict, from (tokens, verdict).

    FP-growth counts all rows. A rule that another with a part of its tokens equals
    or beats in confidence for the same verdict adds nothing and is pruned. The
    anchor, under which the inverted index keeps a rule, is its rarest token.
    """
    items = labelled.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0)).select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].startswith(VERDICT)).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(VERDICT) + 1, 99).alias("verdict"), "confidence", "support",
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("anchor"), "freq")
    exploded = rules.withColumn("anchor", F.explode("antecedent")).join(single, "anchor")
    rules = exploded.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "anchor"))["anchor"].alias("anchor"))
    # a shorter rule lies in the index under one of the longer one's tokens
    shorter = rules.select(F.col("anchor").alias("token"), F.col("antecedent").alias("part"), F.col("confidence").alias("reached"), F.col("verdict").alias("same"))
    longer = rules.withColumn("token", F.explode("antecedent")).join(shorter, "token").where(
        (F.size("part") < F.size("antecedent")) & (F.col("verdict") == F.col("same")) & (F.col("reached") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0)
    )
    return rules.join(longer.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti").select("anchor", "antecedent", "verdict", "confidence", "support")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined), one row per row of ``pages`` (page_id, url).

    The longest fitting rule decides. Pages that a rule decides are the labels from
    which token rules are mined; any other page gets the verdict of the matching
    mined rule with the highest confidence, then support, then most tokens, then
    by its tokens in order, and ``allow`` if none matches. ``mined`` holds its
    tokens. A null url, or one without ``://``, has empty host and path and no
    tokens. Repeated rows are returned as often. Without any labelled page nothing
    is mined.
    """
    seen = pages.select("page_id", F.col("url").alias("_url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    seen = seen.withColumn("_listed", listed(F.col("host"), F.col("path"), rules)).withColumn("_tokens", tokens(F.col("_url"), F.col("host"), F.col("path")))
    labelled = seen.select(F.col("_tokens").alias("tokens"), F.col("_listed.verdict").alias("verdict"))
    index = mined(labelled, min_support, min_confidence)
    open_urls = seen.where("_listed is null and _url is not null").select("_url", "_tokens").distinct()
    hits = open_urls.withColumn("anchor", F.explode("_tokens")).join(index, "anchor").where(F.size(F.array_except("antecedent", "_tokens")) == 0)
    rank = F.struct("confidence", "support", F.size("antecedent"), F.array_join("antecedent", " "))
    best = hits.groupBy("_url").agg(F.max_by(F.struct("verdict", F.array_join("antecedent", " ").alias("mined")), rank).alias("_mined"))
    return seen.join(best, "_url", "left").select(
        "page_id", "host", "path", F.col("_listed.rule").alias("rule"), F.coalesce("_listed.verdict", "_mined.verdict", F.lit(DEFAULT)).alias("verdict"), F.when(F.col("_listed").isNull(), F.col("_mined.mined")).alias("mined"),
    )
