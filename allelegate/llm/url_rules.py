"""URL filters: given rules first, then mined association rules, in DataFrame functions only.

1. A given rule names a host and a path: it fits its host and all subdomains if the url's path starts with the
   rule's path.  The longest fitting rule judges the url.
2. The judged urls are the labels of the rest.  Spark's FP-growth mines the combinations of url tokens that come
   with a verdict; rules below MIN_SUPPORT (a share), MIN_URLS or MIN_CONFIDENCE go.
3. Other urls take the verdict of the mined rule with the highest confidence (then support, then the longer one)
   among those whose tokens they have all, and `default` without one.  An inverted index from each rule's rarest
   token to the rule finds them; different token sets are matched, not urls, so a hot host costs a row or two.

Nulls and odd rows: a url that is null or without :// has host and path '', no rule and the verdict `default`.
Repeated urls each give a row.  Without judged urls nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT, MIN_CONFIDENCE, MIN_URLS = 0.002, 0.9, 5
ALLOW, BLOCK = "allow", "block"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rules = list[tuple[str, str, str]]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(rules: Rules, host: Column, path: Column) -> Column:
    """The longest (verdict, host, path) that fits, as a struct of rule and verdict; null without one.

    `rules` is a short list written by hand; the host is compared as it is.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Different tokens of a url, sorted: host words, path words without numbers, names in the query."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    of = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(kind), w))
    parts = F.concat(
        of("host ", F.split(host, r"[.\-]")),
        of("path ", F.split(F.translate(path, CAPITALS, SMALL), r"[/.\-_]")),
        of("query ", F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1))),
    )
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t.rlike(r"^\w+ .*[^0-9 ]"))))


def mined(judged: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support, anchor) from rows of (_tokens, _verdict)."""
    empty = "antecedent array<string>, verdict string, confidence double, support double, anchor string"
    n = judged.count()
    if not n:
        return judged.sparkSession.createDataFrame([], empty)
    baskets = judged.select(F.concat("_tokens", F.array(F.concat(F.lit("verdict "), "_verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, MIN_URLS / n)), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.select(
        "antecedent", F.element_at("consequent", 1).alias("verdict"), "confidence", "support"
    ).where(F.col("verdict").startswith("verdict ") & ~F.exists("antecedent", lambda t: t.startswith("verdict ")))
    rules = rules.withColumn("verdict", F.substring_index("verdict", " ", -1))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = (
        rules.select("antecedent", F.explode("antecedent").alias("token"))
        .join(single, "token")
        .groupBy("antecedent")
        .agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    )
    return rules.join(rarest, "antecedent")


def judged(urls: DataFrame, rules: Rules, default: str = ALLOW, id: str = "page_id", url: str = "url", support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, mined_confidence) of every row."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = urls.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(tokens(F.col(url), host, path), F.array().cast("array<string>")).alias("_tokens"))
    rows = rows.withColumn("_given", given_rule(rules, F.col("host"), F.col("path")))
    labelled = rows.where("_given is not null").select("_tokens", F.col("_given.verdict").alias("_verdict"))
    index = mined(labelled, support, confidence)
    sets = rows.where("_given is null").select("_tokens").distinct()
    hits = (
        sets.select("_tokens", F.explode("_tokens").alias("anchor"))
        .join(index, "anchor")
        .where(F.size(F.array_except("antecedent", "_tokens")) == 0)
        .groupBy("_tokens")
        .agg(F.max_by(F.struct("verdict", "confidence", "antecedent"), F.struct("confidence", "support", F.size("antecedent"), "verdict", "antecedent")).alias("_mined"))
    )
    return rows.join(hits, "_tokens", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_given.rule").alias("rule"),
        F.when(F.col("_given").isNotNull(), F.col("_given.verdict")).otherwise(F.coalesce("_mined.verdict", F.lit(default))).alias("verdict"),
        F.when(F.col("_given").isNull(), F.array_join("_mined.antecedent", " + ")).alias("mined_rule"),
        F.when(F.col("_given").isNull(), F.col("_mined.confidence")).alias("mined_confidence"),
    )
