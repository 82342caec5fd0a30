"""URL filtering: explicit host and path rules, then association rules.

Spark's FP-growth mines combinations of URL tokens from labelled URLs; rules
whose consequent is a verdict are kept at a support and a confidence, and one
is dropped if a rule on fewer of its tokens is as confident.  Tokens that occur
in the same labelled URLs say the same, and every subset of them would be a
combination: they are one class for FP-growth, under its first token, and a URL
with any of them has the class.  The kept rules are an inverted index from
token to rule, which each URL's classes are counted against: each rule is
listed under its rarest token, and fits when all its classes are there.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import named, written

#: Share of the labelled URLs that a combination is in at least, share of them that have the verdict, labelled URLs that a combination is in at least.
SUPPORT, CONFIDENCE, LEAST = 0.005, 0.6, 5
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments, names of query parameters."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    names = F.filter(F.transform(F.split(F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("")), "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(parts, lambda x: F.concat(F.lit(tag), x))

    return F.array_distinct(F.concat(tagged("host:", labels), tagged("path:", segments), tagged("query:", names)))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (verdict, host, path) whose host is the URL's or a parent of it and whose path starts the URL's, as a struct; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


_RULE = "tokens array<string>, verdict string, lift double, confidence double, support double, token string"


_CLASSES = "member string, token string, count bigint"


def _classes(baskets: DataFrame, least: float) -> DataFrame:
    """member -> token, the first of those that are in the same baskets; of tokens in ``least`` baskets and more.

    Baskets are compared by the exclusive or of their SHA-256 digests.  There are
    at most (tokens of all baskets) / ``least`` rows: with a support s, no more
    than the mean tokens of a URL divided by s.
    """
    digest = F.sha2(F.concat_ws("\0", F.array_sort("own")), 256)
    once = baskets.groupBy(digest.alias("digest")).agg(F.first("own").alias("own"), F.count("*").alias("n"))
    quarters = [F.expr(f"cast(conv(substring(digest, {1 + 15 * i}, 15), 16, 10) as bigint)").alias(f"q{i}") for i in range(4)]
    rows = once.select(F.explode("own").alias("member"), "n", *quarters)
    sets = rows.groupBy("member").agg(F.sum("n").alias("count"), *[F.bit_xor(f"q{i}").alias(f"q{i}") for i in range(4)]).where(F.col("count") >= least)
    same = ["count", "q0", "q1", "q2", "q3"]
    first = sets.groupBy(*same).agg(F.min("member").alias("token"))
    return sets.join(first, same).select("member", "token", "count")


def _mined(labelled: DataFrame, support: float, confidence: float) -> tuple[DataFrame, DataFrame]:
    """(rules, classes of the tokens that they are about)."""
    spark = labelled.sparkSession
    baskets = labelled.where("url is not null and verdict is not null").select(tokens(F.col("url")).alias("own"), F.concat(F.lit("verdict:"), "verdict").alias("label"))
    baskets = written(baskets.withColumn("id", F.monotonically_increasing_id()), "baskets")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], _RULE), spark.createDataFrame([], _CLASSES)
    share = max(support, min(1.0, LEAST / n))
    classes = written(_classes(baskets, share * n - 1e-6), "classes")
    # rows without a frequent token stay: they count in the support
    theirs = baskets.select("id", "label", F.explode_outer("own").alias("member")).join(F.broadcast(classes.select("member", "token")), "member", "left")
    items = theirs.groupBy("id", "label").agg(F.collect_set("token").alias("own")).select(F.array_append("own", F.col("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict:") & ~F.exists("antecedent", lambda x: x.startswith("verdict:")))
    found = written(found.select(F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 9)").alias("verdict"), "lift", "confidence", "support").where(F.col("lift") > 1 - 1e-9), "rules")
    shorter = found.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("its"))
    less = found.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("left_out"))
    less = less.withColumn("fewer", F.array_remove("tokens", F.col("left_out")))
    redundant = less.join(shorter, ["fewer", "verdict"]).where("its >= confidence").select("tokens", "verdict").distinct()
    kept = found.join(redundant, ["tokens", "verdict"], "left_anti")
    # the inverted index has a rule under its rarest token
    seen = classes.where("member = token").select("token", "count")
    each = kept.select("tokens", "verdict", F.explode("tokens").alias("token"))
    rarest = each.join(seen, "token").groupBy("tokens", "verdict").agg(F.min(F.struct("count", "token")).getField("token").alias("token"))
    rules = written(kept.join(rarest, ["tokens", "verdict"]).select("tokens", "verdict", "lift", "confidence", "support", "token"), "index")
    return rules, classes.join(rules.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi").select("member", "token", "count")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """tokens (in order), verdict, lift, confidence, support of the kept rules, and the token that each is indexed under, from rows (url, verdict).

    A rule's lift is its confidence over its verdict's share of all labels; under
    1 it goes.  So does a rule if one with a token less is as confident.  Of tokens that always
    occur together the first stands for all, however many they are.
    """
    return _mined(labelled, support, confidence)[0]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, mined for every row: the explicit rule's verdict, else the mined rule's (its tokens in ``mined``), else allow.

    A null URL and one without :// have an empty host and path, fit no rule and
    are allowed.  Repeated rows give repeated results; without labels nothing is
    mined.  Of explicit rules of one length the first by host and path wins, of
    mined rules the one of the greatest lift (a confident rule for a verdict that
    most URLs have says little), then the most confident, then the best supported,
    then the first by tokens (a class by its first).  Very long URLs are taken whole.
    """
    found, classes = _mined(labelled, SUPPORT, CONFIDENCE)
    small = pages.select(named(key), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.array_sort(tokens(F.col("url"))).alias("tokens"))
    small = small.withColumn("explicit", matching_rule(F.col("host"), F.col("path"), rules)).select(named(key), "host", "path", F.col("explicit.rule").alias("rule"), F.col("explicit.verdict").alias("explicit"), "tokens")
    # token sets are judged, each once; a rule is met under one token and fits if all of its classes are there
    asked = small.where("explicit is null").select("tokens").distinct().select("tokens", F.explode("tokens").alias("member"))
    asked = asked.join(F.broadcast(classes.select("member", "token")), "member").groupBy("tokens").agg(F.collect_set("token").alias("own"))
    met = asked.select("tokens", "own", F.explode("own").alias("token")).join(found.withColumnRenamed("tokens", "needed"), "token").where(F.size(F.array_except("needed", "own")) == 0)
    best = F.struct((-F.col("lift")).alias("l"), (-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col("needed").alias("t"), F.col("verdict").alias("v"))
    judged = met.groupBy("tokens").agg(F.min(best).alias("best"))
    out = small.join(judged, "tokens", "left")
    mined = F.when(F.col("explicit").isNull(), F.col("best.t"))
    return out.select(named(key), "host", "path", "rule", F.coalesce("explicit", "best.v", F.lit(DEFAULT)).alias("verdict"), mined.alias("mined"))
