"""URL rules by host-suffix and path-prefix expressions, hashed prefixes and full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HOT_KEYS, fresh, materialize, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _behind(url: Column) -> Column:
    """What stands behind the first '://'; '' where there is none."""
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """From behind the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for no host.

    By searches and replacements of single characters alone, so that no url is too long for it.
    """
    host = F.substring_index(F.translate(_behind(F.coalesce(url, F.lit(""))), "?#", "//"), "/", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From behind the host up to '?', '#' or the end; '' where there is no '://'."""
    rest = _behind(F.coalesce(url, F.lit("")))
    return F.substring_index(F.translate(F.substring(rest, F.length(url_host(url)) + 1, F.length(rest)), "#", "?"), "?", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict for each row's url.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. Of the
    rules that fit, the one with the longest host and path together wins, at equal length the one
    with the longer host, then block before allow. Urls that no rule fits get ``default``.

    Each distinct url is expanded to its host suffixes (of the numbers of labels that rules have)
    times its path prefixes (of the lengths that rules have), equi-joined with the rules on the
    first four bytes of the expression's SHA-256 and confirmed by the whole digest. Repeated urls
    are judged once. What was found goes back to the rows by a broadcast if it is small by its
    counted size; beyond that rows of no url pass as they are, urls of more rows than one in
    ``HOT_KEYS`` are broadcast, and the others meet by a shuffle.

    A null url, or one without '://', has an empty host and path, rule null and the default
    verdict. Very long urls cost as much as they are long for each number of labels and each
    length. Repeated rows stay. An empty table gives an empty result. Columns named host, path,
    rule or verdict in the input are replaced. Rules with a null host or path fit nothing.
    """
    rules = rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
    text = F.concat("rule_host", "rule_path")
    rules = rules.select(
        F.sha2(_expression(F.translate("rule_host", UPPER, LOWER), F.col("rule_path")), 256).alias("__digest"),
        text.alias("rule"),
        F.lower("rule_verdict").alias("verdict"),
        F.struct(F.length(text), F.length("rule_host"), (F.lower("rule_verdict") == "block")).alias("__order"),
        F.length("rule_path").alias("__len"),
        F.size(F.split("rule_host", "\\.")).alias("__labels"),
    ).withColumn("__short", F.substring("__digest", 1, 8))
    # at most as many of each as there are distinct rule path lengths and numbers of labels
    lengths, labels = ([r[0] for r in rules.select(c).distinct().orderBy(c).collect()] for c in ("__len", "__labels"))

    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(names)
    key, count = fresh(names, "__url"), fresh(names, "__n")
    urls = pages.select(F.col(url).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    urls = urls.select("__url", url_host(F.col("__url")).alias("__host"), url_path(F.col("__url")).alias("__path")).where("__host <> ''")
    dots = F.length("__host") - F.length(F.translate("__host", ".", "")) + 1
    suffix = [F.when(dots >= n, F.substring_index("__host", ".", -n)) for n in labels]
    expanded = urls.select("__url", "__path", F.explode(F.array_compact(F.array(*suffix))).alias("__suffix")) if suffix else urls.limit(0).withColumn("__suffix", F.lit(""))
    prefixes = F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)]))
    expanded = expanded.select("__url", "__path", "__suffix", prefixes.alias("__len")).where(F.length("__path") >= F.col("__len"))
    digest = F.sha2(_expression(F.col("__suffix"), F.substring(F.col("__path"), F.lit(1), F.col("__len"))), 256)
    hits = (
        expanded.select("__url", digest.alias("__full"))
        .withColumn("__short", F.substring("__full", 1, 8))
        .join(small_side(rules, F.lit(256) + F.octet_length("rule")), "__short")
        .where(F.col("__full") == F.col("__digest"))
    )
    best = hits.groupBy("__url").agg(F.max(F.struct("__order", "rule", "verdict")).alias("__best"))
    best = materialize(best.select(F.col("__url").alias(key), "__best.rule", "__best.verdict"), "verdicts")
    same = F.col(url) == F.col(key)
    judged = small_side(best, F.lit(96) + F.octet_length(key) + F.octet_length("rule"))
    if judged is not best:
        out = pages.join(judged, same, "left")
    else:
        edge = pages.count() / HOT_KEYS
        known = pages.where(F.col(url).isNotNull())
        hot = known.groupBy(F.col(url).alias(key)).agg(F.count("*").alias(count)).where(F.col(count) > edge).select(key)
        hot = materialize(hot, "hot")
        often = small_side(materialize(hot.join(best, key, "left"), "often"), F.lit(96) + F.octet_length(key) + F.coalesce(F.octet_length("rule"), F.lit(0)))
        hot = small_side(hot, F.lit(32) + F.octet_length(key))
        rest = known.join(hot, same, "left_anti").join(best, same, "left")
        none = [F.lit(None).cast(best.schema[c].dataType).alias(c) for c in best.columns]
        out = known.join(often, same).unionByName(rest).unionByName(pages.where(F.col(url).isNull()).select("*", *none))
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
