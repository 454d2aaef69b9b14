"""URL filters: rules by host and path, and a list of canonical URLs that is
probed through a blocked Bloom filter and confirmed by an exact hash join.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectspark.llm.common import bloom_filter, lower_ascii, materialize, might_contain

#: Query parameters that only say how a page was reached.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://`` (null or none: empty)."""
    return F.coalesce(F.when(F.contains(url, F.lit("://")),
                             F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)), F.lit(""))


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment,
    tracking parameters and trailing slashes; the other parameters stay in
    their order.  Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept))
                                       .otherwise(F.lit(""))))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """``value`` 0: the verdict, 1: the rule, of the longest rule that fits
    (equal lengths: the smaller rule), else null."""
    out = None
    for entry in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, rule_path = split_rule(entry[1])
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(
            path, F.lit(rule_path))
        out = F.when(fits, F.lit(entry[value])) if out is None else out.when(fits, F.lit(entry[value]))
    return F.lit(None).cast("string") if out is None else out


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]],
                id_col: str = "page_id", url_col: str = "url", listed_col: str = "url",
                blocks: int | None = None) -> DataFrame:
    """Judge each page by its URL: ``id_col``, host, path, rule, listed, verdict.

    A page is blocked if its canonical URL is in ``listed`` (column
    ``listed_col``, canonicalised here), unless a rule decides.  The list's
    blocked Bloom filter (sized by the list, or of ``blocks`` blocks, and
    never above ``BLOOM_BLOCKS`` rows, so safe to broadcast) lets definite
    misses pass without a shuffle; possible hits go to an exact join, where a
    hot URL of the pages is split by adaptive execution (the list side has
    one row per URL).

    Null URLs, and URLs without ``://``, have an empty host and path, fit no
    rule, are never listed and are allowed.  Repeated pages are judged each;
    an empty list blocks nothing; other columns are ignored.
    """
    urls = materialize(
        listed.select(canonical_url(F.col(listed_col)).alias("canonical"))
        .where(F.col("canonical").isNotNull()).distinct(), "listed-urls")
    url = F.col("url")
    judged = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url")).select(
        "page", url_host(url).alias("host"), url_path(url).alias("path"),
        canonical_url(url).alias("canonical"))
    probed = might_contain(judged, bloom_filter(urls, "canonical", blocks), F.col("canonical"), "possible")
    misses = probed.where(~F.col("possible")).withColumn("listed", F.lit(False))
    hits = (probed.where("possible")
            .join(urls.withColumn("found", F.lit(True)), "canonical", "left")
            .withColumn("listed", F.coalesce("found", F.lit(False))).drop("found"))
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_column(host, path, rules, 0),
                         F.when(F.col("listed"), "block").otherwise("allow"))
    return misses.unionByName(hits).select(
        F.col("page").alias(id_col), "host", "path",
        rule_column(host, path, rules, 1).alias("rule"), verdict.alias("verdict"), "listed")
