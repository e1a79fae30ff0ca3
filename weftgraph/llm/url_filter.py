"""URL filters: rules on host suffix and path prefix, found by joins on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", prefix_hex: int = 8) -> DataFrame:
    """Rows ``page_id, host, path, rule, verdict`` for each page. ``rules``: columns ``host, path,
    verdict``. A rule fits its host and all subdomains of it where the url's path starts with the
    rule's; the longest (host and path together, then the host, then the text) decides, else ``default``.

    A url is expanded into the host suffixes and path prefixes of just those lengths that some rule
    has, so their number hangs on the rule table's distinct shapes and not on the url. Expansions
    meet rules on the first ``prefix_hex`` digits of a SHA-256; the full digest confirms. The rule
    table is joined, not broadcast by hand: Spark broadcasts it below its size threshold and
    otherwise splits skewed keys. Each distinct (host, path) is judged once.

    Null url, or one without ``://``: empty host and path, no rule. A url of any length is read whole; only the
    lengths that rules have are expanded. Null id: returned as null. Pages that occur twice are returned twice. Rules that
    tie in all are one. Other columns of either table are ignored, whatever their names. Empty rules or pages: no matches, or no rows. The rule table's shapes (distinct
    label count and path length) are read by the driver; there must be at most 10,000.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rhost"), F.col("path").alias("rpath"), F.col("verdict").alias("rverdict"))
    shapes = rules.select(F.size(F.split("rhost", r"\.")).alias("labels"), F.char_length("rpath").alias("chars")).distinct().limit(10_001).collect()
    if len(shapes) > 10_000:
        raise ValueError("more than 10,000 distinct rule shapes")
    seen = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shapes:
        return seen.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    options = [
        F.when(
            (F.size(labels) >= s.labels) & (F.char_length("path") >= s.chars),
            F.struct(F.substring_index("host", ".", -s.labels).alias("suffix"), F.substring("path", 1, s.chars).alias("start")),
        )
        for s in sorted(shapes)
    ]
    expanded = (
        seen.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(F.filter(F.array(*options), lambda o: o.isNotNull())).alias("o"))
        .withColumn("digest", _digest(F.col("o.suffix"), F.col("o.start"))).withColumn("prefix", F.substring("digest", 1, prefix_hex))
    )
    keyed = rules.where("rhost <> ''").withColumn("rdigest", _digest(F.col("rhost"), F.col("rpath"))).withColumn("prefix", F.substring("rdigest", 1, prefix_hex))
    matched = expanded.join(keyed, "prefix").where((F.col("digest") == F.col("rdigest")) & (F.col("o.suffix") == F.col("rhost")) & (F.col("o.start") == F.col("rpath")))
    rank = F.struct((F.char_length("rhost") + F.char_length("rpath")).alias("n"), F.char_length("rhost").alias("h"), F.col("rhost"), F.col("rpath"), F.col("rverdict"))
    best = matched.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return seen.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.concat("best.rhost", "best.rpath").alias("rule"), F.coalesce("best.rverdict", F.lit(default)).alias("verdict")
    )
