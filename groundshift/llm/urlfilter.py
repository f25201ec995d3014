"""URL rules by expression expansion: host suffixes and path prefixes, joined on short hash prefixes.

Each URL becomes the expressions that a rule for it could have; these are equi-joined with the rules on the first
bytes of a SHA-256 digest, then full digests and strings are compared and the strongest rule wins. Built-in functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are sent to every task; a larger list is joined by a shuffle with salted expressions.
BROADCAST_RULES = 50_000
SALTS = 16
#: Hexadecimal digits of the digest that are joined on.
PREFIX = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge each row's URL by rules (verdict, host, path).

    A rule fits its host and all subdomains if the URL's path starts with the rule's. The longest rule (host and path
    together) wins; of equally long ones the longer host, then `block`. Returns page_id, host, path, rule (null if none
    fits) and verdict (the default if none fits).

    A null URL, or one without `://`, has an empty host and path and fits no rule. Repeated rows, null ids and equal
    URLs give a row each; an empty table gives an empty one; other columns don't matter.

    One scan and one shuffle: expressions are expanded next to the scan and summed up by page before the exchange, so
    a hot host costs no more than any other. Host suffixes are cut at the numbers of labels that rules have and path
    prefixes at their lengths, so a URL of any length gives at most (distinct numbers of labels in rules) x (distinct
    rule path lengths) expressions.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(v, h, p) for v, h, p in rules] or [("", "", "")], "verdict string, host string, path string").filter("verdict <> ''")
    whole = F.concat("host", "path")
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    strength = F.struct(F.length(whole).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("block"), whole.alias("rule"), F.col("verdict").alias("verdict"))
    table = table.select(digest.alias("rule_digest"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), strength.alias("strength"))
    table = table.groupBy("rule_digest", "rule_host", "rule_path").agg(F.max("strength").alias("strength")).withColumn("short", F.substring("rule_digest", 1, PREFIX))
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in rules})]).cast("array<int>")

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col).cast("string")).alias("host"), url_path(F.col(url_col).cast("string")).alias("path"))
    depths = F.array(*[F.lit(n) for n in sorted({h.count(".") + 1 for _, h, _ in rules})]).cast("array<int>")
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))
    hosts = F.transform(F.filter(depths, lambda n: n <= dots + 1), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    # The first expression stands for the row itself, so that rows without any are kept and repeated rows are counted.
    own = F.array(F.struct(F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("p")))
    wide = pages.select("page_id", "host", "path", F.explode(F.concat(own, F.when(F.col("host") != "", pairs).otherwise(F.array().cast("array<struct<h:string,p:string>>")))).alias("e"))
    wide = wide.select("page_id", "host", "path", "e", F.sha2(F.concat_ws("\n", "e.h", "e.p"), 256).alias("digest")).withColumn("short", F.when(F.col("e.h").isNotNull(), F.substring("digest", 1, PREFIX)))
    keys = ["short"]
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    else:
        keys = ["short", "salt"]
        wide = wide.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    met = wide.join(table, keys, "left")
    fits = (F.col("rule_digest") == F.col("digest")) & (F.col("rule_host") == F.col("e.h")) & (F.col("rule_path") == F.col("e.p"))
    best = met.groupBy("page_id", "host", "path").agg(F.max(F.when(fits, F.col("strength"))).alias("best"), F.count_if(F.col("e.h").isNull()).alias("copies"))
    rows = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
