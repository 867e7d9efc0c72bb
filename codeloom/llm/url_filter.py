"""URL filtering by rule lists: host-suffix and path-prefix expressions joined by hash prefix.

A rule is a host suffix and a path prefix with a verdict. Each URL is expanded into the
expressions that could be a rule (the suffixes of its host with as many labels as some rule has,
the prefixes of its path with as many characters as some rule has). Expressions meet rules in an
equi-join on the first four bytes of their SHA-256; the full digest confirms. Base rules come before
others, and among either the rule with the longest expression wins. No URL is compared with a rule
that it can't match.

The rule table may be of any size: below ``BROADCAST_ROWS`` rows (counted) it is broadcast, and the
expansion of a URL is aggregated back within its task, so what is shuffled is one row per URL. A larger
table is first cut to the rules that some expression asks for, by distinct digests, which no frequent
expression can make hot; what is still too large is joined by shuffle, with row numbers instead of URLs.

Edge cases: a null URL or one without ``://`` has an empty host and path, matches nothing and gets
the default verdict. Very long URLs cost as much as they have lengths that some rule has. Rows are told
apart by number, so repeated rows, and rows with equal or null page_id, give as many result rows. Empty
tables give empty results. Extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import cut, let

BROADCAST_ROWS = 100_000
RULE_SCHEMA = "host string, path string, verdict string, base boolean"

#: The contract's rules, then this method's own.
BASE_RULES = [
    ("org", "/", "allow", True),
    ("example.org", "/es/", "block", True),
    ("example.org", "/en/1", "block", True),
    ("com", "/fr/", "allow", True),
    ("com", "/de/", "block", True),
]
OWN_RULES = [("ads-track.example.com", "/", "block", False), ("ads-track.example.net", "/", "block", False)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short(full: Column) -> Column:
    """The first four bytes as a number."""
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with their digests; of equal expressions the blocking one stays."""
    return (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("verdict", "base"), F.struct(F.col("verdict") == "block", "base")).alias("r"))
        .withColumn("rule_digest", digest(F.col("host"), F.col("path")))
        .select(
            short(F.col("rule_digest")).alias("key"),
            "rule_digest",
            F.concat("host", "path").alias("name"),
            (F.length("host") + F.length("path")).alias("size"),
            F.col("r.verdict").alias("rule_verdict"),
            F.col("r.base").alias("base"),
            F.size(F.split("host", "[.]")).alias("labels"),
            F.length("path").alias("path_size"),
        )
    )


def expressions(host: Column, path: Column, labels: list[int], sizes: list[int]) -> Column:
    """Digests of all host suffixes with a number of labels in ``labels`` and path prefixes with a length in ``sizes``."""

    def suffixes(split: Column) -> Column:
        n = F.size(split)
        return F.transform(
            F.filter(F.array(*[F.lit(k) for k in labels]), lambda k: k <= n),
            lambda k: F.array_join(F.slice(split, n - k + 1, k), "."),
        )

    def prefixes() -> Column:
        return F.transform(
            F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: k <= F.length(path)),
            lambda k: F.substring(path, F.lit(1), k),
        )

    return let(
        F.split(host, "[.]"),
        lambda s: F.flatten(F.transform(suffixes(s), lambda h: F.transform(prefixes(), lambda p: digest(h, p)))),
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of ``pages``: page_id, url, host, path, rule, verdict, base_rule.

    ``rule`` is the winning rule's host and path joined (null: none) and ``verdict`` its verdict
    or the default.
    """
    table = rule_table(rules)
    n, labels, sizes = table.agg(
        F.count("*"), F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("path_size"))
    ).first()
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))

    def expanded(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("digest", F.explode_outer(expressions(F.col("host"), F.col("path"), labels, sizes)))
        return found.withColumn("key", short(F.col("digest")))

    sure = F.col("digest") == F.col("rule_digest")
    best = F.max_by(F.when(sure, F.struct("name", "rule_verdict", "base")), F.when(sure, F.struct("base", "size", "name"))).alias("best")
    if n > BROADCAST_ROWS:
        asked = expanded(rows).select("key", "digest").distinct()
        table = cut(table.join(asked, "key").filter(sure).drop("digest"))
        n = table.count()
    if not n:
        rows = rows.withColumn("best", F.lit(None).cast("struct<name:string,rule_verdict:string,base:boolean>"))
    elif n <= BROADCAST_ROWS:
        rows = expanded(rows).join(F.broadcast(table), "key", "left").groupBy("row", "page_id", "url", "host", "path").agg(best)
    else:
        rows = cut(rows)
        found = expanded(rows).select("row", "key", "digest").join(table, "key").filter(sure).groupBy("row").agg(best)
        rows = rows.join(found, "row", "left")
    return rows.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
        F.col("best.base").alias("base_rule"),
    )


def production_rules(spark: SparkSession, own: bool = True) -> DataFrame:
    return spark.createDataFrame(BASE_RULES + (OWN_RULES if own else []), RULE_SCHEMA)


def contract(judged: DataFrame) -> DataFrame:
    """``rule`` names base rules only; the method's own rules show in the verdict."""
    rule = F.when(F.col("base_rule"), F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")
