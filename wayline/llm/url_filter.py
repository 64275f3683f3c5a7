"""Allow and block rules over URLs, by hashed host-suffix and path-prefix expressions.

A URL is expanded into one expression for each host suffix and path prefix that a rule could have
(the label counts and path lengths that occur among the rules), expressions are joined to the rules on
a four-byte digest prefix, full digests confirm the hit, and the longest rule decides.

Defined cases: a URL that is null or has no ``://`` has an empty host and path; a URL with no rule gets
the default verdict; repeated rows give repeated results; of equally long rules the one with the longer
host wins, then block before allow; repeated rules count once; an empty table gives no rows; further
columns are passed through by ``filter_urls`` whatever their names (``host``, ``path``, ``rule`` and ``verdict`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import free, others, presence_bitmap, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which their table is broadcast; more are joined by a shuffle on the digest prefix.
BROADCAST_RULES = 100_000
ADDED = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """pages (url, ...) with host, path, rule (``host`` + ``path`` of the winner, else null) and verdict.

    rules: host, path, verdict ('allow' or 'block').
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    shape = rules.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"), F.count("*").alias("n")
    ).first()
    rules = rules.withColumn("r_full", _digest(F.concat("r_host", "r_path"))).withColumn("r_short", F.substring("r_full", 1, 4))
    pages = pages.select(*others(pages.columns, ADDED)).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    seen = pages.select("host", "path").distinct()
    expressions = [
        F.when(
            (F.size(F.split("host", r"\.")) >= k) & (F.length("path") >= n),
            F.struct(F.substring_index("host", ".", -k).alias("suffix"), F.substring("path", 1, n).alias("prefix")),
        )
        for k in sorted(shape["labels"])
        for n in sorted(shape["lengths"])
    ]
    if not expressions:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    expanded = (
        seen.select("host", "path", F.explode(F.filter(F.array(*expressions), lambda x: x.isNotNull())).alias("x"))
        .select("host", "path", _digest(F.concat("x.suffix", "x.prefix")).alias("full"), F.col("x.suffix").alias("suffix"))
        .withColumn("short", F.substring("full", 1, 4))
    )
    hits = expanded.join(F.broadcast(rules) if shape["n"] <= broadcast_rules else rules, F.col("short") == F.col("r_short")).where(
        (F.col("full") == F.col("r_full")) & (F.col("suffix") == F.col("r_host"))
    )
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block", "r_host", "r_path", "r_verdict")
    best = written(hits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(F.max(order).alias("best")), "url_rules")
    # only URLs that may have a rule meet the rules' URLs, both from plain tables, so that Spark can split a very common URL
    maybe, b_host, b_path, won = free(pages.columns, "maybe", "b_host", "b_path", "best")
    split = presence_bitmap(best, F.xxhash64("b_host", "b_path"), best.count()).marked(pages, F.xxhash64("host", "path"), maybe)
    best = best.select(F.col("b_host").alias(b_host), F.col("b_path").alias(b_path), F.col("best").alias(won))
    judged = split.where(F.col(maybe)).join(best, (F.col("host") == F.col(b_host)) & (F.col("path") == F.col(b_path)), "left").select(
        *pages.columns,
        F.concat(F.col(f"{won}.r_host"), F.col(f"{won}.r_path")).alias("rule"),
        F.coalesce(F.col(f"{won}.r_verdict"), F.lit(default)).alias("verdict"),
    )
    free_of_rules = split.where(~F.col(maybe)).select(*pages.columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return free_of_rules.unionByName(judged)
