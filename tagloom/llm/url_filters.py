"""URL filters by a sort-merge range join, in DataFrame functions only.

Keys are canonical: host labels reversed, then the path, so that all that a
rule fits is an interval of keys. A page stands under its host and each host
above it; within a host, rules and pages are sorted by path and swept once. The
sweep carries the stack of rules that are active (each encloses the next): at a
page, the stack of the last rule before it, of which rules whose interval has
ended are popped. The innermost that stays fits, and the longest host's wins.

A host with many pages is dealt to several sweeps in proportion to its share,
each with a copy of that host's rules.

Cases: a url that is null or has no :// has an empty host and path and gets the
default; of rules for the same host and path, block wins; repeated pages come
out repeated; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower
from .decontaminate import sized

#: Fixed values of the contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ://, in lower case, and the path up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def with_stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the rules that enclose it, outermost first and itself last.

    A rule encloses another of its host if its path begins the other's, so that
    an equi-join on the other's own prefixes finds them.
    """
    rules = rules.where("host is not null").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    rules = rules.select(reversed_host(F.col("host")).alias("rev"), "path", "verdict", F.concat("host", "path").alias("rule"))
    begun = rules.select("rev", F.col("path").alias("own"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))).alias("path"))
    return begun.join(rules, ["rev", "path"]).groupBy("rev", "own").agg(F.array_sort(F.collect_list(F.struct("path", "rule", "verdict"))).alias("stack")).withColumnRenamed("own", "path")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of each page (page_id, url)."""
    spark = pages.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacks = with_stacks(rules)
    deepest = stacks.agg(F.max(F.size(F.split("rev", r"\.")))).first()[0] or 0
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    labels = F.reverse(F.split(F.col("host"), r"\."))
    # a page stands under the hosts of one label, of two, and so on, as far as rules go
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(labels), F.lit(deepest)))), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    spread = split.select("*", F.posexplode(above).alias("depth", "rev"))
    counted = spread.groupBy("rev").agg(F.count("*").alias("n"))
    total = max(1, counted.agg(F.sum("n")).first()[0] or 1)
    hosts = stacks.select("rev").distinct().join(counted, "rev").select("rev", F.ceil(2 * n_parts * F.col("n") / total).cast("int").alias("sweeps"))
    placed = spread.join(sized(hosts), "rev", "left")
    none = F.lit(None)
    kind = "array<struct<path:string,rule:string,verdict:string>>"
    pages_in = placed.where("sweeps is not null").select("rev", F.pmod(F.xxhash64("page_id", "url"), F.col("sweeps")).cast("int").alias("sweep"), F.col("path").alias("key"), F.lit(1).alias("is_page"), none.cast(kind).alias("stack"), "page_id", "url", "host", "path", "depth")
    like = split.select("page_id").schema["page_id"].dataType
    rules_in = stacks.join(hosts, "rev").select("rev", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("sweep"), F.col("path").alias("key"), F.lit(0).alias("is_page"), "stack", none.cast(like).alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("host"), none.cast("string").alias("path"), none.cast("int").alias("depth"))
    order = Window.partitionBy("rev", "sweep").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, 0)
    swept = pages_in.unionByName(rules_in).withColumn("active", F.last("stack", ignorenulls=True).over(order)).where("is_page = 1")
    top = F.filter("active", lambda r: F.col("key").startswith(r["path"]))
    met = swept.select("page_id", "url", "host", "path", "depth", F.when(F.size(top) > 0, F.element_at(top, -1)).alias("top"))
    bare = placed.where("sweeps is null").select("page_id", "url", "host", "path", "depth", none.cast("struct<path:string,rule:string,verdict:string>").alias("top"))
    best = F.max(F.when(F.col("top").isNotNull(), F.struct("depth", "top")))
    out = met.union(bare).groupBy("page_id", "url", "host", "path").agg(best.alias("best"), F.sum(F.when(F.col("depth") == 0, 1)).alias("rows"))
    return out.select(
        "page_id", "host", "path", F.col("best.top.rule").alias("rule"), F.coalesce("best.top.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"),
    ).drop("row")
