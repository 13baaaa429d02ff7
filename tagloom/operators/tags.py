"""Tag browsing, statistics and co-occurrence. A tag table has file_id, rel, value_str and value_num."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import compare

def tags_by_rel(tags: DataFrame, rel: str, search: str | None = None) -> DataFrame:
    """value and song_count of a rel's string tags, optionally those that contain `search` in any case."""
    found = tags.where((F.col("rel") == rel) & F.col("value_str").isNotNull())
    if search:
        found = found.where(F.lower("value_str").contains(search.lower()))
    return found.groupBy(F.col("value_str").alias("value")).agg(F.countDistinct("file_id").alias("song_count"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page; the order must be total. Spark takes the first offset + limit rows of each partition, never a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def unique_rels(tags: DataFrame, prefix: str = "") -> DataFrame:
    return tags.where(F.col("rel").startswith(prefix)).select("rel").distinct()


def tag_stats(tags: DataFrame) -> DataFrame:
    """Per rel: edges, different values, files, whether most values are numbers, whether a file has several, and the numbers' range."""
    per_file = tags.groupBy("rel", "file_id").agg(F.count("*").alias("n"), F.count("value_num").alias("nums"), F.min("value_num").alias("lo"), F.max("value_num").alias("hi"))
    whole = per_file.groupBy("rel").agg(F.sum("n").alias("total"), F.count("*").alias("files"), (2 * F.sum("nums") > F.sum("n")).alias("numeric"), (F.max("n") > 1).alias("multivalue"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"))
    values = tags.where("value_str is not null").groupBy("rel").agg(F.countDistinct("value_str").alias("string_values"))
    return whole.join(values, "rel", "left").withColumn("string_values", F.coalesce("string_values", F.lit(0)))


def grouped_tags(tags: DataFrame, prefix: str = "") -> DataFrame:
    """Per file and rel its string values, sorted and joined by |."""
    own = tags.where(F.col("rel").startswith(prefix) & F.col("value_str").isNotNull())
    return own.groupBy("file_id", "rel").agg(F.array_join(F.array_sort(F.collect_list("value_str")), "|").alias("values"))


def files_matching(tags: DataFrame, rel: str, op: str, value: str | float) -> DataFrame:
    """file_id of those with a tag of this rel that compares so: one matching value is enough."""
    return tags.where((F.col("rel") == rel) & compare(op, value)).select("file_id").distinct()


@dataclass(frozen=True)
class Condition:
    rel: str
    op: str
    value: str | float


@dataclass(frozen=True)
class Rules:
    """A playlist's rules: conditions and groups under AND or OR, at most MAX_DEPTH deep."""

    logic: str
    conditions: tuple[Condition, ...] = ()
    groups: tuple[Rules, ...] = field(default=())

    def depth(self) -> int:
        return 1 + max((g.depth() for g in self.groups), default=0)


MAX_DEPTH = 5


def atoms(rules: Rules) -> list[Condition]:
    return list(dict.fromkeys([*rules.conditions, *(a for g in rules.groups for a in atoms(g))]))


def files_for_rules(tags: DataFrame, rules: Rules) -> DataFrame:
    """file_id of those that the rules take: one scan and one aggregation by file, however many conditions there are."""
    if rules.depth() > MAX_DEPTH:
        raise ValueError(f"rules are nested deeper than {MAX_DEPTH}")
    each = atoms(rules)
    if not each:
        raise ValueError("rules have no conditions")
    test = {a: f"a{i}" for i, a in enumerate(each)}
    wanted = tags.where(F.col("rel").isin(sorted({a.rel for a in each})))
    flags = wanted.groupBy("file_id").agg(*(F.max(F.when((F.col("rel") == a.rel) & compare(a.op, a.value), 1).otherwise(0)).alias(n) for a, n in test.items()))

    def holds(r: Rules):
        parts = [F.col(test[c]) == 1 for c in r.conditions] + [holds(g) for g in r.groups]
        return reduce((lambda a, b: a & b) if r.logic.upper() == "AND" else (lambda a, b: a | b), parts)

    return flags.where(holds(rules)).select("file_id")


def cooccurrence(tags: DataFrame, rel_x: str, rel_y: str) -> DataFrame:
    """Files that have both values, for each value of one rel and of the other. An equi-join by file."""
    one = tags.where((F.col("rel") == rel_x) & F.col("value_str").isNotNull()).select("file_id", F.col("value_str").alias("x")).distinct()
    two = tags.where((F.col("rel") == rel_y) & F.col("value_str").isNotNull()).select("file_id", F.col("value_str").alias("y")).distinct()
    return one.join(two, "file_id").groupBy("x", "y").agg(F.count("*").alias("n_files"))


def number_distribution(tags: DataFrame, rel: str) -> DataFrame:
    return tags.where((F.col("rel") == rel) & F.col("value_num").isNotNull()).groupBy(F.col("value_num").cast("long").alias("value")).agg(F.countDistinct("file_id").alias("n_files"))


def top(df: DataFrame, by: str, then: str, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(then)).limit(n)


def nearest(tags: DataFrame, rel: str, target: float, n: int) -> DataFrame:
    """The files whose number is nearest to the target; ties by file_id."""
    d = F.abs(F.col("value_num") - target)
    return tags.where((F.col("rel") == rel) & F.col("value_num").isNotNull()).select("file_id", F.round(d, 6).alias("distance")).orderBy("distance", "file_id").limit(n)


def orphans(tags: DataFrame, files: DataFrame) -> DataFrame:
    """Tags of files that are gone."""
    return tags.join(files.select("file_id"), "file_id", "left_anti")


def split_value(tags: DataFrame, rel: str, old: str, parts: list[str]) -> DataFrame:
    """The table with one value replaced by several; a file that has one of them already keeps one edge."""
    is_old = (F.col("rel") == rel) & (F.col("value_str") == old)
    each = F.when(is_old, F.array(*map(F.lit, parts))).otherwise(F.array("value_str"))
    return tags.withColumn("value_str", F.explode(F.coalesce(each, F.array("value_str")))).distinct()


def set_tags(tags: DataFrame, rel: str, values: DataFrame) -> DataFrame:
    """The table with all tags of this rel, of the files in `values` (file_id, value_str), replaced by these."""
    files = values.select("file_id").distinct().withColumn("rel", F.lit(rel))
    return tags.join(files, ["file_id", "rel"], "left_anti").select("file_id", "rel", "value_str", "value_num").union(values.select("file_id", F.lit(rel), "value_str", F.lit(None).cast("double")).distinct())


def incomplete(files: DataFrame, tags: DataFrame, rels: list[str]) -> DataFrame:
    """file_id and the number of these rels that it lacks, where it lacks any."""
    has = tags.where(F.col("rel").isin(rels)).groupBy("file_id").agg(F.countDistinct("rel").alias("has"))
    return files.select("file_id").join(has, "file_id", "left").select("file_id", (F.lit(len(rels)) - F.coalesce("has", F.lit(0))).alias("lacks")).where("lacks > 0")


def value_counts(tags: DataFrame) -> DataFrame:
    """Per rel how many different values it has, of either kind."""
    return tags.groupBy("rel").agg(F.countDistinct(F.struct("value_str", "value_num")).alias("n_values"))


#: How a player names the comparisons of a rule.
PLAYER_OPS = {"=": "is", "!=": "isNot", ">": "gt", "<": "lt", "CONTAINS": "contains", "NOTCONTAINS": "notContains"}


def player_rules(rules: Rules) -> dict:
    """The rules as the document that a player takes: all or any of comparisons of fields and of nested groups."""
    each = [{PLAYER_OPS[c.op.upper()]: {c.rel.replace(":", "_").replace("-", "_"): c.value}} for c in rules.conditions]
    return {"all" if rules.logic.upper() == "AND" else "any": [*each, *map(player_rules, rules.groups)]}


def preview(tags: DataFrame, files: DataFrame, rules: Rules, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """How many files the rules take (one row), and n of them in a seeded random order, by the hash of seed and id."""
    found = files_for_rules(tags, rules)
    return found.agg(F.count("*").alias("total")), files.join(found, "file_id", "left_semi").orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("file_id").cast("string"))), "file_id").limit(n)


def counts_of_known(known: DataFrame, tags: DataFrame, rel: str) -> DataFrame:
    """Each value of a rel in the dictionary (tag_id, rel, value_str, value_num) with its number of songs, 0 included."""
    own = tags.where(F.col("rel") == rel).groupBy("value_str", "value_num").agg(F.countDistinct("file_id").alias("n"))
    values = known.where(F.col("rel") == rel).select("value_str", "value_num")
    a, b = values.alias("a"), own.alias("b")
    same = F.col("a.value_str").eqNullSafe(F.col("b.value_str")) & F.col("a.value_num").eqNullSafe(F.col("b.value_num"))
    return a.join(b, same, "left").select("a.value_str", "a.value_num", F.coalesce("b.n", F.lit(0)).alias("song_count"))
