"""URL allow and block rules by a sort-merge range join (DataFrame operations only).

A host's key is its labels in reverse, each followed by a dot, so that a host and all its subdomains
are one interval of keys. Rule hosts and urls are range-partitioned and sorted together; a sweep over
the sorted rows keeps the stack of nested rules that are active: the last rule host passed, and the
rule hosts that contain it. What a partition inherits from those before it is one row per partition.
The partitioning key ends with the row's id, so one host with most of the rows spreads over many
partitions. There is no join on the host and nothing grows with a host's number of rows.

The longest fitting rule (host and path together) wins; of equal lengths the longer host, then
``block``. Without one the verdict is ``default`` (allow).

Defined results. Null url or one without ``://``: host and path empty, no rule. Repeated rows stay.
Null ids stay null. Extra columns are ignored. Empty table: empty result. A rule with a null or empty
host fits nothing. The stack of a rule host (its rules and those of the hosts that contain it) is one
row's array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dhwani.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = "(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url):
    """(host, path) columns of a url column."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.regexp_extract(url, SPLIT, 2)


def host_key(host):
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): every rule host with the rules of itself and of the hosts that contain it."""
    rules = rules.select(
        F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host <> ''").distinct().withColumn("key", host_key(F.col("host")))
    own = rules.groupBy("key").agg(F.collect_list(F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "verdict",
        F.concat("host", "path").alias("rule"), "path", "key")).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    outer = own.select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("outer"))
    return outer.join(own.select(F.col("key").alias("outer"), "own"), "outer").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rules`` has host, path and verdict."""
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    stacks = _stacks(rules)
    no_stack = F.lit(None).cast(stacks.schema["stack"].dataType)
    rows = stacks.select("key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"), "stack").union(
        urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", no_stack.alias("stack"))
    )
    rows = rows.repartitionByRange(F.col("key"), F.col("kind"), F.xxhash64("page_id", "path")).withColumn("part", F.spark_partition_id())
    rows = written(rows, "urls")
    # what each partition inherits: the last stack of the partitions before it (one row per partition)
    last = rows.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("top"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last("top", True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = rows.withColumn("active", F.last("stack", True).over(sweep)).where("kind = 1")
    active = active.join(carried, "part").withColumn("active", F.coalesce("active", "carried"))
    fits = F.filter("active", lambda r: F.col("key").startswith(r.key) & F.col("path").startswith(r.path))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r.size, r.host_size, r.verdict, r.rule)))
    return active.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


ORACLE = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM (SELECT page_id, host, path,
        (SELECT max({'size': length(h) + length(p), 'h': length(h), 'v': v, 'rule': h || p}) FROM rules
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
      FROM parts)
"""
