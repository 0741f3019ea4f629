"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule (host, path, verdict) fits its host and all subdomains, for paths that start with its own; the longest wins: the
rule with most characters in host and path, then in host. A host is turned round, `a.example.org` to `org.example.a`. A
url stands under each of its own host's ancestors, so under one ancestor's key the rules of that host are intervals of
paths, `[path, path + U+10FFFF]`, nested or disjoint. Openings, closings and urls are sorted together and swept once.
The sweep's stack of active nested rules is a pair of windows: the running number of open intervals is its depth, and the
last opening that led to a depth is its top. Only urls under a host that has rules take part, found by a join of hosts.

Hot hosts: urls are dealt over SALTS-fold replicas of their host's rules, so a host that holds a third of all urls is
swept by SALTS tasks. SALTS is spark.sql.shuffle.partitions unless given, so it grows with the cluster.

Rows: one result row per input row, repeated ones too; a null url, or one without `://`, has an empty host and path and
no rule. Rules with a null part are left out; of rules for the same host and path the first verdict in alphabetical order
holds. A rule's path is `/` at least. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: The contract's rules: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def turned(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def sweep(rules: DataFrame) -> DataFrame:
    """(key, path, kind, top): at each opening and closing, the innermost rule that is open after it.

    Depth counts the open intervals after an event. The rule on top after an event is the last one that was opened to
    that depth, and at depth 0 there is none.
    """
    keyed = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path")).alias("path"), "verdict").dropna()
    rule = keyed.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", turned(F.col("host")))
    own = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    opened = rule.select("key", "path", F.lit(0).alias("kind"), F.lit(1).alias("change"), own.alias("own"))
    closed = rule.select("key", F.concat("path", F.lit(LAST)).alias("path"), F.lit(2).alias("kind"), F.lit(-1).alias("change"), F.lit(None).cast(opened.schema["own"].dataType).alias("own"))
    order = Window.partitionBy("key").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    deep = opened.unionByName(closed).withColumn("depth", F.sum("change").over(order))
    same = Window.partitionBy("key", "depth").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return deep.withColumn("top", F.when(F.col("depth") > 0, F.last("own", ignorenulls=True).over(same))).select("key", "path", "kind", "top")


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, salts: int | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict."""
    salts = salts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).groupBy("id", "url").agg(F.count("*").alias("copies"))
    urls = urls.withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.reverse(F.slice(labels, -k, k)), "."))
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(salts))
    under = urls.filter("host <> ''").select("id", "url", "path", F.explode(ancestors).alias("key"), salt.alias("salt"))
    states = sweep(rules)
    under = under.join(states.select("key").distinct(), "key", "left_semi")
    spread = states.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    points = under.select("key", "salt", "path", F.lit(1).alias("kind"), F.lit(None).cast(states.schema["top"].dataType).alias("top"), F.struct("id", "url").alias("at"))
    none = F.lit(None).cast(points.schema["at"].dataType).alias("at")
    #: The state is wrapped: that no rule is open must overwrite what was open before.
    both = points.withColumn("state", F.lit(None).cast(f"struct<top:{states.schema['top'].dataType.simpleString()}>")).unionByName(spread.select("key", "salt", "path", "kind", "top", none, F.struct("top").alias("state")))
    along = Window.partitionBy("key", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("now", F.last("state", ignorenulls=True).over(along)).filter("at is not null and now.top is not null").select("at.id", "at.url", "now.top")
    best = urls.select("id", "url", "host", "path", "copies", F.lit(None).cast(states.schema["top"].dataType).alias("top")).unionByName(met, allowMissingColumns=True)
    best = best.groupBy("id", "url").agg(*(F.max(c).alias(c) for c in ("host", "path", "copies", "top")))
    rows = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6_url_rules over the whole of pages."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS r(host, path, verdict)")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
),
ranked AS (
  SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id, s.url ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM ranked WHERE k = 1
"""
