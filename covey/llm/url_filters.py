"""URL filters as a temporal list join; DataFrame functions only.

A list is a table of dated entries: from `at` on, `domain` is on the list `list` (listed) or off it again.
The entries of a domain become validity intervals that end where its next entry begins. The hosts of the
captures are reduced to distinct ones and matched with the intervals of all domains they lie under, which
become steps in time; an as-of join then finds each capture's step at its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covey.llm.common import own, staged

#: Entries of the query: dated, with one domain taken off its list and put on again, and one exception.
ENTRIES = [
    ("block", "cheap-pills.example.com", "2024-01-20", True), ("block", "cheap-pills.example.com", "2024-05-01", False), ("block", "cheap-pills.example.com", "2024-08-15", True),
    ("block", "spam-farm.example.org", "2024-02-01", True), ("block", "free-bets.example.com", "2023-11-05", True), ("block", "free-bets.example.com", "2024-10-01", False),
    ("block", "ads-track.example.org", "2024-03-10", True), ("block", "tionsh.example.net", "2024-04-01", True), ("block", "tionsh.example.net", "2024-04-02", False),
    ("allow", "m.free-bets.example.com", "2024-06-01", True), ("block", "example.net", "2024-12-01", True), ("allow", "blog.ththan.example.net", "2024-11-01", True),
]


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dots; null if it has none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, domain, at (timestamp), listed. Returns list, domain, begin, end (exclusive; null: open).

    Entries without a domain or a time are left out. Of entries of one list, domain and time, listed wins.
    """
    known = entries.where("domain IS NOT NULL AND at IS NOT NULL AND list IS NOT NULL")
    one = known.groupBy("list", F.lower("domain").alias("domain"), "at").agg(F.max("listed").alias("listed"))
    order = W.partitionBy("list", "domain").orderBy("at")
    return one.withColumn("end", F.lead("at").over(order)).where("listed").select("list", "domain", F.col("at").alias("begin"), "end")


def host_steps(hosts: DataFrame, valid: DataFrame) -> DataFrame:
    """hosts: distinct column host. For each host under a listed domain, what is active from when to when:
    host, since, until (exclusive; null: open), n_block, n_allow.

    Intervals of a host and the domains above it become steps that do not overlap, so a capture meets one
    step at most. A host has no more steps than its domains have entries. Of its suffixes only those with as
    many labels as some listed domain are made, so a host of very many labels costs no more than its length.
    """
    labels = lambda name: F.size(F.split(name, r"\."))
    lengths = F.broadcast(valid.agg(F.collect_set(labels("domain")).alias("lengths")))  # one row: how many labels a listed domain may have
    known = hosts.select("host", labels("host").alias("n")).crossJoin(lengths).select("host", F.explode(F.expr("filter(lengths, k -> k <= n)")).alias("k"))
    under = known.select("host", F.expr("substring_index(host, '.', -k)").alias("domain")).join(valid, "domain")
    ends = F.explode(F.array(F.struct(F.col("begin").alias("since"), F.lit(1).alias("d")), F.struct(F.col("end").alias("since"), F.lit(-1).alias("d")))).alias("e")
    changes = under.select("host", "list", ends).select("host", "list", "e.since", "e.d").where("since IS NOT NULL")
    count = lambda name: F.sum(F.when(F.col("list") == name, F.col("d")).otherwise(0))
    sums = changes.groupBy("host", "since").agg(count("block").alias("b"), count("allow").alias("a"))
    order = W.partitionBy("host").orderBy("since")
    return sums.select("host", "since", F.lead("since").over(order).alias("until"), F.sum("b").over(order).alias("n_block"), F.sum("a").over(order).alias("n_allow"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: page_id, url, fetched_at. One row for each: page_id, host, fetched_at, n_block, n_allow, blocked.

    A capture is blocked if an entry of the list `block` for its host or a domain above it is active when it
    is fetched, and no entry of `allow` is.
    Nulls and empty URLs: without a host or a fetch time nothing is active. Very long URLs and hosts: read whole.
    Ties: of entries of one list, domain and time, listed wins; an interval holds its begin and not its
    end. Repeated captures: judged one by one; repeated entries count once. Empty tables, of captures or
    entries, are no special case. Other columns are ignored, whatever their names.
    """
    rows = own(captures, "page_id", "url", "fetched_at").select("page_id", host_of(F.col("url")).alias("host"), "fetched_at")
    hosts = rows.where("host IS NOT NULL").select(F.col("host")).distinct()
    steps = staged(host_steps(hosts, intervals(own(entries, "list", "domain", "at", "listed"))), "steps")  # then a host that very many captures have can be split in the join
    step = steps.withColumnRenamed("host", "of")
    active = (F.col("host") == F.col("of")) & (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    found = rows.join(step, active, "left").select("page_id", "host", "fetched_at", count("n_block"), count("n_allow"))
    return found.withColumn("blocked", (F.col("n_block") > 0) & (F.col("n_allow") == 0))


def op7_url_filters(spark, sf_dir):
    """pages has no fetch time; page_id dates it within 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    fetched = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id * 7919, 366) as int))")
    entries = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS e(list, domain, at, listed)")
    return filter_urls(pages.select("page_id", "url", fetched.alias("fetched_at")), entries)


_VALUES = ", ".join(f"('{a}', '{b}', TIMESTAMP '{c} 00:00:00', {d})" for a, b, c, d in ENTRIES)
OP7_SQL = rf"""
WITH e(list, domain, since, listed) AS (VALUES {_VALUES}),
v AS (SELECT *, lead(since) OVER (PARTITION BY list, domain ORDER BY since) AS ends FROM e),
c AS (SELECT page_id, nullif(rtrim(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST((page_id * 7919) % 366 AS INTEGER)) AS fetched_at FROM pages)
SELECT c.page_id, c.host, c.fetched_at, count(*) FILTER (WHERE v.list = 'block') AS n_block, count(*) FILTER (WHERE v.list = 'allow') AS n_allow,
  count(*) FILTER (WHERE v.list = 'block') > 0 AND count(*) FILTER (WHERE v.list = 'allow') = 0 AS blocked
FROM c LEFT JOIN v ON v.listed AND (c.host = v.domain OR ends_with(c.host, '.' || v.domain)) AND v.since <= c.fetched_at AND (v.ends IS NULL OR c.fetched_at < v.ends)
GROUP BY c.page_id, c.host, c.fetched_at
"""
