"""URL filters whose lists change: a temporal join of captures with dated entries.

Entries (value, action, day) become validity intervals: each lasts to the value's next entry,
and those of additions are active. A capture is held against the entries of its host and of
every parent domain, as of the day it was fetched. It takes the most specific active one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import join_folded, read_table

#: An address in four numbers or in brackets, which has no parent domains.
ADDRESS = r"^(?:\[.*|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and dots at its end; null if there is none.

    An address in brackets stays in them.
    """
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def entry_host(value: Column) -> Column:
    """The host that a list's entry names, written alone or as a URL; null if there is none."""
    return host_of(F.when(value.contains("://"), value).otherwise(F.concat(F.lit("any://"), value)))


def scopes(host: Column) -> Column:
    """The host and its parent domains of two labels or more, most specific first; an address is its only scope."""
    labels = F.split(host, r"\.")
    count = F.when(host.rlike(ADDRESS), F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(value, since, until) of active spans, until excluded and null if open.

    Entries go by the hosts they name. Of one host and day a removal wins. Repeats change nothing;
    entries without a host or day, or of another action than add and remove, count for nothing.
    """
    clean = entries.select(entry_host(F.col("value")).alias("value"), "action", "day")
    clean = clean.where("value IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    clean = clean.groupBy("value", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("value").orderBy("day")
    spans = clean.withColumn("until", F.lead("day").over(order))
    return spans.where("action = 'add'").select("value", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each row of ``captures`` (page_id, url, fetched): host, listed, entry and since.

    Captures are folded to distinct (host, fetched) before the join, so that a host of a third of
    all captures is a few rows; values and days that many ask for are hot keys of both joins. No
    interval of a value meets another, so a scope gives one match at most. URLs without a host
    and captures without a date are not listed.
    """
    named = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"))
    whole = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    asked = named.where(whole).groupBy("host", "fetched").agg(F.count(F.lit(1)).alias("captures"))
    probes = asked.select("host", "fetched", F.posexplode(scopes(F.col("host"))).alias("depth", "value"))
    asks = probes.groupBy("value").agg(F.count(F.lit(1)).alias("asks"))
    # At most one interval a day: a value's list is as long as its history.
    lists = intervals(entries).groupBy("value").agg(F.collect_list(F.struct("since", "until")).alias("spans")).join(asks, "value")
    met = join_folded(probes, lists, "value", "asks", probes.count())
    active = F.filter("spans", lambda s: (F.col("fetched") >= s["since"]) & (s["until"].isNull() | (F.col("fetched") < s["until"])))
    met = met.withColumn("since", F.get(active, F.lit(0))["since"]).where("since IS NOT NULL")
    best = met.groupBy("host", "fetched").agg(F.min(F.struct("depth", "value", "since")).alias("b"))
    best = asked.join(best, ["host", "fetched"], "left").select("host", "fetched", "captures", F.col("b.value").alias("entry"), F.col("b.since").alias("since"))
    found = join_folded(named.where(whole), best, ["host", "fetched"], "captures", named.count()).drop("captures")
    none = named.where(~whole).select("*", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("date").alias("since"))
    return found.unionByName(none).select("page_id", "url", "host", "fetched", F.col("entry").isNotNull().alias("listed"), "entry", "since")


#: The given pages have no fetch dates and come without lists, so the query makes both from what
#: they hold: the day from the page's id, and entries from digests of the hosts.
FIRST_DAY, DAYS = "2024-01-01", 90


def _digit(value: Column, k: int) -> Column:
    """The k-th byte of the value's MD5."""
    return F.conv(F.substring(F.md5(value), 2 * k + 1, 2), 16, 10).cast("int")


def made_entries(captures: DataFrame) -> DataFrame:
    """(value, action, day): a quarter of the hosts and parent domains, added, mostly removed, some added again."""
    values = captures.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    values = values.select(F.explode(scopes(F.col("host"))).alias("value")).distinct().where(_digit(F.col("value"), 0) < 64)
    v = F.col("value")
    added = _digit(v, 1) % 60
    removed = added + 1 + _digit(v, 2) % 30
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n)
    events = F.array(
        F.struct(F.lit("add").alias("action"), day(added).alias("day")),
        F.when(_digit(v, 3) % 4 > 0, F.struct(F.lit("remove").alias("action"), day(removed).alias("day"))),
        F.when(_digit(v, 4) % 3 == 0, F.struct(F.lit("add").alias("action"), day(removed + 5).alias("day"))),
    )
    return values.select("value", F.explode(F.array_compact(events)).alias("e")).select("value", "e.action", "e.day")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int")))
    return judge(captures, made_entries(captures))


SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 90)::INT AS fetched,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)', 1), '\.+$', ''), '') AS host
  FROM pages
),
h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL),
s AS (SELECT host, i AS depth, array_to_string(l[i:], '.') AS value FROM h, LATERAL (SELECT unnest(range(1, CASE WHEN regexp_matches(host, '^(?:\[.*|[0-9]{1,3}(?:\.[0-9]{1,3}){3})$') THEN 2 ELSE greatest(len(l) - 1, 1) + 1 END)) AS i)),
d AS (
  SELECT value, ('0x' || substr(md5(value), 3, 2))::INT % 60 AS added, 1 + ('0x' || substr(md5(value), 5, 2))::INT % 30 AS kept,
    ('0x' || substr(md5(value), 7, 2))::INT % 4 AS r, ('0x' || substr(md5(value), 9, 2))::INT % 3 AS again
  FROM (SELECT DISTINCT value FROM s) WHERE ('0x' || substr(md5(value), 1, 2))::INT < 64
),
e AS (
  SELECT value, 'add' AS action, DATE '2024-01-01' + added AS day FROM d
  UNION ALL SELECT value, 'remove', DATE '2024-01-01' + (added + kept) FROM d WHERE r > 0
  UNION ALL SELECT value, 'add', DATE '2024-01-01' + (added + kept + 5) FROM d WHERE again = 0
),
i AS (SELECT *, lead(day) OVER (PARTITION BY value ORDER BY day) AS until FROM e),
m AS (
  SELECT p.page_id, s.depth, s.value, i.day FROM p JOIN s USING (host) JOIN i ON i.value = s.value AND i.action = 'add'
    AND p.fetched >= i.day AND (i.until IS NULL OR p.fetched < i.until)
),
b AS (SELECT page_id, arg_min(value, depth) AS entry, arg_min(day, depth) AS since FROM m GROUP BY page_id)
SELECT p.page_id, p.url, p.host, p.fetched, b.entry IS NOT NULL AS listed, b.entry, b.since FROM p LEFT JOIN b USING (page_id)
"""
