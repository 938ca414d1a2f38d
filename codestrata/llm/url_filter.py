"""URL filters by a temporal list join.

A list is a log of dated changes (kind, entry, action, at). Per entry, changes become validity intervals
[from, to): a repeated action changes nothing, of changes on one day the removal counts. A capture (url, day)
is looked up under every key that could list it: its host, each domain the host lies in, and each path prefix
that ends at a slash; an equi-join on (kind, entry) whose interval holds the capture's day is the as-of join.

The keys of a capture are as many as its labels and path segments. A common host makes a hot join key with few
intervals behind it; the join is a plain equi-join, which adaptive execution splits, and it is a broadcast join
while the list is small. Captures are taken apart where they are read, and what belongs to one is put together before
the one shuffle that counts equal captures.

Dirty input. A null or unparsable URL has no keys and is never blocked. Schemes and hosts are lower-cased,
ports and user names dropped, query and fragment don't take part. Captures with a null day match nothing.
List rows with a null kind, entry, action or day are ignored, as are actions other than add and remove.
Repeated captures are one row with their number; an empty list blocks nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, AUTHORITY, 1)), F.lit(""))


def intervals(log: DataFrame) -> DataFrame:
    """(kind, entry, valid_from, valid_to) of a change log; an open interval has a null end."""
    days = (
        log.where("kind is not null and entry is not null and at is not null and action in ('add', 'remove')")
        .groupBy("kind", "entry", "at")
        .agg(F.min(F.col("action") == "add").alias("on"))
    )
    own = Window.partitionBy("kind", "entry").orderBy("at")
    turns = days.withColumn("was", F.coalesce(F.lag("on").over(own), F.lit(False))).where(F.col("on") != F.col("was"))
    return turns.withColumn("valid_to", F.lead("at").over(own)).where("on").select("kind", "entry", F.col("at").alias("valid_from"), "valid_to")


def keys(url: Column) -> Column:
    """array<struct<kind, entry>> under which a URL can be listed."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    entry = lambda kind, e: F.struct(F.lit(kind).alias("kind"), e.alias("entry"))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: entry("domain", F.array_join(F.slice(labels, i, n), ".")))
    parts = F.split(F.regexp_extract(url, PATH, 1), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: entry("prefix", F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), F.lit("/")).otherwise(F.lit(""))))
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(entry("host", host)), domains, prefixes)))


def evaluate(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, url, day, captures, blocked, entries, first_entry, since) for (page_id, url, day) rows.

    ``entries``: active entries that match; ``first_entry``: the smallest, as kind:entry; ``since``: the
    earliest day from which one of them is active. Intervals of an entry must not overlap; those of ``intervals`` don't.
    """
    looked = captures.select("page_id", "url", "day", F.posexplode_outer(keys(F.col("url"))).alias("nth", "k")).select("page_id", "url", "day", "nth", F.col("k.kind").alias("ck"), F.col("k.entry").alias("ce"))
    hit = looked.join(
        listed, (F.col("ck") == F.col("kind")) & (F.col("ce") == F.col("entry")) & (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))), "left"
    )
    # Each capture has one row of its first key, or one without a key; equal captures have equal hits.
    return hit.groupBy("page_id", "url", "day").agg(
        F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("captures"),
        (F.count("entry") > 0).alias("blocked"),
        F.expr("count(entry) div count_if(coalesce(nth, 0) = 0)").alias("entries"),
        F.min(F.concat("kind", F.lit(":"), "entry")).alias("first_entry"),
        F.min("valid_from").alias("since"),
    )


def stand_in_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch days; a page's id stands in for one, over the year 2024."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(366)).cast("int")).alias("day"))


def stand_in_log(captures: DataFrame) -> DataFrame:
    """A change log over the hosts that occur: of 16 hosts 6 are listed (by hash), for 30 to 285 days, some again
    60 days later; as host, as path prefix host/en/, or, with four labels or more, as the last three labels."""
    h = F.col("host")
    x = F.md5(h.cast("binary"))
    hexed = lambda at, n: F.conv(F.substring(x, at, n), 16, 10).cast("int")
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    day0 = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(hexed(2, 3), F.lit(366)))
    labels = F.split(h, r"\.")
    kind = F.when(F.size(labels) >= 4, "domain").when(hexed(7, 1) < 8, "host").otherwise("prefix")
    entry = F.when(F.size(labels) >= 4, F.array_join(F.slice(labels, -3, 3), ".")).when(hexed(7, 1) < 8, h).otherwise(F.concat(h, F.lit("/en/")))
    end = F.date_add(day0, F.lit(30) + hexed(5, 2))
    change = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    changes = F.concat(F.array(change("add", day0), change("remove", end)), F.when(hexed(8, 1) < 4, F.array(change("add", F.date_add(end, 60)))).otherwise(F.slice(F.array(change("add", end)), 2, 1)))
    return hosts.where(hexed(1, 1) < 6).select(kind.alias("kind"), entry.alias("entry"), F.explode(changes).alias("c")).select("kind", "entry", "c.action", "c.at")


def op5_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = stand_in_captures(spark, sf_dir)
    return evaluate(captures, intervals(stand_in_log(captures)))


OP5_SQL = r"""
    WITH cap AS (
        SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(((coalesce(page_id, 0) % 366) + 366) % 366 AS INTEGER) AS DATE) AS day,
               nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
        FROM pages),
    x AS (SELECT host, md5(host) AS x, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL)),
    h AS (SELECT host, l, CAST('0x' || x[1:1] AS INTEGER) AS a, CAST('0x' || x[2:4] AS INTEGER) AS b, CAST('0x' || x[5:6] AS INTEGER) AS c,
                 CAST('0x' || x[7:7] AS INTEGER) AS d, CAST('0x' || x[8:8] AS INTEGER) AS e FROM x),
    ent AS (SELECT CASE WHEN len(l) >= 4 THEN 'domain' WHEN d < 8 THEN 'host' ELSE 'prefix' END AS kind,
                   CASE WHEN len(l) >= 4 THEN array_to_string(l[-3:], '.') WHEN d < 8 THEN host ELSE host || '/en/' END AS entry,
                   DATE '2024-01-01' + b % 366 AS day0, DATE '2024-01-01' + b % 366 + 30 + c AS fin, e FROM h WHERE a < 6),
    log AS (SELECT kind, entry, 'add' AS action, day0 AS d FROM ent UNION ALL SELECT kind, entry, 'remove', fin FROM ent
            UNION ALL SELECT kind, entry, 'add', fin + 60 FROM ent WHERE e < 4),
    days AS (SELECT kind, entry, d, (max(action) = 'add') AS is_on FROM log GROUP BY kind, entry, d),
    turns AS (SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY kind, entry ORDER BY d), false) AS was FROM days) WHERE is_on <> was),
    iv AS (SELECT * FROM (SELECT kind, entry, d AS valid_from, lead(d) OVER (PARTITION BY kind, entry ORDER BY d) AS valid_to, is_on FROM turns) WHERE is_on),
    once AS (SELECT page_id, url, day, any_value(host) AS host, any_value(path) AS path, count(*) AS captures FROM cap GROUP BY page_id, url, day),
    ks AS (
        SELECT page_id, url, day, 'host' AS kind, host AS entry FROM once WHERE host IS NOT NULL
        UNION SELECT page_id, url, day, 'domain', array_to_string(string_split(host, '.')[i:], '.')
              FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM once WHERE host IS NOT NULL)
        UNION SELECT page_id, url, day, 'prefix', host || array_to_string(string_split(path, '/')[:i], '/') || CASE WHEN i < len(string_split(path, '/')) THEN '/' ELSE '' END
              FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM once WHERE host IS NOT NULL)),
    hits AS (SELECT ks.page_id, ks.url, ks.day, ks.kind, ks.entry, valid_from FROM ks JOIN iv ON ks.kind = iv.kind AND ks.entry = iv.entry AND ks.day >= valid_from AND (valid_to IS NULL OR ks.day < valid_to))
    SELECT o.page_id, o.url, o.day, any_value(o.captures) AS captures, count(hits.entry) > 0 AS blocked, count(hits.entry) AS entries,
           min(hits.kind || ':' || hits.entry) AS first_entry, CAST(min(valid_from) AS DATE) AS since
    FROM once o LEFT JOIN hits ON o.page_id IS NOT DISTINCT FROM hits.page_id AND o.url IS NOT DISTINCT FROM hits.url AND o.day IS NOT DISTINCT FROM hits.day
    GROUP BY o.page_id, o.url, o.day
"""
