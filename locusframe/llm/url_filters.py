"""URL filters as a temporal list join: dated list entries become validity intervals, and each capture meets those of its day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_BROADCAST = 200_000  # intervals; a longer list is joined by a shuffle
ADDRESS = r"^([0-9.]+|\[.*)$"


def host(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and final dot; empty if there is none. An address in brackets stays whole."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.$", "")


def suffixes(name: Column) -> Column:
    """A host and its parent domains of two labels or more; a host of one label and an IP address stand alone."""
    labels = F.split(name, r"\.")
    alone = (F.size(labels) < 3) | F.rlike(name, F.lit(ADDRESS))
    starts = F.when(name == "", F.array().cast("array<int>")).when(alone, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size(labels) - 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) from entries (pattern, category, listed_on date, action add or remove).

    An `add` holds from its day until the next later entry of its pattern and category, open-ended if there is none. Of several
    entries on one day, one `remove` makes the day a removal. Patterns are names of hosts in any case. Repeated entries count
    once; entries with a null pattern, day or other action are dropped, and a null category is the empty one.
    """
    usable = entries.where("pattern is not null and listed_on is not null and action in ('add', 'remove')")
    days = usable.groupBy(F.lower("pattern").alias("pattern"), F.coalesce("category", F.lit("")).alias("category"), "listed_on").agg(F.max("action").alias("action"))
    following = F.lead("listed_on").over(W.partitionBy("pattern", "category").orderBy("listed_on"))
    spans = days.withColumn("valid_to", following).where("action = 'add'")
    return spans.select("pattern", "category", F.col("listed_on").alias("valid_from"), "valid_to")


def url_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_on and others) with host, n_active (long), categories and blocked.

    A capture is blocked if an entry for its host or a parent domain is active on the day of fetching; categories are those
    entries' distinct categories, sorted and joined by commas. No host, a null url or a null day: not blocked. Every
    distinct host and day is looked up once, so a host with many captures costs no more; rows are never multiplied.
    Existing columns of those names are replaced. Empty captures give an empty result, and without entries nothing is blocked.
    """
    own = captures.drop("host", "n_active", "categories", "blocked").withColumn("host", host(F.col("url")))
    seen = own.select("host", "fetched_on").where("host <> '' and fetched_on is not null").distinct()
    intervals = validity(entries)
    if intervals.count() <= MOST_BROADCAST:
        intervals = F.broadcast(intervals)
    keyed = seen.withColumn("pattern", F.explode(suffixes(F.col("host"))))
    active = keyed.join(intervals, "pattern").where("valid_from <= fetched_on and (valid_to is null or fetched_on < valid_to)")
    found = active.groupBy("host", "fetched_on").agg(F.count("*").alias("n_active"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))
    out = own.join(found, ["host", "fetched_on"], "left")
    return out.select(
        *captures.drop("host", "n_active", "categories", "blocked").columns,
        "host",
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        F.col("n_active").isNotNull().alias("blocked"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages table as captures: fetched on a day of 2024 that page_id gives."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))


CATEGORIES = ("spam", "malware", "adult")


def page_list(pages: DataFrame) -> DataFrame:
    """Dated entries for a part of the hosts and domains of pages, by their md5: listed, removed, and some listed again."""
    names = pages.select(F.explode(suffixes(host(F.col("url")))).alias("pattern")).distinct()
    number = F.conv(F.substring(F.md5("pattern"), 1, 8), 16, 10).cast("long")
    picked = names.withColumn("k", number).where("k % 3 = 0")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.expr(c).cast("int"))
    category = F.get(F.array(*map(F.lit, CATEGORIES)), F.expr("cast(k div 3 % 3 as int)"))
    steps = F.array(
        F.struct(day("k % 200").alias("listed_on"), F.lit("add").alias("action")),
        F.struct(day("k % 200 + 30 + k div 7 % 60").alias("listed_on"), F.lit("remove").alias("action")),
        F.struct(day("k % 200 + 120 + k div 11 % 60").alias("listed_on"), F.lit("add").alias("action")),
    )
    kept = F.slice(steps, 1, F.expr("cast(1 + k div 5 % 3 as int)"))
    return picked.select("pattern", category.alias("category"), F.inline(kept))


ORACLE_SQL = r"""
WITH cap AS (SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched_on,
 regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)), '\.$', '') AS host FROM pages),
lab AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM cap),
suf AS (SELECT host, unnest([array_to_string(l[i:], '.') for i in range(1, CASE WHEN len(l) < 3 OR regexp_matches(host, '^([0-9.]+|\[.*)$') THEN 2 ELSE len(l) END)]) AS pattern
 FROM lab WHERE host <> ''),
pick AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS k FROM (SELECT DISTINCT pattern FROM suf)),
ent AS (SELECT pattern, ['spam', 'malware', 'adult'][(k // 3 % 3 + 1)::INTEGER] AS category, unnest([
 {'d': DATE '2024-01-01' + (k % 200)::INTEGER, 'a': 'add'},
 {'d': DATE '2024-01-01' + (k % 200 + 30 + k // 7 % 60)::INTEGER, 'a': 'remove'},
 {'d': DATE '2024-01-01' + (k % 200 + 120 + k // 11 % 60)::INTEGER, 'a': 'add'}][1:1 + k // 5 % 3]) AS s FROM pick WHERE k % 3 = 0),
spans AS (SELECT pattern, category, s.d AS listed_on, s.a AS action, lead(s.d) OVER (PARTITION BY pattern, category ORDER BY s.d) AS valid_to FROM ent),
act AS (SELECT c.page_id, s.category FROM cap c JOIN suf f ON c.host = f.host JOIN spans s ON f.pattern = s.pattern
 WHERE action = 'add' AND listed_on <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to))
SELECT c.page_id, c.host, strftime(c.fetched_on, '%Y-%m-%d') AS fetched_on, count(a.category)::BIGINT AS n_active,
 coalesce(string_agg(DISTINCT a.category, ',' ORDER BY a.category), '') AS categories, count(a.category) > 0 AS blocked
FROM cap c LEFT JOIN act a ON c.page_id = a.page_id GROUP BY c.page_id, c.host, c.fetched_on"""
