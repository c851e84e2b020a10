r"""Operator 4: URL filters by a temporal list join.

A list is dated entries (key, action, category, since): from ``since`` on, ``block`` or ``allow`` holds for the key
until its next entry, and ``remove`` ends what held.  Entries become validity intervals, and every capture is joined
as of its fetch time with the intervals of all its keys: each domain suffix of its host (``a.b.org``, ``b.org``,
``org``) and each path prefix (``a.b.org/x``, ``a.b.org/x/y``).  The longest key with an active entry decides.

Plan.  An equality join on the key with the interval as a further condition, so Spark broadcasts the list while it is
small and otherwise shuffles by key, where AQE splits the keys that many captures share (``com``).  Only the keys that
are in the list go on; with one row for each capture they meet in a grouped maximum, which is combined before its shuffle.

Defined results: of entries with equal key and time the first action in the alphabet holds.  Entries with a null key,
action or time are ignored; a null category stays null.  A capture with a null or malformed address or a null time is
not decided by any entry (``decision`` none).  A numeric address in brackets is a host of one label.  Repeated captures are one row.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(\[[0-9a-f:.]+\]|[^/:?#\[\]]+)(?::[0-9]*)?(/[^?#]*)?"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, category, start, end) with end null where the entry still holds."""
    known = entries.where("key IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL").groupBy(F.lower("key").alias("key"), F.col("since").alias("start")).agg(F.min(F.struct("action", "category")).alias("e"))
    by_time = Window.partitionBy("key").orderBy("start")
    return known.select("key", "start", F.lead("start").over(by_time).alias("end"), "e.action", "e.category").where("action <> 'remove'")


def keys(url: Column) -> Column:
    """All keys of an address, as an array; null for an address without a host."""
    # Scheme and host don't depend on case; paths are compared in lower case too, as lists are.
    host = F.nullif(F.regexp_extract(F.lower(url), PARTS, 1), F.lit(""))
    labels = F.when(F.startswith(host, F.lit("[")), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(F.lower(url), PARTS, 2), "/"), lambda x: x != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(domains, paths))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, decision, key, category) of each capture (page_id, url, fetched)."""
    spans = intervals(entries).withColumnRenamed("key", "k")
    each = captures.select(F.col("page_id"), F.col("url"), F.col("fetched"))
    active = (F.col("key") == F.col("k")) & (F.col("fetched") >= F.col("start")) & (F.col("end").isNull() | (F.col("fetched") < F.col("end")))
    hits = each.select("*", F.explode(keys(F.col("url"))).alias("key")).join(spans, active).select("page_id", "url", "fetched", F.struct(F.length("key").alias("n"), "key", "action", "category").alias("e"))
    every = hits.unionByName(each.withColumn("e", F.lit(None).cast(hits.schema["e"].dataType)))
    return every.groupBy("page_id", "url", "fetched").agg(F.max("e").alias("e")).select("page_id", "url", "fetched", F.coalesce("e.action", F.lit("none")).alias("decision"), "e.key", "e.category")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the table pages, which has no fetch time: one within 30 days is derived from page_id."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 7919 % 2592000).alias("fetched"))


def entries_of(captures: DataFrame) -> DataFrame:
    """A dated list for these captures, as the tables have none: hosts and first path parts, with times and actions from a digest of the key."""
    url = F.lower("url")
    host, part = F.regexp_extract(url, PARTS, 1), F.regexp_extract(url, r"://[^/?#]+/([^/?#]+)", 1)
    named = captures.select(F.explode(F.array(F.struct(host.alias("key")), F.struct(F.when(part != "", F.concat(host, F.lit("/"), part)).alias("key")))).alias("k")).select("k.key").where("key <> ''").distinct()
    n = F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("long")
    day = lambda d: F.timestamp_seconds(F.lit(1704067200) + d * 86400)
    entry = lambda when, action, since: F.when(when, F.struct(F.lit(action).alias("action"), F.concat(F.lit("list-"), (n % 4).cast("string")).alias("category"), day(since).alias("since")))
    listed = F.array(
        entry((n % 3 == 0) | F.col("key").rlike("casino|bets"), "block", n % 20), entry(n % 6 == 0, "remove", n % 20 + 3 + n % 5), entry(n % 7 == 0, "allow", n % 13)
    )
    return named.select("key", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("e")).select("key", "e.action", "e.category", "e.since")


SQL = rf"""WITH cap AS (SELECT DISTINCT page_id, url, TIMESTAMP '2024-01-01' + to_seconds(page_id * 7919 % 2592000) AS fetched, nullif(regexp_extract(lower(url), '{PARTS}', 1), '') AS host,
  list_filter(string_split(regexp_extract(lower(url), '{PARTS}', 2), '/'), lambda x: x <> '') AS parts, regexp_extract(lower(url), '://[^/?#]+/([^/?#]+)', 1) AS part FROM pages),
named AS (SELECT DISTINCT key FROM (SELECT host AS key FROM cap UNION ALL SELECT host || '/' || part FROM cap WHERE part <> '') WHERE key <> ''),
num AS (SELECT key, CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) AS n FROM named),
entries AS (SELECT key, 'list-' || (n % 4) AS category, unnest([CASE WHEN n % 3 = 0 OR regexp_matches(key, 'casino|bets') THEN {{'a': 'block', 'd': n % 20}} END, CASE WHEN n % 6 = 0 THEN {{'a': 'remove', 'd': n % 20 + 3 + n % 5}} END, CASE WHEN n % 7 = 0 THEN {{'a': 'allow', 'd': n % 13}} END]) AS e FROM num),
dated AS (SELECT key, TIMESTAMP '2024-01-01' + to_days(CAST(e.d AS INTEGER)) AS start, min(e.a) AS action, any_value(category) AS category FROM entries WHERE e IS NOT NULL GROUP BY 1, 2),
spans AS (SELECT *, lead(start) OVER (PARTITION BY key ORDER BY start) AS stop FROM dated),
keyed AS (SELECT page_id, url, fetched, unnest(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')), list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[:i], '/')))) AS key FROM cap WHERE host IS NOT NULL),
hit AS (SELECT page_id, url, fetched, max({{'n': length(key), 'key': key, 'action': action, 'category': category}}) AS e FROM keyed JOIN spans USING (key) WHERE action <> 'remove' AND fetched >= start AND (stop IS NULL OR fetched < stop) GROUP BY 1, 2, 3)
SELECT page_id, url, fetched, coalesce(e.action, 'none') AS decision, e.key AS key, e.category AS category FROM cap LEFT JOIN hit USING (page_id, url, fetched)"""
