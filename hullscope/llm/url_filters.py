"""URL filters as a temporal list join, in DataFrame functions only.

A block list is a log of dated entries (key, action 'add' or 'remove', day). Each entry's log becomes validity
intervals: an event holds from its day until the entry's next event. A capture is judged by the list as it stood when
it was fetched: for each key of its URL (every parent domain, and host with first path segment) the event as of that
day must be an 'add'.

The list's intervals are a broadcast side only up to BROADCAST_ROWS, counted first; beyond that the join shuffles on
the key and adaptive execution splits hot hosts. Captures meet again in a partial aggregate, so one small row a capture
is shuffled.

Defined cases: a null or malformed URL has no host, no keys, and isn't blocked. A capture that repeats key, URL and
time is one capture. Of events of one entry on one day 'remove' wins. Null keys, actions or days of list rows are
ignored. Extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BROADCAST_ROWS = 50_000
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)"
FIRST_DAY = "2024-01-01"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"\.+$", "")


def url_keys(url: Column) -> Column:
    """'d:' with every domain of two labels or more that the host is in, and 'p:' with host and first path segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.when(
        F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    ).otherwise(F.array().cast("array<string>"))
    segment = F.coalesce(F.regexp_extract(url, SEGMENT, 1), F.lit(""))
    prefix = F.when((host != "") & (segment != ""), F.array(F.concat(F.lit("p:"), host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.concat(domains, prefix)


def intervals(log: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to) for each time that an entry was on the list; valid_to is exclusive, null if open."""
    events = log.where("key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')").groupBy("key", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key").orderBy("day")
    return events.withColumn("valid_to", F.lead("day").over(w)).where("action = 'add'").select("key", F.col("day").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, log: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """page_id, url, fetched, host, blocked, n_entries (active entries that match), entry (least of them), listed_since."""
    active = written(intervals(log), "list-intervals")
    if active.count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    rows = captures.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(fetched).alias("fetched"))
    rows = rows.select("*", F.explode_outer(url_keys(F.col("url"))).alias("own"))
    on = (F.col("own") == F.col("key")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    found = rows.join(active, on, "left").groupBy("page_id", "url", "fetched").agg(F.count_distinct("key").alias("n_entries"), F.min("key").alias("entry"), F.min("valid_from").alias("listed_since"))
    return found.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"), (F.col("n_entries") > 0).alias("blocked"), "n_entries", "entry", "listed_since")


def hex_mod(text: Column, start: int, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), start, 4), 16, 10).cast("bigint"), F.lit(modulus))


def example_log(pages: DataFrame) -> DataFrame:
    """A dated list from the pages' own keys, by a rule on each key's MD5: about one key in six is listed on some day of
    2024, most of them are removed later, and some of these come back."""
    keys = pages.select(F.explode(F.array_distinct(url_keys(F.col("url")))).alias("key")).distinct().where(hex_mod(F.col("key"), 1, 6) == 0)
    k = F.col("key")
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    first, length, gap = hex_mod(k, 5, 200), 20 + hex_mod(k, 9, 100), 10 + hex_mod(k, 13, 60)
    event = lambda action, n, when: F.when(when, F.struct(F.lit(action).alias("action"), day(n).alias("day")))
    events = F.array(event("add", first, F.lit(True)), event("remove", first + length, hex_mod(k, 17, 4) > 0), event("add", first + length + gap, hex_mod(k, 17, 4) > 1))
    return keys.select("key", F.explode(events).alias("e")).where("e IS NOT NULL").select("key", "e.action", "e.day")


def op6_rows(pages: DataFrame) -> DataFrame:
    """Every page as a capture; the table has no fetch time, so it is taken from page_id: a day of 2024."""
    captures = pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))
    return judged(captures, example_log(pages)).withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd")).withColumn("listed_since", F.date_format("listed_since", "yyyy-MM-dd"))


def _hex(start: int, modulus: int) -> str:
    return f"(CAST('0x' || substr(md5(key), {start}, 4) AS BIGINT) % {modulus})"


OP6_SQL = rf"""WITH cap AS (SELECT DISTINCT page_id, url, DATE '{FIRST_DAY}' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched,
  regexp_replace(lower(coalesce(regexp_extract(url, '{HOST}', 1), '')), '\.+$', '') AS host, coalesce(regexp_extract(url, '{SEGMENT}', 1), '') AS seg FROM pages),
lab AS (SELECT *, string_split(host, '.') AS l FROM cap),
ks AS (SELECT page_id, url, fetched, 'd:' || array_to_string(l[i:], '.') AS key FROM lab, range(1, 128) r(i) WHERE i < len(l)
  UNION SELECT page_id, url, fetched, 'p:' || host || '/' || seg FROM lab WHERE host <> '' AND seg <> ''),
own AS (SELECT DISTINCT key FROM ks WHERE {_hex(1, 6)} = 0),
p AS (SELECT key, {_hex(5, 200)} AS a, 20 + {_hex(9, 100)} AS b, 10 + {_hex(13, 60)} AS c, {_hex(17, 4)} AS d FROM own),
log AS (SELECT key, 'add' AS action, a AS day FROM p UNION ALL SELECT key, 'remove', a + b FROM p WHERE d > 0 UNION ALL SELECT key, 'add', a + b + c FROM p WHERE d > 1),
ev AS (SELECT key, DATE '{FIRST_DAY}' + CAST(day AS INTEGER) AS day, max(action) AS action FROM log GROUP BY ALL),
iv AS (SELECT key, action, day AS valid_from, lead(day) OVER (PARTITION BY key ORDER BY day) AS valid_to FROM ev),
hit AS (SELECT ks.page_id, ks.url, ks.fetched, count(DISTINCT ks.key) AS n, min(ks.key) AS entry, min(valid_from) AS since FROM ks JOIN iv ON ks.key = iv.key AND action = 'add' AND ks.fetched >= valid_from AND (valid_to IS NULL OR ks.fetched < valid_to) GROUP BY ALL)
SELECT cap.page_id, cap.url, strftime(cap.fetched, '%Y-%m-%d') AS fetched, host, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_entries, entry, strftime(since, '%Y-%m-%d') AS listed_since
FROM cap LEFT JOIN hit ON cap.page_id IS NOT DISTINCT FROM hit.page_id AND cap.url IS NOT DISTINCT FROM hit.url AND cap.fetched IS NOT DISTINCT FROM hit.fetched"""
