"""URL filter lists over time: dated list entries against captures as of their fetch.

Dated additions and removals of an entry become validity intervals; a capture is judged by the entries
that were valid when it was fetched. An entry names a host, a domain (with all below it) or a path
prefix; a capture's URL yields every key that could name it, so the match is an equality join on the
key with an as-of condition on the interval.

Keys that hold many captures are salted: a key is hot if it holds more than one part in
``4 * partitions`` of all key rows, so there are at most ``4 * partitions`` hot keys, and only these few
are broadcast.

Results for odd input: equal captures (id, url, time) give one row with their number in n_rows; a null
url or time matches nothing, at no time; a very long URL has keys for as many path segments as the deepest
list entry has; of list events at one instant a removal counts after an addition; repeated
events count once; unknown actions are ignored. Extra columns are ignored. Empty lists match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from artiscope.llm._scratch import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(events: DataFrame) -> DataFrame:
    """list_name, kind, entry, valid_from, valid_to (exclusive, null: open) from dated events (list_name, kind, entry, action, at)."""
    one = events.where("action in ('add', 'remove') and at is not null and entry is not null").select("list_name", "kind", F.lower("entry").alias("entry"), "action", "at").distinct()
    w = W.partitionBy("list_name", "kind", "entry").orderBy("at", "action")
    turns = one.withColumn("before", F.lag("action").over(w)).where("before is null or before <> action")
    spans = turns.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'")
    return spans.select("list_name", "kind", "entry", F.col("at").alias("valid_from"), "valid_to").where("valid_to is null or valid_to > valid_from")


def url_keys(url: str, depth: int) -> F.Column:
    """Array of (kind, key) that could name the URL in a list whose path prefixes have up to ``depth`` segments."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), lambda x: x != "")
    domains = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"))))
    prefixes = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.least(F.size(segments), F.lit(max(1, depth)))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("key"))))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    hosts = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")))
    return F.when(F.length(host) > 0, F.concat(hosts, F.coalesce(domains, none), F.coalesce(prefixes, none))).otherwise(none)


def _salts(keys: DataFrame) -> DataFrame:
    """Hot keys with their number of salts; at most four for each shuffle partition."""
    parts = 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = keys.groupBy("kind", "key").count()
    total = keys.groupBy().count().withColumnRenamed("count", "total")
    return counts.join(F.broadcast(total)).where(F.col("count") * parts > F.col("total")).select("kind", "key", F.ceil(F.col("count") * parts / F.col("total")).cast("int").alias("salts"))


def evaluate(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row for each distinct capture.

    n_active and n_ever: entries that match at the fetch, and at any time; matched: the active ones as
    list/kind/entry, sorted and joined by spaces; blocked: an active block entry is more specific (prefix,
    then host, then domain) than every active allow entry.
    """
    one = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("at")).groupBy("id", "url", "at").agg(F.count("*").alias("n_rows"))
    deepest = events.where("kind = 'prefix'").agg(F.max(F.size(F.split("entry", "/")) - 1)).first()[0] or 1
    keys = one.where("at is not null").select("id", "url", "at", F.inline(url_keys("url", deepest)))
    salts = F.broadcast(_salts(keys))
    dealt = keys.join(salts, ["kind", "key"], "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "url", "at"), F.col("salts"))).cast("int"))
    valid = intervals(events).withColumnRenamed("entry", "key").join(salts, ["kind", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    rank = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    active = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    hits = dealt.drop("salts").join(valid.drop("salts"), ["kind", "key", "salt"]).withColumn("active", F.coalesce(active, F.lit(False))).withColumn("name", F.concat_ws("/", "list_name", "kind", "key"))
    found = hits.groupBy("id", "url", "at").agg(
        F.countDistinct(F.when(F.col("active"), F.col("name"))).alias("n_active"),
        F.countDistinct("name").alias("n_ever"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("active"), F.col("name")))), " ").alias("matched"),
        F.max(F.when(F.col("active") & (F.col("list_name") == "block"), rank)).alias("block_rank"),
        F.max(F.when(F.col("active") & (F.col("list_name") == "allow"), rank)).alias("allow_rank"),
    )
    c, f = one.alias("c"), found.alias("f")
    return c.join(f, F.col("c.id").eqNullSafe(F.col("f.id")) & (F.col("c.url") == F.col("f.url")) & F.col("c.at").eqNullSafe(F.col("f.at")), "left").select(
        F.col("c.id").alias(id_col),
        F.col("c.url").alias(url_col),
        F.col("c.at").alias(time_col),
        F.col("c.n_rows").alias("n_rows"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("n_ever", F.lit(0)).cast("long").alias("n_ever"),
        F.coalesce("matched", F.lit("")).alias("matched"),
        (F.coalesce("block_rank", F.lit(-1)) > F.coalesce("allow_rank", F.lit(-1))).alias("blocked"),
    )


def fetch_times(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in 2024, made from the page's number (the table has none)."""
    seconds = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("long") % 31_536_000
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + seconds).alias("fetched_at"))


def list_feed(pages: DataFrame) -> DataFrame:
    """A dated feed made from the hosts of the pages: of each third host the history of its host, domain or first path."""
    site = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), F.lower(F.regexp_extract("url", PATH, 1)).alias("path")).where("host <> ''").groupBy("host").agg(F.min("path").alias("path"))
    n = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    segment = F.element_at(F.split(F.concat(F.col("path"), F.lit("/")), "/"), 2)
    site = site.withColumn("n", n).withColumn("seg", segment).where("n % 3 = 0")
    kind = F.when(F.col("n") % 5 < 2, "host").when((F.col("n") % 5 == 2) | (F.col("seg") == ""), "domain").otherwise("prefix")
    entry = F.when(F.col("kind") == "prefix", F.concat_ws("/", "host", "seg")).when(F.col("kind") == "domain", F.regexp_replace("host", r"^[^.]*\.([^.]*\.[^.]*\..*)$", "$1")).otherwise(F.col("host"))
    site = site.withColumn("kind", kind).withColumn("entry", entry).withColumn("list_name", F.when(F.col("n") % 7 == 0, "allow").otherwise("block"))
    day = lambda by: F.timestamp_seconds(F.lit(1_704_067_200) + by * 86_400)
    steps = F.array(F.struct(F.lit("add").alias("action"), day(F.col("n") % 200).alias("at")), F.struct(F.lit("remove").alias("action"), day(F.col("n") % 200 + 1 + F.col("n") % 61).alias("at")), F.struct(F.lit("add").alias("action"), day(F.lit(270) + F.col("n") % 90).alias("at")))
    return site.select("list_name", "kind", "entry", F.inline(steps))


def op9_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(fetch_times(pages), list_feed(pages))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, make_timestamp((1704067200 + CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS BIGINT) % 31536000) * 1000000) AS ts,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) AS path FROM pages),
site AS (
  SELECT host, n, string_split(path || '/', '/')[2] AS seg FROM (
    SELECT host, min(path) AS path, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS n FROM p WHERE host <> '' GROUP BY host) WHERE n % 3 = 0),
feed AS (
  SELECT CASE WHEN n % 7 = 0 THEN 'allow' ELSE 'block' END AS list_name,
         CASE WHEN n % 5 < 2 THEN 'host' WHEN n % 5 = 2 OR seg = '' THEN 'domain' ELSE 'prefix' END AS kind, host, seg, n FROM site),
entries AS (
  SELECT list_name, kind, CASE kind WHEN 'prefix' THEN host || '/' || seg WHEN 'domain' THEN regexp_replace(host, '^[^.]*\.([^.]*\.[^.]*\..*)$', '\1') ELSE host END AS entry, n FROM feed),
events AS (
  SELECT DISTINCT list_name, kind, entry, action, make_timestamp((1704067200 + d * 86400) * 1000000) AS ts FROM (
    SELECT list_name, kind, entry, 'add' AS action, n % 200 AS d FROM entries UNION ALL
    SELECT list_name, kind, entry, 'remove', n % 200 + 1 + n % 61 FROM entries UNION ALL
    SELECT list_name, kind, entry, 'add', 270 + n % 90 FROM entries)),
turns AS (
  SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY list_name, kind, entry ORDER BY ts, action) AS prev FROM events) WHERE prev IS NULL OR prev <> action),
spans AS (
  SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY list_name, kind, entry ORDER BY ts, action) AS gone FROM turns)
  WHERE action = 'add' AND (gone IS NULL OR gone > ts)),
cap AS (SELECT page_id, url, ts, host, path, count(*) AS n_rows FROM p GROUP BY ALL),
hits AS (
  SELECT c.page_id, c.url, c.ts, s.list_name, s.list_name || '/' || s.kind || '/' || s.entry AS name,
         CASE s.kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END AS rank, c.ts >= s.ts AND (s.gone IS NULL OR c.ts < s.gone) AS active
  FROM cap c JOIN spans s ON
    (s.kind = 'host' AND s.entry = c.host) OR (s.kind = 'domain' AND ('.' || c.host) LIKE '%.' || s.entry)
    OR (s.kind = 'prefix' AND (c.host || c.path || '/') LIKE s.entry || '/%')),
found AS (
  SELECT page_id, url, ts, count(DISTINCT name) FILTER (active) AS n_active, count(DISTINCT name) AS n_ever,
         string_agg(DISTINCT name, ' ' ORDER BY name) FILTER (active) AS matched,
         max(rank) FILTER (active AND list_name = 'block') AS b, max(rank) FILTER (active AND list_name = 'allow') AS a FROM hits GROUP BY ALL)
SELECT page_id, url, ts AS fetched_at, n_rows, coalesce(n_active, 0) AS n_active, coalesce(n_ever, 0) AS n_ever, coalesce(matched, '') AS matched,
       coalesce(b, -1) > coalesce(a, -1) AS blocked
FROM cap LEFT JOIN found USING (page_id, url, ts)
"""

QUERIES = {"op9_url_list_asof": op9_url_list_asof}
ORACLE_SQL = {"op9_url_list_asof": ORACLE}
