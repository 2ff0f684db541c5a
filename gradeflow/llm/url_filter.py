"""URL filter with dated lists, native: list entries become validity intervals, captures meet those in force when fetched.

An entry puts a domain (with its subdomains), a path prefix or a whole URL on the list, or takes it off, on a date. Each
capture is looked up by its host's domains, its path's prefixes and its URL, and an entry counts from its date until the next
entry of the same kind and key. Keys meet by an equi-join, so only rows whose key is listed go on, and the join of a key with
a third of all captures is one that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: By rank: of the entries in force the one with the highest kind, and then the longest key, is reported.
KINDS = ("domain", "prefix", "url")


def host_of(url: Column) -> Column:
    """Lower-case host without user and port, empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)


def path_of(url: Column) -> Column:
    """The path without query and fragment; an empty one is a slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, listed_from, listed_to, reason) of entries (kind, key, at, action, reason).

    action is add or remove; listed_to is exclusive, null for entries in force today. Of entries of one kind, key and
    date, adds win, then the least reason. Entries with a null kind, key or date are left out.
    """
    dated = entries.where("kind IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL").groupBy("kind", "key", "at").agg(F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"), F.min(F.when(F.col("action") == "add", F.col("reason"))).alias("reason"))
    own = Window.partitionBy("kind", "key").orderBy("at")
    return dated.withColumn("listed_to", F.lead("at").over(own)).where("on = 1").select("kind", "key", F.col("at").alias("listed_from"), "listed_to", "reason")


def _keys(url: Column, host: Column, path: Column, labels_listed: int, parts_listed: int) -> Column:
    """Structs (kind, key) under which a URL may be listed: no key has more labels or path segments than a listed one, so a
    very long path costs no more than the list's longest."""
    labels = F.split(host, r"\.")
    longest = F.least(F.size(labels), F.lit(labels_listed))
    last = lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("key"))
    domains = F.when(longest > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), longest)), last))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(parts_listed))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key")))
    whole = F.array(F.struct(F.lit("url").alias("kind"), url.alias("key")))
    return F.concat(F.coalesce(domains, F.slice(whole, 1, 0)), prefixes, whole)


def filter_urls(captures: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """page_id, url, fetched_at, blocked, kind, key, listed_from, reason of every capture.

    A prefix key is a host, a slash and whole path segments. A capture without a host or date is never blocked; repeated
    captures have repeated results. Other columns are ignored.
    """
    # two numbers of the list reach the driver: the most labels of a listed domain and segments of a listed prefix
    sizes = entries.agg(F.max(F.when(F.col("kind") == "domain", F.size(F.split("key", r"\.")))), F.max(F.when(F.col("kind") == "prefix", F.size(F.filter(F.split("key", "/"), lambda x: x != "")) - 1))).first()
    listed = (sizes[0] or 0, max(0, sizes[1] or 0))
    rows = captures.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(fetched_at).alias("fetched_at"))
    distinct = rows.where(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).distinct().drop("page_id").distinct()
    hosted = distinct.withColumn("host", host_of(F.col("url"))).where("host <> ''")
    looked_up = hosted.select("url", "fetched_at", F.explode(_keys(F.col("url"), F.col("host"), path_of(F.col("url")), *listed)).alias("k")).select("url", "fetched_at", "k.kind", "k.key")
    live = looked_up.join(intervals(entries), ["kind", "key"]).where((F.col("fetched_at") >= F.col("listed_from")) & (F.col("listed_to").isNull() | (F.col("fetched_at") < F.col("listed_to"))))
    rank = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.length("key"))
    best = live.groupBy("url", "fetched_at").agg(F.max_by(F.struct("kind", "key", "listed_from", "reason"), rank).alias("hit"))
    return rows.join(best, ["url", "fetched_at"], "left").select(
        "page_id", "url", "fetched_at", F.col("hit").isNotNull().alias("blocked"), F.col("hit.kind").alias("kind"), F.col("hit.key").alias("key"), F.col("hit.listed_from").alias("listed_from"), F.col("hit.reason").alias("reason")
    )


def keep_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures without those that an entry blocked when they were fetched; all columns stay, whatever their names."""
    at, when = fresh("at_url", captures), fresh("at_time", captures)
    rows = captures.select(F.lit(None).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(fetched_at).alias("fetched_at"))
    blocked = filter_urls(rows, entries).where("blocked").select(F.col("url").alias(at), F.col("fetched_at").alias(when)).distinct()
    return captures.join(blocked, (F.col(url) == F.col(at)) & (F.col(fetched_at) == F.col(when)), "left_anti")
