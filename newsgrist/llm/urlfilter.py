"""URL filters over time: a dated list as validity intervals, joined as of each capture.

List entries say that a host (and everything below it) or a URL prefix was put on or taken
off a list at a time. Consecutive entries of a key become intervals. A capture is checked
against the entries that were active when it was fetched. Columns only: no Python runs on
the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrist.functions.skew import salt_of

SALTS = 64


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and a final dot; null if
    there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of an absolute URL, '/' if it has none; without query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path != "", path).otherwise(F.lit("/"))


def keys_of(url: Column) -> Column:
    """All keys that may list a URL: its host and the domains above it of two labels at
    least, and the host with each leading part of its path."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, "[.]")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(labels, k, n), "."),
    )
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")),
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes))).otherwise(
        F.array().cast("array<string>")
    )


def intervals(entries: DataFrame) -> DataFrame:
    """``list, key, valid_from, valid_to`` from ``list, key, at, listed``.

    Of entries of one list and key at the same time, ``listed`` wins. Entries that change
    nothing are merged; an interval without an end has a null ``valid_to``. Entries with a
    null key, time or state are passed over.
    """
    known = entries.where("key is not null and at is not null and listed is not null")
    once = known.groupBy("list", "key", "at").agg(F.max("listed").alias("listed"))
    in_time = Window.partitionBy("list", "key").orderBy("at")
    turns = once.withColumn("before", F.lag("listed").over(in_time)).where(
        "before is null and listed or before <> listed"
    )
    spans = turns.withColumn("valid_to", F.lead("at").over(in_time))
    return spans.where("listed").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``capture_id, url, fetched_at, blocked, n_lists, lists, keys`` for every capture
    (``capture_id, url, fetched_at``): the lists and keys active at its time.

    The as-of join is one pass in time order over each (key, salt): an interval's start and
    end carry forward to the captures after them. Interval rows are copied only to salts
    that hold captures of their key, so a host with a third of all captures is many small
    groups. A capture at the very start of an interval is inside, one at its end outside.
    Captures without a time, url or host are not blocked. Repeated rows give repeated
    results, named inside by a 128-bit hash of the row.
    """
    spans = intervals(entries)
    base = captures.select("capture_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    # Repeated captures have equal answers: each is asked once and joined back.
    name = F.unhex(F.md5(F.to_json(F.struct("capture_id", "url", F.unix_micros("fetched_at").alias("at"))).cast("binary")))
    asked = base.where("fetched_at is not null and url is not null").distinct().withColumn("capture", name)
    probes = asked.select("capture", "fetched_at", F.explode(keys_of(F.col("url"))).alias("key"))
    # Keys on no list need no pass in time; a capture asks each list that has its key.
    listed = spans.groupBy("key").agg(F.collect_set("list").alias("lists"))
    probes = probes.withColumn("salt", salt_of("capture", SALTS)).repartition("key", "salt")
    pairs = probes.select("key", "salt").distinct().join(listed, "key")
    changes = spans.select("list", "key", F.inline(F.array(
        F.struct(F.col("valid_from").alias("at"), F.lit(True).alias("on")), F.struct(F.col("valid_to").alias("at"), F.lit(False).alias("on")),
    ))).where("at is not null")
    marks = changes.join(pairs, "key").select(
        "key", "salt", "at", F.lit(0).alias("kind"), "list", "on", F.lit(None).cast("binary").alias("capture")
    )
    questions = probes.join(pairs, ["key", "salt"]).select(
        "key", "salt", F.col("fetched_at").alias("at"), F.lit(1).alias("kind"), F.explode("lists").alias("list"),
        F.lit(None).cast("boolean").alias("on"), "capture",
    )
    as_of = Window.partitionBy("key", "salt", "list").orderBy("at", "kind", "on").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = marks.unionByName(questions).withColumn("active", F.last("on", ignorenulls=True).over(as_of))
    hits = answered.where("kind = 1 and active").groupBy("capture").agg(
        F.sort_array(F.collect_set("list")).alias("lists"), F.sort_array(F.collect_set("key")).alias("keys")
    )
    out = base.withColumn("capture", name).join(hits, "capture", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "capture_id", "url", "fetched_at", F.col("lists").isNotNull().alias("blocked"),
        F.coalesce(F.size("lists"), F.lit(0)).cast("bigint").alias("n_lists"),
        F.coalesce("lists", none).alias("lists"), F.coalesce("keys", none).alias("keys"),
    )
