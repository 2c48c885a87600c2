"""Landed payloads derived from the driver's tables, for the source scans.

Each payload holds a fixed number of records, so building one never gathers more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgrist.functions.text import escape_markup
from newsgrist.plans.testbed import NOW, after_base, at_rest, table

FEED_ITEMS, FEED_CAP = 20, 15
STORY_IDS, STORY_CAP = 500, 400
REPO_ITEMS, REPO_CAP = 20, 15


def _settings(names: DataFrame, kind: str, cap: int, **extra: Column) -> DataFrame:
    """Source settings for ``names`` (source, source_rank)."""
    fields = {"categories": F.array(F.lit("landed")), "story_feed": F.lit("new"),
              "queries": F.array().cast("array<string>"), **extra}
    return names.select(
        "source_rank", F.lit(kind).alias("kind"), F.col("source").alias("name"),
        (F.col("source_rank") % 6 != 3).alias("enabled"), F.lit(cap).alias("max_items"),
        F.lit("https://feeds.example.com/").alias("url"),
        *[c.alias(n) for n, c in fields.items()],
    )


def _response(rows: DataFrame, kind: str, query: Column, status: Column) -> DataFrame:
    return rows.select(
        "source", F.lit(kind).alias("kind"), query.cast("string").alias("query"),
        status.cast("int").alias("http_status"), F.lit(NOW).cast("timestamp").alias("fetched_at"),
        "body",
    )


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def feed_payloads(spark: SparkSession, sf_dir: str, *, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """(payloads, sources): a feed per 20 documents, RSS or Atom by turns; ``skip`` leaves out
    the first entries of each, as a later fetch would.

    By bucket number: 4 mod 5 breaks off after three entries, 9 mod 10 has none at all,
    7 mod 10 is a server error. Every document with 5 mod 11 has a blank title.
    """
    doc = F.col("doc_id")
    bucket = F.floor(doc / F.lit(FEED_ITEMS))
    docs = table(spark, sf_dir, "documents").select(
        doc,
        bucket.cast("int").alias("source_rank"),
        F.when(doc % 11 == 5, F.lit("  ")).otherwise(F.substring_index("text", "\n", 1)).alias("t"),
        F.col("text").alias("d"),
        F.col("lang").alias("g"),
        F.concat(F.lit("https://news.example.com/d/"), doc.cast("string")).alias("u"),
        after_base(doc, 60).alias("at"),
    )
    e = {c: escape_markup(F.col(c)) for c in ("t", "d", "u", "g")}
    ident = doc.cast("string")
    # Feeds that break off name their author under a prefix nothing declares, after a section
    # that only looks like the end of an item.
    broken = F.col("source_rank") % 5 == 4
    author = F.when(broken, F.concat(F.lit('<pub:note my:kind="a"><![CDATA[</item>]]></pub:note>'), _tag("pub:creator", e["g"])))
    rss = _tag("item", F.concat(
        _tag("title", e["t"]), _tag("link", e["u"]), _tag("description", e["d"]),
        F.coalesce(author, _tag("dc:creator", e["g"])),
        _tag("pubDate", F.concat(F.date_format("at", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))),
        _tag("guid", ident), _tag("category", e["g"]),
    ))
    atom = _tag("entry", F.concat(
        _tag("title", e["t"]),
        F.concat(F.lit('<link rel="self" href="x"/><link rel="alternate" href="'), e["u"], F.lit('"/>')),
        _tag("id", ident), _tag("updated", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _tag("summary", e["d"]), _tag("author", _tag("name", e["g"])),
        F.concat(F.lit('<category term="'), e["g"], F.lit('"/>')),
    ))
    odd = F.col("source_rank") % 2 == 1
    items = docs.select("source_rank", "doc_id", F.when(odd, atom).otherwise(rss).alias("x"))
    packed = items.groupBy("source_rank").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "x"))).alias("all")
    )
    rank = F.col("source_rank")
    texts = F.transform(F.slice("all", skip + 1, FEED_ITEMS), lambda i: i["x"])
    shown = F.when(rank % 10 == 9, F.slice(texts, 1, 0)).when(
        rank % 5 == 4, F.slice(texts, 1, 3)
    ).otherwise(texts)
    cut = F.when(rank % 5 == 4, F.lit("<item><title>cut")).otherwise(
        F.when(odd, F.lit("</feed>")).otherwise(F.lit("</channel></rss>"))
    )
    head = F.when(odd, F.lit('<feed xmlns="http://www.w3.org/2005/Atom">')).otherwise(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>f</title>')
    )
    named = packed.select(
        F.concat(F.lit("feed-"), rank.cast("string")).alias("source"), "source_rank",
        F.concat(head, F.array_join(shown, ""), cut).alias("body"),
    )
    status = F.when(rank % 10 == 7, 500).otherwise(200)
    names = docs.select("source_rank").distinct().select(
        F.concat(F.lit("feed-"), rank.cast("string")).alias("source"), "source_rank"
    )
    return _response(named, "feed", F.lit(None), status), _settings(names, "feed", FEED_CAP)


SHIFT = 2


def feed_twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every feed landed twice, an hour apart, the second time without its first entries,
    and the feeds of even number landed a third time with the first body."""
    first, sources = feed_payloads(spark, sf_dir)
    later, _ = feed_payloads(spark, sf_dir, skip=SHIFT)
    later = later.withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 1 hour"))
    again = first.where("cast(substring(source, 6) as int) % 2 = 0")
    return first.unionByName(later).unionByName(again), sources


def story_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, sources): an id list per 500 events and a payload per event.

    Every 17th item is missing; error events are comments, users 0 mod 13 deleted; every
    19th title is a number; list 5 mod 7 is not a list.
    """
    event, user = F.col("event_id"), F.col("user_id")
    rank = F.floor(event / F.lit(STORY_IDS)).cast("int").alias("source_rank")
    source = F.concat(F.lit("stories-"), F.col("source_rank").cast("string")).alias("source")
    events = table(spark, sf_dir, "events").withColumn("source_rank", rank).withColumn("source", source)
    ids = events.groupBy("source", "source_rank").agg(
        F.to_json(F.array_sort(F.collect_list("event_id"))).alias("ids")
    )
    lists = ids.select(
        "source",
        F.when(F.col("source_rank") % 7 == 5, F.lit('{"ids": 1}')).otherwise(F.col("ids")).alias("body"),
    )
    name = F.concat_ws(" ", "event_type", user.cast("string"))
    title = F.when(event % 19 == 3, user.cast("string")).otherwise(
        F.concat(F.lit('"'), name, F.lit('"'))
    )
    url = F.concat(F.lit("https://e.example.org/"), user.cast("string"), F.lit("?k="), F.get_json_object("props", "$.k"))
    kind = F.when(F.col("event_type") == "error", "comment").otherwise("story")
    body = F.concat(
        F.lit('{"id":'), event.cast("string"), F.lit(',"type":"'), kind,
        F.lit('","by":"u'), user.cast("string"), F.lit('","time":'),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"),
        F.lit(',"title":'), title, F.lit(',"url":"'), url,
        F.lit('","score":'), F.floor("value").cast("string"),
        F.lit(',"deleted":'), F.when(user % 13 == 0, "true").otherwise("1"), F.lit("}"),
    )
    items = events.where(event % 17 != 0).select("source", event.alias("query"), body.alias("body"))
    ok = F.lit(200)
    payloads = _response(lists, "stories", F.lit(None), ok).unionByName(
        _response(items, "stories", F.col("query"), ok)
    )
    names = events.select("source", "source_rank").distinct()
    return payloads, _settings(names, "stories", STORY_CAP)


def repo_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, sources): a search result per 20 parts, three queries to a source.

    Query 1 of a source with 1 mod 4 is rate limited, all queries of a source with 5 mod 8
    are; every 9th item has no id, every 10th is no object.
    """
    part = F.col("p_partkey")
    bucket = F.floor(part / F.lit(REPO_ITEMS))
    owner = F.struct(F.concat(F.lit("own"), (part % 7).cast("string")).alias("login"))
    item = F.to_json(F.struct(
        F.when(part % 9 != 4, part).alias("id"),
        F.when(part % 3 != 0, F.concat_ws("/", "p_brand", "p_name")).alias("full_name"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("https://code.example.com/"), part.cast("string")).alias("html_url"),
        F.col("p_type").alias("description"), owner.alias("owner"),
        F.date_format(after_base(part, 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.col("p_size").alias("stargazers_count"),
    ))
    rows = table(spark, sf_dir, "part").select(
        part, bucket.alias("bucket"), F.when(part % 10 == 9, F.lit('"text"')).otherwise(item).alias("x")
    )
    packed = rows.groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "x"))).alias("all")
    )
    rank = F.floor(F.col("bucket") / F.lit(3)).cast("int")
    named = packed.select(
        F.concat(F.lit("repos-"), rank.cast("string")).alias("source"),
        rank.alias("source_rank"),
        F.concat(F.lit("q"), (F.col("bucket") % 3).cast("string")).alias("query"),
        F.concat(
            F.lit('{"items":['), F.array_join(F.transform("all", lambda i: i["x"]), ","), F.lit("]}")
        ).alias("body"),
    )
    limited = ((F.col("source_rank") % 4 == 1) & (F.col("query") == "q1")) | (F.col("source_rank") % 8 == 5)
    payloads = _response(named, "repos", F.col("query"), F.when(limited, 403).otherwise(200))
    names = rows.select(rank.alias("source_rank")).distinct().select(
        F.concat(F.lit("repos-"), F.col("source_rank").cast("string")).alias("source"), "source_rank"
    )
    queries = F.array(F.lit("q0"), F.lit("q1"), F.lit("q2"))
    return payloads, _settings(names, "repos", REPO_CAP, queries=queries)


def landed(name: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, sources) as tables at rest: a scan starts from bodies already landed."""
    build = {"feed": feed_payloads, "twice": feed_twice, "story": story_payloads, "repo": repo_payloads}[name]
    return tuple(
        at_rest(f"{name}-{part}", spark, sf_dir, lambda i=i: build(spark, sf_dir)[i])
        for i, part in enumerate(("payloads", "sources"))
    )
