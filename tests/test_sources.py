"""SRC-1..16 on payload literals."""

import json
import random
from datetime import datetime

import pytest

from newsgrist.operators import filters
from newsgrist.schema import PAYLOAD_SCHEMA, RAW_SCHEMA, SOURCE_SCHEMA
from newsgrist.operators.normalize import normalize
from newsgrist.sources import Scan, register, scan_all, scan_feeds, scan_repos, scan_stories
from newsgrist.sources.contract import SCANNERS, SourceFailure

AT = datetime(2026, 9, 19)

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"
 xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>F</title>
<item><title> One &amp; only </title><link>https://e.com/1</link><description><![CDATA[<p>Text</p>]]></description>
<dc:creator>Ann</dc:creator><pubDate>Sat, 19 Sep 2026 10:00:00 +0000</pubDate><guid isPermaLink="false">g1</guid>
<category>ai</category><category>ml</category><content:encoded>Full text</content:encoded></item>
<item><title>  </title><link>https://e.com/2</link></item>
<item><title>No link</title></item>
<item><title>Bare</title><link>https://e.com/4</link></item>
<item><title>Beyond the cap</title><link>https://e.com/5</link></item>
</channel></rss>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><title type="text">Entry</title><link rel="self" href="https://e.com/self"/>
<link rel="alternate" href="https://e.com/a"/><id>urn:1</id><updated>2026-09-19T12:00:00Z</updated>
<published>2026-09-19T10:00:00+02:00</published><summary>Short</summary>
<content type="html">Long</content><author><name>Bob</name></author><category term="go"/></entry>
<entry><title>First link</title><link rel="enclosure" href="https://e.com/b"/><updated>2026-09-18T00:00:00Z</updated></entry>
</feed>"""

CUT = """<rss version="2.0" xmlns:dc="urn:x"><channel><item><title>Kept</title><link>https://e.com/k</link>
<dc:creator>C</dc:creator></item><item><title>Lost</title><link>https"""


def payloads(spark, rows):
    """(source, kind, query, status, body)"""
    full = [(s, k, q, st, AT, b) for s, k, q, st, b in rows]
    return spark.createDataFrame(full, PAYLOAD_SCHEMA).repartition(2)


def sources(spark, rows):
    """(rank, kind, name, enabled, cap, queries)"""
    full = [(r, k, n, e, c, "https://x/", ["tag"], "new", q) for r, k, n, e, c, q in rows]
    return spark.createDataFrame(full, SOURCE_SCHEMA)


def test_feeds(spark):
    src = sources(spark, [(0, "feed", n, n != "off", 4, []) for n in ("rss", "atom", "cut", "bad", "http", "html", "off")])
    pay = payloads(spark, [
        ("rss", "feed", None, 200, RSS), ("atom", "feed", None, 200, ATOM), ("cut", "feed", None, 200, CUT),
        ("bad", "feed", None, 200, "<rss><channel><it"), ("http", "feed", None, 503, RSS),
        ("html", "feed", None, 200, "<html><body>x</body></html>"), ("off", "feed", None, 200, RSS),
    ])
    raw, errors, _ = scan_feeds(pay, src)
    got = {(r.source, r.ord.pos): r for r in raw.collect()}
    assert set(got) == {("rss", 0), ("rss", 3), ("atom", 0), ("atom", 1), ("cut", 0)}
    one = got["rss", 0]
    assert (one.title, one.url, one.description, one.author, one.source_id, one.content) == (
        "One & only", "https://e.com/1", "<p>Text</p>", "Ann", "g1", "Full text")
    assert one.published_at == datetime(2026, 9, 19, 10)
    assert one.metadata.entry_tags == ["ai", "ml"] and one.metadata.feed_categories == ["tag"]
    entry = got["atom", 0]
    assert (entry.title, entry.url, entry.description, entry.author, entry.source_id, entry.content) == (
        "Entry", "https://e.com/a", "Short", "Bob", "urn:1", "Long")
    assert entry.published_at == datetime(2026, 9, 19, 8) and entry.metadata.entry_tags == ["go"]
    assert got["atom", 1].url == "https://e.com/b"
    assert got["atom", 1].published_at == datetime(2026, 9, 18)
    assert (got["cut", 0].title, got["cut", 0].author) == ("Kept", "C")
    assert {(e.source, e.message) for e in errors.collect()} == {("bad", "malformed feed"), ("http", "HTTP status 503")}


def test_entries_of_broken_feeds(spark):
    """Prefixes that nothing declares, sections that look like markup, entries left open."""
    rss = """<rss xmlns:q="urn:q"><channel><!-- <item><title>no</title></item> -->
      <item><title><![CDATA[A </item> <b>]]></title><link>https://e.com/a</link><q:creator>Ann</q:creator><z:x a:b="1" xml:lang="de"/></item>
      <item><title>Open</title><link>https://e.com/o</link>
      <item><title>B</title><link>https://e.com/b</link><items>3</items><r.-1:date>2026-09-18</r.-1:date></item ><item><title>cut"""
    atom = """<feed xmlns:k="u"><entry k:n='1'><title type="html"><![CDATA[]]>C<![CDATA[ & D]]></title><link href="https://e.com/c"/></entry>
      <entry><title>E</title><link href="https://e.com/e"/></entry><entry><title><![CDATA[never closed</title></entry>"""
    src = sources(spark, [(0, "feed", n, True, 9, []) for n in ("rss", "atom", "none")])
    pay = payloads(spark, [("rss", "feed", None, 200, rss), ("atom", "feed", None, 200, atom), ("none", "feed", None, 200, "<rss><item><![CDATA[</item>")])
    raw, errors, _ = scan_feeds(pay, src)
    got = sorted((r.source, r.title, r.url, r.author) for r in raw.collect())
    assert got == [("atom", "C & D", "https://e.com/c", None), ("atom", "E", "https://e.com/e", None),
                   ("rss", "A </item> <b>", "https://e.com/a", "Ann"), ("rss", "B", "https://e.com/b", None)]
    assert [e.source for e in errors.collect()] == ["none"]


def test_feed_variants(spark):
    rss = """<rss version="2.0"><channel>
      <item><title>A</title><guid>https://e.com/g</guid></item>
      <item><title>B</title><guid isPermaLink="true">https://e.com/h</guid></item>
      <item><title>C</title><guid isPermaLink="false">id-3</guid></item>
      <item><title>D</title><link>https://e.com/l</link><guid>https://e.com/i</guid></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry>
      <title type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">One <b>bold</b> title</div></title>
      <link href="https://e.com/x"/><summary type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>Sum <i>mary</i></p></div></summary>
      </entry><entry><title type="html">Two &lt;i&gt;it&lt;/i&gt;</title><link href="https://e.com/y"/><summary>Plain</summary></entry></feed>"""
    src = sources(spark, [(0, "feed", "r", True, 9, []), (1, "feed", "a", True, 9, [])])
    raw, errors, good = scan_feeds(payloads(spark, [("r", "feed", None, 200, rss), ("a", "feed", None, 200, atom)]), src)
    got = {(r.source, r.ord.pos): r for r in raw.collect()}
    assert {k: r.url for k, r in got.items()} == {
        ("r", 0): "https://e.com/g", ("r", 1): "https://e.com/h", ("r", 3): "https://e.com/l", ("a", 0): "https://e.com/x", ("a", 1): "https://e.com/y"}
    cleaned = {r.url: (r.title, r.description) for r in normalize(raw).collect()}
    assert cleaned["https://e.com/x"] == ("One bold title", "Sum mary")
    assert cleaned["https://e.com/y"] == ("Two it", "Plain")
    assert errors.count() == 0 and {r.source for r in good.collect()} == {"r", "a"}


def test_queries_that_are_not_configured(spark):
    src = sources(spark, [(1, "repos", "gh", True, 6, ["a"])])
    body = json.dumps({"items": [repo()]})
    raw, errors, good = scan_repos(payloads(spark, [("gh", "repos", "a", 500, ""), ("gh", "repos", "other", 200, body)]), src)
    assert raw.count() == 0 and good.count() == 0
    assert {(e.query, e.message) for e in errors.collect()} == {("a", "HTTP status 500"), (None, "all queries failed: HTTP status 500")}


def story(**fields):
    return json.dumps({"type": "story", "title": "T", "url": "https://e.com/", "time": 1700000000, **fields})


def test_stories(spark):
    src = sources(spark, [(3, "stories", "hn", True, 12, []), (4, "stories", "odd", True, 5, []), (5, "stories", "junk", True, 5, [])])
    items = {
        1: story(id=1, by=" ann ", score=5, descendants=2, text=" body "), 2: story(id=2, deleted=True),
        3: story(id=3, dead=True), 4: story(id=4, type="job"), 5: story(id=5, title=7),
        6: story(id=6, url=""), 7: story(id=7, deleted=1, time="1700000000"), 8: "null", 9: "[1]",
        10: story(id=10, by=3, time="x"), 12: story(id=12),
    }
    rows = [("hn", "stories", None, 200, json.dumps([12, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 1])),
            ("odd", "stories", None, 200, '{"a": 1}'), ("junk", "stories", None, 200, "not json")]
    rows += [("hn", "stories", str(i), 200, b) for i, b in items.items()]
    raw, errors, _ = scan_stories(payloads(spark, rows), src)
    got = {r.source_id: r for r in raw.collect()}
    assert {(k, r.ord.pos) for k, r in got.items()} == {("12", 0), ("1", 1), ("7", 7), ("10", 10)}
    one = got["1"]
    assert (one.author, one.description, one.metadata.score, one.metadata.descendants) == ("ann", "body", "5", 2)
    assert one.published_at == got["7"].published_at == datetime(2023, 11, 14, 22, 13, 20)
    assert got["10"].author is None and got["10"].published_at is None
    assert one.ord.source_rank == 3 and one.metadata.story_feed == "new"
    assert {(e.source, e.message) for e in errors.collect()} == {("odd", "story ids are not a list"), ("junk", "invalid JSON")}


def repo(**fields):
    return {"id": 1, "full_name": "o/r", "html_url": "https://h/", "created_at": "2026-09-19T10:00:00Z", **fields}


def test_repos(spark):
    src = sources(spark, [(1, "repos", "gh", True, 6, ["a", " b "]), (2, "repos", "down", True, 5, ["a", "b"])])
    items = [repo(stargazers_count=12500, owner={"login": " me "}, topics=["x"], description="d", language="Go"),
             repo(id=None), "text", repo(id=4, full_name="", name="n"), repo(id=5, full_name=5, name="n"),
             repo(id=6, html_url=None), repo(id=7)]
    rows = [("gh", "repos", "a", 200, json.dumps({"items": items})), ("gh", "repos", "b", 200, '{"items": {}}'),
            ("gh", "repos", " ", 200, '{"items": []}'),
            ("down", "repos", "a", 403, ""), ("down", "repos", "b", 200, "[]")]
    raw, errors, _ = scan_repos(payloads(spark, rows), src)
    got = {r.source_id: r for r in raw.collect()}
    assert {(k, r.ord.pos) for k, r in got.items()} == {("1", 0), ("4", 3)}
    one = got["1"]
    assert (one.title, one.author, one.description, one.metadata.stars, one.metadata.topics, one.metadata.query) == (
        "o/r", "me", "d", "12500", ["x"], "a")
    assert one.published_at == datetime(2026, 9, 19, 10) and one.ord.query_rank == 1
    assert got["4"].title == "n" and got["4"].metadata.topics == []
    assert {(e.source, e.query) for e in errors.collect()} == {("gh", "b"), ("down", "a"), ("down", "b"), ("down", None)}


def test_scan_all_and_strict(spark):
    src = sources(spark, [(0, "feed", "rss", True, 9, []), (1, "feed", "bad", True, 9, [])])
    good = payloads(spark, [("rss", "feed", None, 200, RSS)])
    both = good.union(payloads(spark, [("bad", "feed", None, 200, "<")]))
    scan = scan_all(both, src)
    assert scan.raw.count() == 3 and scan.errors.count() == 1
    assert scan_all(good, src, strict=True).raw.count() == 3
    with pytest.raises(SourceFailure, match="bad"):
        scan_all(both, src, strict=True)


def test_register_a_kind(spark):
    def scan(pay, src):
        raw = pay.where("kind = 'own'").selectExpr("source", "body title", "'u' url")
        for name in ("source_id", "author", "description", "content"):
            raw = raw.selectExpr("*", f"cast(null as string) {name}")
        empty = pay.sparkSession.createDataFrame([], RAW_SCHEMA)
        return Scan(empty.unionByName(raw, allowMissingColumns=True), scan_feeds(pay, src).errors.limit(0))

    register("own", scan)
    try:
        out = scan_all(payloads(spark, [("mine", "own", None, 200, "T")]), sources(spark, [(0, "own", "mine", True, 1, [])]))
        assert [(r.source, r.title) for r in out.raw.collect()] == [("mine", "T")]
    finally:
        del SCANNERS["own"]


def test_head_per_source_at_any_cap(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", "off", "none"]), (0, i)) for i in range(600)]
    raw = spark.createDataFrame([(s, o, f"p{o[1]}") for s, o in rows], "source string, ord struct<a:int,b:int>, payload string").repartition(5)
    of = lambda s: [o[1] for x, o in rows if x == s]
    caps = {"hot": len(of("hot")) - 7, "a": len(of("a")), "b": 1, "off": 0, "far": 5}
    sources = spark.createDataFrame(list(caps.items()), "name string, max_items int")
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = sorted((r.source, r.ord.b, r.payload) for r in filters.head_per_source(raw, sources).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == sorted((s, i, f"p{i}") for s, cap in caps.items() for i in of(s)[:cap])


def test_feeds_at_rest_are_records(spark, monkeypatch):
    """What is written are the records up to the cap; feeds that give none still worked."""
    from newsgrist.sources import feeds
    written = []
    monkeypatch.setattr(feeds, "cut_lineage", lambda df: written.append(df) or df)
    src = sources(spark, [(0, "feed", "rss", True, 1, []), (1, "feed", "none", True, 0, []), (2, "feed", "bad", True, 9, [])])
    pay = payloads(spark, [("rss", "feed", None, 200, RSS), ("none", "feed", None, 200, RSS), ("bad", "feed", None, 500, RSS)])
    raw, errors, good = scan_feeds(pay, src, at_rest=True)
    assert [r.title for r in raw.collect()] == ["One & only"]
    assert sorted(r.source for r in good.collect()) == ["none", "rss"]
    assert [r.message for r in errors.collect()] == ["HTTP status 500"]
    assert "entries" not in written[0].columns and written[0].count() == 3
