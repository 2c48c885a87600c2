"""RSS 2.0 and Atom payloads (SRC-2..8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.pinned import pinned
from newsgrist.functions.text import escape_markup, is_blank, let, strip
from newsgrist.functions.times import parse_timestamp
from newsgrist.sources.contract import (
    Scan, errors_of, http_error, metadata_of, order_of, payloads_of,
)

_LINK = "struct<_VALUE:string,_href:string,_rel:string>"
_TAG = "struct<_VALUE:string,_term:string>"
# One entry type for both formats: every feed is read once, with one schema. Texts are
# strings, which keeps the markup of XHTML constructs for the cleaning to remove.
_ENTRY = (
    f"struct<title:string,link:array<{_LINK}>,description:string,summary:string,"
    f"content:array<string>,encoded:string,author:struct<_VALUE:string,name:string>,"
    "creator:string,pubDate:string,date:string,published:string,updated:string,"
    f"guid:struct<_VALUE:string,_isPermaLink:string>,id:string,category:array<{_TAG}>>"
)
_FEED = f"channel struct<item:array<{_ENTRY}>>, entry array<{_ENTRY}>, item array<{_ENTRY}>, _corrupt_record string"

# Prefixed elements carry the same content under a namespace.
_PREFIXES = r"(</?)(?:dc|content|atom|rdf|media):(creator|date|encoded|link)\b"
_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "valueTag": "_VALUE"}


def _parsed(body: Column) -> Column:
    return F.from_xml(body, _FEED, _OPTIONS)


def _plain_markup(body: Column) -> Column:
    """``body`` without comments, its CDATA sections as escaped text; an open one ends it."""

    def section(piece: Column) -> Column:
        end = F.instr(piece, "]]>")
        inside = escape_markup(F.substr(piece, F.lit(1), end - 1))
        return F.when(end > 0, F.concat(inside, F.substr(piece, end + 3))).otherwise("")

    def joined(pieces: Column) -> Column:
        return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), section), ""))

    return F.regexp_replace(let(F.split(body, r"<!\[CDATA\["), joined), "(?s)<!--.*?-->", "")


def _whole_entries(markup: Column, tag: str) -> Column:
    """Complete entries cut out of a broken body (SRC-7). Every start tag begins one, so an
    entry that is not closed takes no other with it."""
    cut = F.transform(F.split(markup, rf"(?=<{tag}[\s>])"), lambda p: F.regexp_extract(p, rf"(?s)\A<{tag}[\s>].*?</{tag}\s*>", 0))
    return F.filter(cut, lambda p: p != "")


def _declarations(markup: Column) -> Column:
    """Declarations of the prefixes in use. Names are all that is read of a prefixed element,
    so it does not matter which space a prefix stands for."""
    names = [
        F.regexp_extract_all(markup, F.lit(pattern), F.lit(1))
        for pattern in (r"</?([A-Za-z_][\w.-]*):", r"\s([A-Za-z_][\w.-]*):[\w.-]+\s*=\s*[\"']")
    ]
    used = F.filter(F.array_distinct(F.concat(*names)), lambda n: ~F.lower(n).startswith("xml"))
    return F.array_join(F.transform(used, lambda n: F.concat(F.lit(" xmlns:"), n, F.lit('="urn:'), n, F.lit('"'))), "")


def _salvaged(body: Column) -> Column:
    """A well-formed feed made of the complete entries of a broken one; null without any."""

    def wrapped(markup: Column) -> Column:
        entries = F.concat(_whole_entries(markup, "item"), _whole_entries(markup, "entry"))
        inner = F.regexp_replace(F.array_join(entries, "\n"), _PREFIXES, "$1$2")
        return let(inner, lambda x: F.when(x != "", F.concat(F.lit("<feed"), _declarations(x), F.lit(">"), x, F.lit("</feed>"))))

    return let(_plain_markup(body), wrapped)


def _first_text(*choices: Column) -> Column:
    """First non-empty choice, stripped; null if there is none."""
    return strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in choices]))


def _entry_link(links: Column, guid: Column) -> Column:
    """SRC-4: the link text (RSS); else the first alternate; else the first with an address;
    else a guid that is not declared to be no permalink."""
    texts = F.filter(links, lambda l: F.coalesce(l["_VALUE"], F.lit("")) != "")
    alternate = F.filter(
        links,
        lambda l: (F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
        & (F.coalesce(l["_href"], F.lit("")) != ""),
    )
    return F.coalesce(
        F.get(texts, F.lit(0))["_VALUE"],
        F.get(alternate, F.lit(0))["_href"],
        F.get(links, F.lit(0))["_href"],
        F.when(F.lower(F.coalesce(guid["_isPermaLink"], F.lit("true"))) == "true", F.nullif(guid["_VALUE"], F.lit(""))),
    )


def scan_feeds(payloads: DataFrame, sources: DataFrame, *, at_rest: bool = False) -> Scan:
    """Feed bodies to raw records and failures.

    A body that is broken and yields no entry is a failure; a broken one with complete
    entries keeps those. The cap counts entries before invalid ones are skipped (SRC-15).
    ``at_rest`` writes the records once, with the failures and only the fields in use, for
    callers that use all of the result.
    """
    fetched = payloads_of("feed", payloads, sources).withColumn(
        "problem", http_error(F.col("http_status"), F.col("body"))
    )
    feeds = pinned(fetched, "*", feed=_parsed(F.regexp_replace("body", _PREFIXES, "$1$2")))
    broken = F.col("feed._corrupt_record").isNotNull()
    feeds = pinned(feeds, "*", rest=F.when(broken, _parsed(_salvaged(F.col("body")))))

    def entries(feed: str) -> list[Column]:
        return [
            F.when(F.size(e) > 0, e)
            for e in (F.col(f"{feed}.channel.item"), F.col(f"{feed}.entry"), F.col(f"{feed}.item"))
        ]

    feeds = feeds.withColumn("entries", F.coalesce(*entries("feed"), *entries("rest")))
    problem = F.coalesce(
        "problem", F.when(broken & F.col("entries").isNull(), F.lit("malformed feed"))
    )
    capped = F.slice("entries", F.lit(1), F.greatest(F.coalesce("max_items", F.lit(0)), F.lit(0)))
    # A feed without any entry, or with a problem, keeps one row.
    rows = feeds.select(
        "source", "source_rank", "categories", "fetched_at", "body_id", problem.alias("problem"),
        F.posexplode_outer(F.when(problem.isNull(), capped)).alias("pos", "e"),
    )
    e = F.col("e")
    tags = F.filter(
        F.transform(e["category"], lambda t: F.coalesce(t["_term"], t["_VALUE"])),
        lambda t: F.coalesce(t, F.lit("")) != "",
    )
    records = pinned(
        rows,
        "source",
        "problem",
        "pos",
        title=strip(e["title"]),
        url=strip(_entry_link(e["link"], e["guid"])),
        source_id=_first_text(e["id"], e["guid"]["_VALUE"]),
        author=_first_text(e["author"]["name"], e["author"]["_VALUE"], e["creator"]),
        published_at=F.coalesce(
            parse_timestamp(F.coalesce(e["published"], e["pubDate"], e["date"])),
            parse_timestamp(e["updated"]),
        ),
        description=_first_text(e["summary"], e["description"]),
        content=_first_text(F.get(e["content"], F.lit(0)), e["encoded"]),
        metadata=metadata_of(
            feed_categories=F.coalesce("categories", F.array().cast("array<string>")),
            entry_tags=F.when(F.size(tags) > 0, tags),
        ),
        ord=order_of(0, F.col("pos")),
    )
    if at_rest:
        records = cut_lineage(records)
    errors = errors_of(records.where("problem is not null"), "feed", F.col("problem"))
    good = records.where("problem is null and coalesce(pos, 0) = 0").select("source")
    raw = records.where("pos is not null").drop("problem", "pos")
    return Scan(raw.where(~is_blank(F.col("title")) & ~is_blank(F.col("url"))), errors, good)
