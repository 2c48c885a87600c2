"""Notification outbox (OUT-1..5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgrist import fixed_values as fixed
from newsgrist.functions.text import escape_markup, strip, thousands, truncate
from newsgrist.functions.times import display_time
from newsgrist.operators.history import top_unsent


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _line(label: str, value: Column) -> Column:
    """``label: value``, null for a null value (so it leaves no line)."""
    return F.concat(F.lit(f"{label}: "), escape_markup(value))


def _filled(value: Column) -> Column:
    """Stripped text; null if nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def _blocks(*blocks: Column) -> Column:
    """Non-empty blocks with a blank line between them."""
    return F.concat_ws("\n\n", *[F.nullif(b, F.lit("")) for b in blocks])


def _room(block: Column) -> Column:
    """What a block takes with its blank line; 0 for an empty one."""
    return F.when(block != "", F.char_length(block) + 2).otherwise(0)


def with_message(
    articles: DataFrame,
    max_message_length: int = fixed.MAX_MESSAGE_LENGTH,
    max_description_length: int = fixed.MAX_DESCRIPTION_LENGTH,
) -> DataFrame:
    """OUT-1, OUT-2: adds ``message``, at most ``max_message_length`` code points of markup.

    Tried in order: everything; a shorter description; none; a shorter title; the link only.
    """
    names = F.filter(
        F.transform(F.coalesce("categories", F.array().cast("array<string>")), strip),
        lambda c: c != "",
    )
    source = _filled(F.col("source"))
    badge = F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), source)
    title_text = F.when(_or_empty(F.col("title")) != "", strip(F.col("title"))).otherwise("Untitled")
    lines = [_line("Source", source)]
    if "metadata" in articles.columns:
        meta = F.col("metadata")
        language = F.when(meta["language"] != "", strip(meta["language"]))
        lines += [
            _line("Stars", thousands(meta["stars"])),
            _line("Language", language),
            _line("Score", meta["score"]),
        ]
    lines += [
        _line("Author", _filled(F.col("author"))),
        F.concat(F.lit("Published: "), display_time(F.col("published_at"))),
    ]
    url = _filled(F.col("url"))
    body = strip(_or_empty(F.col("description")))
    if max_description_length > 0:
        body = truncate(body, max_description_length)

    parts = articles.withColumns(
        {
            "_head": _or_empty(F.concat(F.lit("<b>["), escape_markup(badge), F.lit("]</b>"))),
            "_title": title_text,
            "_details": F.concat_ws("\n", *lines),
            "_body": body,
            "_link": _or_empty(F.concat(F.lit("Read more: "), escape_markup(url))),
        }
    )
    head, details, body, link = (F.col(c) for c in ("_head", "_details", "_body", "_link"))

    def bold(text: Column) -> Column:
        return F.concat(F.lit("<b>"), escape_markup(text), F.lit("</b>"))

    title = bold(F.col("_title"))
    above = _blocks(head, title, details)
    limit = F.lit(max_message_length)
    dots = len(fixed.ELLIPSIS)
    body_room = limit - _room(above) - _room(link)
    title_room = limit - _room(head) - _room(details) - _room(link) - len("<b></b>")
    # A column of its own: its length is asked for before it is taken.
    parts = parts.withColumn("_full", _blocks(head, title, details, escape_markup(body), link))
    full = F.col("_full")
    fitted = _blocks(above, escape_markup(truncate(body, body_room)), link)
    bare = _blocks(head, title, details, link)
    short = _blocks(head, bold(truncate(F.col("_title"), title_room)), details, link)

    def fits(text: Column) -> Column:
        return F.char_length(text) <= limit

    message = (
        F.when((body != "") & fits(full), full)
        .when((body != "") & (body_room > dots) & fits(fitted), fitted)
        .when(fits(bare), bare)
        .when(title_room > dots, short)
        .when(link != "", link)
        .otherwise(title)
    )
    return parts.withColumn("message", message).drop("_head", "_title", "_details", "_body", "_link", "_full")


def build_outbox(store: DataFrame, threshold: float, limit: int = fixed.NOTIFICATION_LIMIT) -> DataFrame:
    """OUT-3, OUT-4: the best unsent articles, backlog included, with their messages.

    Nothing is marked; a dry run stops here.
    """
    return with_message(top_unsent(store, threshold, limit))


def delivery_counts(results: DataFrame) -> DataFrame:
    """OUT-5: sent and failed deliveries."""
    return results.agg(
        F.count_if("ok").alias("sent_articles"), F.count_if(~F.col("ok")).alias("failed_notifications")
    )
