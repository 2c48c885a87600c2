"""Text cleanup columns (FN-1, FN-2, FN-3, FN-10, FN-11, FN-13, FN-14, FN-15)."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from newsgrist.fixed_values import BLOCK_TAGS, ELLIPSIS, TIGHT_PUNCTUATION

# Unicode white space, plus the four separators U+001C..U+001F.
WS = r"[\s\x1c-\x1f]"

# Entities decoded with built-ins. None but the last yields an ampersand, so decoding
# them in this order is one left-to-right pass.
_COMMON_ENTITIES = [
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"),
    ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("hellip", "…"),
    ("ndash", "–"), ("mdash", "—"), ("lsquo", "‘"), ("rsquo", "’"),
    ("ldquo", "“"), ("rdquo", "”"), ("amp", "&"),
]
# An ampersand that starts something other than a common entity and could be an entity.
_OTHER_ENTITY = (
    "&(?!(?:" + "|".join(name for name, _ in _COMMON_ENTITIES) + r");|[\t\n\f <&;]|\z)"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Keeps expressions linear in size: a plain reuse of ``value`` would copy it at every use,
    and again whenever Catalyst moves the expression into a filter.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Entity names as one literal that folds into a map; some count without their semicolon, also
# when more letters follow.
_NAMES = "\x01".join(f"{name}\x02{chars}" for name, chars in html5.items())
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
# What the references to 128..159 stand for.
_C1 = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def _character(number: Column) -> Column:
    """The text of a numeric reference; null numbers are too large."""

    def within(first: int, last: int) -> Column:
        return number.between(first, last)

    dropped = within(1, 8) | (number == 11) | within(14, 31) | (number == 127) | within(0xFDD0, 0xFDEF)
    dropped = dropped | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    encoded = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return (
        F.when(number.isNull() | (number == 0) | within(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd")
        .when(within(128, 159), F.substring(F.lit(_C1), number.cast("int") - 127, F.lit(1)))
        .when(dropped, "")
        .otherwise(F.decode(encoded, "UTF-32"))
    )


def _named(reference: Column, rest: Column) -> Column:
    """A named reference (without its ampersand) and what follows it."""
    open_name = F.regexp_extract(reference, rf"\A(?:{_OPEN_NAMES})", 0)

    def looked_up(names: Column) -> Column:
        shorter = F.concat(names[open_name], F.substr(reference, F.char_length(open_name) + 1))
        return F.concat(F.coalesce(names[reference], shorter, F.concat(F.lit("&"), reference)), rest)

    # Bound once: a plan holds the literal once for each decoded column.
    return let(F.str_to_map(F.lit(_NAMES), F.lit("\x01"), F.lit("\x02")), looked_up)


def _decoded(part: Column) -> Column:
    """The text after an ampersand up to the next one, its reference decoded."""

    def after(pattern: str) -> Column:
        return F.substr(part, F.char_length(F.regexp_extract(part, pattern, 0)) + 1)

    decimal, hexadecimal = r"\A#0*+([0-9]*+);?", r"\A#[xX]0*+([0-9a-fA-F]*+);?"
    digits, nibbles = F.regexp_extract(part, decimal, 1), F.regexp_extract(part, hexadecimal, 1)
    # Longer ones are too large for any character.
    value = F.when(F.char_length(digits) <= 7, F.concat(F.lit("0"), digits).cast("bigint"))
    hex_value = F.when(F.char_length(nibbles) <= 6, F.conv(F.concat(F.lit("0"), nibbles), 16, 10).cast("bigint"))
    name = r"\A[^\t\n\f <&#;]{1,32}+;?"
    return (
        F.when(part.rlike(r"\A#[0-9]"), F.concat(let(value, _character), after(decimal)))
        .when(part.rlike(r"\A#[xX][0-9a-fA-F]"), F.concat(let(hex_value, _character), after(hexadecimal)))
        .when(part.rlike(name), let(F.regexp_extract(part, name, 0), lambda n: _named(n, after(name))))
        .otherwise(F.concat(F.lit("&"), part))
    )


def unescape(text: Column) -> Column:
    """One pass of HTML entity decoding.

    Text with common entities only takes a few replacements. Other text is split at its
    ampersands: a reference starts at one and holds no second, so each piece is decoded by
    itself: numbers by arithmetic, names by the longest that is known.
    """

    def decoded(t: Column) -> Column:
        common = t
        for name, char in _COMMON_ENTITIES:
            common = F.replace(common, F.lit(f"&{name};"), F.lit(char))
        pieces = F.split(t, "&")
        any_name = let(
            pieces, lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), _decoded), ""))
        )
        return F.when(~F.contains(t, F.lit("&")), t).when(~t.rlike(_OTHER_ENTITY), common).otherwise(any_name)

    return let(text, decoded)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed. Single spaces, nearly all runs of a text,
    are no match, so nothing is put together anew for them."""
    return F.trim(F.regexp_replace(text, rf"(?U){WS}(?:(?<! )|(?={WS})){WS}*+", " "))


def strip(text: Column) -> Column:
    """White space off both ends. The pattern tries every position of a text, so only texts
    with white space at an end meet it."""

    def stripped(t: Column) -> Column:
        ends = F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
        bare = F.regexp_replace(t, rf"(?U)\A{WS}++|(?<!{WS}){WS}++\z", "")
        return F.when(ends.rlike(f"(?U){WS}"), bare).otherwise(t)

    return let(text, stripped)


def is_blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def clean_text(text: Column) -> Column:
    """FN-1: decode entities, collapse white space; null becomes ''."""
    # Never null by schema either, so joins on clean columns add no null filters.
    return F.coalesce(collapse(unescape(F.coalesce(text, F.lit("")))), F.lit(""))


def clean_again(cleaned: Column) -> Column:
    """``clean_text`` of text that is already clean: changes it only at an entity."""
    return F.when(F.contains(cleaned, F.lit("&")), clean_text(cleaned)).otherwise(cleaned)


def _replace_tags(text: Column, pattern: str, by: str) -> Column:
    return let(
        text,
        lambda t: F.when(
            F.contains(t, F.lit("<")), F.regexp_replace(t, pattern, by)
        ).otherwise(t),
    )


def without_title_tags(title: Column) -> Column:
    """The part of FN-2 before decoding."""
    return _replace_tags(F.coalesce(title, F.lit("")), "<[^>]++>", " ")


def without_description_tags(description: Column) -> Column:
    """The part of FN-3 before decoding."""
    blocks = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})[^>]*+>"
    bare = _replace_tags(_replace_tags(description, blocks, " "), "<[^>]++>", "")
    # The look-behind keeps long white-space runs linear; after the first character of a run, it
    # is not tried at every position.
    return F.regexp_replace(bare, rf"(?U){WS}(?<!{WS}{WS}){WS}*+([{TIGHT_PUNCTUATION}])", "$1")


def clean_title(title: Column) -> Column:
    """FN-2: tags to spaces, then FN-1."""
    return clean_text(without_title_tags(title))


def clean_title_again(cleaned: Column) -> Column:
    """FN-2 of a clean title: decoding may have revealed tags or entities."""
    return F.when(cleaned.rlike("[&<]"), clean_title(cleaned)).otherwise(cleaned)


def clean_description(description: Column) -> Column:
    """FN-3: block tags to spaces, other tags to nothing, no space before punctuation."""
    return F.nullif(clean_text(without_description_tags(description)), F.lit(""))


def title_key(title: Column, *, cleaned: bool = False) -> Column:
    """FN-10: lower-case title without punctuation."""
    once = clean_again(title) if cleaned else clean_text(title)
    return collapse(F.regexp_replace(F.lower(once), r"[^\p{L}\p{N}_ ]++", ""))


def source_key(source: Column) -> Column:
    """FN-11."""
    return F.lower(strip(F.coalesce(source, F.lit(""))))


def truncate(text: Column, limit: Column | int, suffix: str = ELLIPSIS) -> Column:
    """FN-13: cut to ``limit`` code points at a word boundary, ending in ``suffix``."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    room = limit - F.lit(len(suffix))
    head = F.substring(text, F.lit(1), room)
    words = F.nullif(F.regexp_extract(head, r"(?s)\A(.+) [^ ]*+\z", 1), F.lit(""))
    # A space at index 0 is no boundary, so the part before it must not be empty.
    shortened = F.concat(
        F.regexp_replace(F.coalesce(words, head), rf"(?U)(?<!{WS}){WS}++\z", ""), F.lit(suffix)
    )
    return (
        F.when(F.char_length(text) <= limit, text)
        .when(room <= 0, F.substring(text, F.lit(1), F.greatest(limit, F.lit(0))))
        .otherwise(shortened)
    )


def escape_markup(text: Column) -> Column:
    """FN-14: ampersand first, then angle brackets; quotes stay."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def thousands(value: Column) -> Column:
    """FN-15: whole numbers with separators, anything else as it is."""
    number = F.trim(value).try_cast("bigint")
    integral = value.rlike(r"\A\s*[+-]?\d+\s*\z")
    return F.when(integral & number.isNotNull(), F.format_number(number, 0)).otherwise(value)
