"""Canonical url columns (FN-4, FN-5, FN-6, FN-7)."""

from __future__ import annotations

from urllib.parse import uses_netloc

from pyspark.sql import Column, functions as F

from newsgrist.fixed_values import TRACKING_PARAMS
from newsgrist.functions.text import WS, let

# scheme, authority, path, query; the fragment is left out. Every group may be empty.
_PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*+):)?(?://([^/?#]*+))?([^?#]*+)(?:\?([^#]*+))?"

# Characters whose compatibility form holds one of / ? # @ : (not allowed in a host).
_AMBIGUOUS_HOST = "[⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫＃／：？＠]"

_HEX_GROUP = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ip_literal() -> str:
    """Pattern of what may stand between brackets in a host."""
    forms = [f"(?:{_HEX_GROUP}:){{7}}{_HEX_GROUP}", f"(?:{_HEX_GROUP}:){{6}}{_DOTTED}", "::"]
    for left in range(0, 8):
        head = f"(?:{_HEX_GROUP}(?::{_HEX_GROUP}){{{left - 1}}})" if left else ""
        if left:
            forms.append(f"{head}::")
        room = 7 - left
        if room:
            forms.append(f"{head}::(?:{_HEX_GROUP}:){{0,{room - 1}}}{_HEX_GROUP}")
        if room >= 2:
            forms.append(f"{head}::(?:{_HEX_GROUP}:){{0,{room - 2}}}{_DOTTED}")
    return rf"(?s)\A(?:(?:{'|'.join(forms)})(?:%[^%]+)?|v[0-9A-Fa-f]+\..+)\z"


def _trimmed(url: Column) -> Column:
    """White space and leading control characters off, line breaks and tabs out."""
    return F.regexp_replace(
        url, rf"(?U)\A{WS}*+[\x00-\x20]*+|(?<!{WS}){WS}++\z|[\t\r\n]++", ""
    )


def url_error(url: Column) -> Column:
    """Why a url cannot be split into its parts; null if it can."""

    def problem(host: Column) -> Column:
        opening, closing = F.contains(host, F.lit("[")), F.contains(host, F.lit("]"))
        inside = F.regexp_extract(host, r"\[([^\]]*+)", 1)
        return (
            F.when(opening != closing, F.lit("unbalanced brackets in host"))
            .when(opening & ~inside.rlike(_ip_literal()), F.lit("invalid bracketed host"))
            .when(host.rlike(_AMBIGUOUS_HOST), F.lit("ambiguous character in host"))
        )

    return let(F.regexp_extract(_trimmed(url), _PARTS, 2), problem)


def _decode(piece: Column) -> Column:
    """FN-6: '+' and valid percent escapes decoded, stray percent signs kept."""
    return F.coalesce(
        F.try_url_decode(F.regexp_replace(piece, "%(?![0-9A-Fa-f]{2})", "%25")), piece
    )


def _encode(piece: Column) -> Column:
    """FN-7: form encoding with ``A-Za-z0-9_.-~`` safe."""
    return F.replace(
        F.replace(F.url_encode(piece), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def canonical_query(query: Column) -> Column:
    """FN-5..7: decoded pairs without tracking keys, sorted, encoded again."""
    pieces = F.filter(F.split(query, "&", -1), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            # Everything after the first '='; '' without one.
            _decode(F.regexp_extract(p, r"(?s)\A[^=]*+=(.*)\z", 1)).alias("v"),
        ),
    )
    tracking = F.array(*[F.lit(p) for p in TRACKING_PARAMS])
    wanted = F.filter(pairs, lambda p: ~F.array_contains(tracking, F.lower(p["k"])))
    return F.array_join(
        F.transform(
            F.array_sort(wanted), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))
        ),
        "&",
    )


def _split(bare: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(bare, _PARTS, 1)).alias("scheme"),
        F.lower(F.regexp_extract(bare, _PARTS, 2)).alias("authority"),
        F.regexp_extract(bare, _PARTS, 3).alias("path"),
        F.regexp_extract(bare, _PARTS, 4).alias("query"),
    )


def _cleaned(parts: Column) -> Column:
    scheme, authority, path, query = (parts[p] for p in ("scheme", "authority", "path", "query"))
    host = (
        F.when(scheme == "http", F.regexp_replace(authority, r":80\z", ""))
        .when(scheme == "https", F.regexp_replace(authority, r":443\z", ""))
        .otherwise(authority)
    )
    single = F.nullif(F.regexp_replace(path, "/{2,}+", "/"), F.lit(""))
    return F.struct(
        scheme.alias("scheme"),
        host.alias("host"),
        F.coalesce(single, F.lit("/")).alias("path"),
        F.when(query != "", canonical_query(query)).otherwise("").alias("query"),
    )


def _assembled(parts: Column) -> Column:
    scheme, host, path, query = (parts[p] for p in ("scheme", "host", "path", "query"))
    rooted = F.startswith(path, F.lit("/"))
    slash = F.when(rooted, F.lit("")).otherwise("/")
    location = (
        F.when(host != "", F.concat(F.lit("//"), host, slash, path))
        .when(scheme.isin([s for s in uses_netloc if s]) & rooted, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        location,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def canonical_url(url: Column) -> Column:
    """FN-4. '' for null or empty; rows with a ``url_error`` are for the caller to drop."""

    def canonical(u: Column) -> Column:
        parts = let(let(_trimmed(u), _split), _cleaned)
        return F.when(u != "", let(parts, _assembled))

    return F.coalesce(let(url, canonical), F.lit(""))
