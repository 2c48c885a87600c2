"""Timestamp columns (SRC-6, FN-8, FN-16, FN-17). The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsgrist.fixed_values import ZONE_HOURS
from newsgrist.functions.text import collapse, let, strip

# Groups: 1 year 3 month 4 day | 5 year 7 week 8 weekday | 9 hour 11 minute 12 second
# 13 fraction | 14 offset. The back-references ask for one separator style per part.
_ISO = (
    r"(?s)\A(?:(\d{4})(-?)(\d{2})\2(\d{2})|(\d{4})(-?)W(\d{2})(?:\6([1-7]))?)"
    r"(?:.([01]\d|2[0-3])(?:(:?)([0-5]\d)(?:\10([0-5]\d))?)?(?:[.,](\d+))?"
    r"(Z|[+-](?:[01]\d|2[0-3])(?:(:?)[0-5]\d(?:\15[0-5]\d)?)?(?:[.,]\d+)?)?)?\z"
)

_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_DAY_NAME = "(?:[^ ]*, ?|(?:mon|tue|wed|thu|fri|sat|sun) )?"
_CLOCK = r"(\d{1,2}):(\d{1,2})(?::([0-5]?\d))?,?"
_ZONE = r"(?: ?([+-]\d+)| ([^ ]+))?(?: .*)?\z"
# "19 Sep 2026 10:00:00 +0000", "Sep 19 2026 10:00 GMT", "Sep 19 10:00:00 2026".
# Each entry: pattern, then the groups of day, month, year and hour.
_MAIL_FORMS = [
    (rf"(?i)\A{_DAY_NAME}(\d{{1,2}}),?[ -]{_MONTH}[ -](\d{{1,4}}),? {_CLOCK}{_ZONE}", 1, 2, 3, 4),
    (rf"(?i)\A{_DAY_NAME}{_MONTH} (\d{{1,2}}),? (\d{{1,4}}),? {_CLOCK}{_ZONE}", 2, 1, 3, 4),
    (rf"(?i)\A{_DAY_NAME}{_MONTH} (\d{{1,2}}),? {_CLOCK} (\d{{1,4}}){_ZONE}", 2, 1, 6, 3),
]
_MONTH_ORDER = "janfebmaraprmayjunjulaugsepoctnovdec"


def _matched(text: Column, pattern: str, groups: list[int], body) -> Column:
    """``body`` of the wanted groups as texts (null if empty); null if there is no match.

    One replacement lays all groups out in a line, instead of one search per group.
    """
    line = F.regexp_replace(text, pattern, "|".join(f"${g}" for g in groups))

    def from_parts(parts: Column) -> Column:
        return body(*[F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i in range(len(groups))])

    return F.when(text.rlike(pattern), let(F.split(line, r"\|", -1), from_parts))


def _instant(date: Column, hour: Column, minute: Column, second: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(
        F.nullif(F.year(date), F.lit(0)), F.month(date), F.dayofmonth(date),
        F.coalesce(hour, zero), F.coalesce(minute, zero),
        F.coalesce(second, zero).cast("decimal(16,6)"), F.lit("UTC"),
    )


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, null where the calendar has no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day)
    complete = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(complete, text.try_cast("date"))


def _week_date(year: Column, week: Column, weekday: Column) -> Column:
    first = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(first, F.weekday(first))
    weeks = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    days = (week - 1) * 7 + F.coalesce(weekday, F.lit(1)) - 1
    return F.when(week.between(1, weeks), F.date_add(monday, days))


def _offset_micros(offset: Column) -> Column:
    """Micros east of UTC of ``+hh[[:]mm[[:]ss]][.f]``; 0 for null and 'Z'."""
    digits = F.regexp_replace(offset, r"\A[+-]|:|[.,].*|Z", "")

    def two(at: int) -> Column:
        return F.coalesce(
            F.nullif(F.substring(digits, at, 2), F.lit("")).cast("bigint"), F.lit(0)
        )

    fraction = F.substring(F.rpad(F.regexp_extract(offset, r"[.,](\d+)", 1), 6, "0"), 1, 6)
    size = (two(1) * 3600 + two(3) * 60 + two(5)) * 1_000_000 + fraction.cast("bigint")
    return F.coalesce(F.when(F.startswith(offset, F.lit("-")), -size).otherwise(size), F.lit(0))


def _minus_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - micros)


def parse_iso(text: Column) -> Column:
    """ISO 8601 in its calendar and week forms; null for anything else."""

    def build(year, month, day, wyear, week, weekday, hour, minute, second, fraction, offset):
        number = lambda part: part.cast("int")
        date = F.coalesce(
            _date(number(year), number(month), number(day)),
            _week_date(number(wyear), number(week), number(weekday)),
        )
        micros = F.substring(F.rpad(F.coalesce(fraction, F.lit("")), 6, "0"), 1, 6)
        local = _instant(date, number(hour), number(minute), number(second))
        return _minus_micros(local, _offset_micros(offset) - micros.cast("bigint"))

    return let(text, lambda t: _matched(t, _ISO, [1, 3, 4, 5, 7, 8, 9, 11, 12, 13, 14], build))


def _mail_form(text: Column, pattern: str, day: int, month: int, year: int, hour: int) -> Column:
    def build(day, month, year, hour, minute, second, zone_number, zone_name):
        place = F.instr(F.lit(_MONTH_ORDER), F.lower(F.substring(month, 1, 3)))
        month_no = ((place + F.lit(2)) / F.lit(3)).cast("int")
        yy = year.cast("int")
        full_year = F.when(yy > 99, yy).when(yy > 68, yy + 1900).otherwise(yy + 2000)
        local = _instant(
            _date(full_year, month_no, day.cast("int")),
            hour.cast("int"), minute.cast("int"), second.cast("int"),
        )
        hhmm = zone_number.try_cast("int")
        size = F.floor(F.abs(hhmm) / F.lit(100)) * 60 + F.abs(hhmm) % 100
        numeric = F.when(hhmm < 0, -size).otherwise(size)
        zones = F.create_map(*[F.lit(x) for zone in ZONE_HOURS.items() for x in zone])
        named = F.try_element_at(zones, F.upper(zone_name)) * 60
        minutes = F.coalesce(numeric, named, F.lit(0)).cast("bigint")
        return F.when(F.abs(minutes) < 24 * 60, _minus_micros(local, minutes * 60_000_000))

    groups = [day, month, year, hour, hour + 1, hour + 2, 7, 8]
    return _matched(text, pattern, groups, build)


def parse_mail_date(text: Column) -> Column:
    """RFC 2822 dates with their customary variants; unknown zones count as UTC."""
    return let(
        collapse(text), lambda t: F.coalesce(*[_mail_form(t, *form) for form in _MAIL_FORMS])
    )


def parse_timestamp(text: Column) -> Column:
    """FN-8: ISO 8601, else RFC 2822, else null; a time without a zone is UTC."""
    return let(strip(text), lambda t: F.coalesce(parse_iso(t), parse_mail_date(t)))


def epoch_timestamp(seconds: Column) -> Column:
    """FN-17: seconds since 1970 (a number or numeric text); null if it is neither."""
    value = seconds.try_cast("double")
    # Years 1 to 9999, the range a calendar timestamp can show.
    return F.when(
        value.between(-62135596800, 253402300799),
        F.timestamp_micros(F.round(value * 1_000_000).cast("bigint")),
    )


def display_time(ts: Column) -> Column:
    """FN-16."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")
