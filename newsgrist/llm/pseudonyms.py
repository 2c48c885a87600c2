"""Format-preserving pseudonyms for personal numbers, dates and e-mail names.

Values that pass their format's own check (Luhn, mod 97, calendar, ranges) become a vector
of small integers and go through a keyed Feistel network: half of the vector is shifted by a
hash of the other half, in turns. That permutes the values of a format, so equal values stay
equal in all documents, different ones stay different, and every result passes the check.
Columns only: no Python runs on the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from newsgrist.functions.text import let

ROUNDS = 8  # even, so that the halves end where they were

_ALONE = r"(?<![0-9A-Za-z])"
_END = r"(?![0-9A-Za-z])"
_TIME = r"[Tt](?:[01][0-9]|2[0-4])(?::?[0-5][0-9]|[Zz]?(?![0-9A-Za-z]))"
# Fixed formats, first match wins.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": _ALONE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "iso_date": _ALONE + r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=" + _TIME + r")|(?![0-9A-Za-z]|-[0-9]))",
    "dot_date": r"(?<![0-9A-Za-z.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])",
    "slash_date": r"(?<![0-9A-Za-z/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9A-Za-z]|/[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": (
        r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
        r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
    ),
}
# A run of digit groups of any length, up to where another format begins; cards are looked
# for inside it. Possessive, so that long tables of numbers need no deep stack.
PATTERNS["card"] = (
    _ALONE + r"(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -](?!" + "|".join(f"(?:{p})" for p in PATTERNS.values())
    + r")[0-9]++(?![A-Za-z]))*+"
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What every match contains; other texts are passed on as they are.
HINT = "[0-9]{2}|@"


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _numbers(digits: Column) -> Column:
    return F.transform(_characters(digits), lambda c: c.cast("int"))


def _joined(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), "")


def feistel(values: Column, radices: Column, tweak: Column | str, key: str, *, back: bool = False) -> Column:
    """A keyed permutation of vectors with ``0 <= values[i] < radices[i]``.

    ``tweak`` tells formats apart. ``back`` undoes it.
    """
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def shifts(other: Column, own_radices: Column, turn: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

        def drawn(seed: Column, i: Column) -> Column:
            # 48 bits of one digest for each place
            return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("bigint")

        return let(said, lambda seed: F.transform(own_radices, lambda r, i: F.pmod(drawn(seed, i), r.cast("bigint")).cast("int")))

    def turned(state: Column, turn: Column) -> Column:
        if back:
            # undo: the half moved last is the second one
            moved = F.zip_with(state["b"], shifts(state["a"], state["rb"], turn), lambda x, s: x - s)
            own = F.zip_with(moved, state["rb"], lambda x, r: F.pmod(x, r))
            return F.struct(own.alias("a"), state["rb"].alias("ra"), state["a"].alias("b"), state["ra"].alias("rb"))
        moved = F.zip_with(state["a"], shifts(state["b"], state["ra"], turn), lambda x, s: x + s)
        own = F.zip_with(moved, state["ra"], lambda x, r: F.pmod(x, r))
        return F.struct(state["b"].alias("a"), state["rb"].alias("ra"), own.alias("b"), state["ra"].alias("rb"))

    turns = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def network(v: Column) -> Column:
        half = F.floor(F.size(v["x"]) / 2).cast("int")
        rest = F.size(v["x"]) - half
        start = F.struct(
            F.slice(v["x"], F.lit(1), half).alias("a"), F.slice(v["r"], F.lit(1), half).alias("ra"),
            F.slice(v["x"], half + 1, rest).alias("b"), F.slice(v["r"], half + 1, rest).alias("rb"),
        )
        return F.aggregate(F.array(*[F.lit(t) for t in turns]), start, turned, lambda s: F.concat(s["a"], s["b"]))

    return let(F.struct(values.alias("x"), radices.alias("r")), network)


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced one by one."""
    place = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^0-9]", ""))

    def filled(new: Column) -> Column:
        one = lambda c, i: F.when(c.between("0", "9"), F.substring(new, place(i), F.lit(1))).otherwise(c)
        return F.array_join(F.transform(_characters(shape), one), "")

    return let(digits, filled)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted singly."""
    back = F.reverse(_numbers(digits))
    one = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.transform(back, one), F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        body = F.slice(_numbers(digits), F.lit(2), F.length(digits) - 2)
        new = feistel(body, F.transform(body, lambda _: F.lit(10)), F.concat(F.lit("card"), F.substring(digits, 1, 1)), key)
        open_ = F.concat(F.substring(digits, 1, 1), _joined(new))
        full = let(open_, lambda o: F.concat(o, F.pmod(10 - F.pmod(luhn_sum(F.concat(o, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        good = (F.length(digits).between(13, 19)) & (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0")
        return F.when(good, _refilled(value, full))

    return let(_digits(value), made)


def _phone(value: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        international = value.startswith("+")
        # Country code as far as it can be told without a numbering plan.
        code = F.when(~international, 0).when(digits.rlike("^[17]"), 1).otherwise(2)
        american = ~international | digits.startswith("1")
        national = F.slice(_numbers(digits), code + 1, F.length(digits) - code)
        first = lambda i: american & ((i == 0) | (i == 3))  # noqa: E731  2 to 9 there
        low = F.transform(national, lambda d, i: F.when(first(i), 2).when(i == 0, F.when(d == 0, 0).otherwise(1)).otherwise(0))
        span = F.transform(national, lambda d, i: F.when(first(i), 8).when(i == 0, F.when(d == 0, 1).otherwise(9)).otherwise(10))
        tweak = F.concat(F.lit("phone"), F.when(american, "1").otherwise(F.substring(digits, F.lit(1), code)))
        new = feistel(F.zip_with(national, low, lambda d, s: d - s), span, tweak, key)
        full = F.concat(F.substring(digits, F.lit(1), code), _joined(F.zip_with(new, low, lambda d, s: d + s)))
        ten = (F.length(digits) - code == 10) & digits.rlike("^1?[2-9][0-9]{2}[2-9]")
        good = F.when(american, ten).otherwise(F.length(digits).between(8, 15))
        return F.when(good, _refilled(value, full))

    return let(_digits(value), made)


def _ip(value: Column, key: str) -> Column:
    def made(parts: Column) -> Column:
        good = F.forall(parts, lambda p: p <= 255) & parts[0].between(1, 223) & ~value.rlike("(^|[.])0[0-9]")
        low = F.array(F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        span = F.array(F.lit(223), F.lit(256), F.lit(256), F.lit(256))
        new = feistel(F.zip_with(parts, low, lambda p, s: p - s), span, "ip", key)
        return F.when(good, F.array_join(F.transform(F.zip_with(new, low, lambda p, s: p + s), lambda p: p.cast("string")), "."))

    return let(F.transform(F.split(value, "[.]"), lambda p: p.cast("int")), made)


# Days from 1900 to 2099: 73,049 = 17 * 4,297, a vector of two.
_FIRST_DAY, _HIGH, _LOW = "1900-01-01", 17, 4297


def _new_day(day: Column, key: str) -> Column:
    number = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
    vector = F.array(F.floor(number / _LOW).cast("int"), F.pmod(number, F.lit(_LOW)).cast("int"))
    new = feistel(vector, F.array(F.lit(_HIGH), F.lit(_LOW)), "date", key)
    return let(new, lambda v: F.date_add(F.lit(_FIRST_DAY).cast("date"), v[0] * _LOW + v[1]))


def _date(value: Column, key: str, year: int, month: int, day: int, mark: str, other: tuple[int, int] | None = None) -> Column:
    """Dates with their parts in the given order; ``other`` is a second reading (month,
    day) for those that are no date in the first."""
    parts = F.split(value, f"[{mark}]")

    def read(m: int, d: int) -> Column:
        text = F.concat_ws("-", parts[year], F.lpad(parts[m], 2, "0"), F.lpad(parts[d], 2, "0"))
        return F.when(parts[year].between("1900", "2099"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))

    def written(found: Column, m: int, d: int) -> Column:
        new = _new_day(found, key)

        def shown(n: Column) -> Column:
            padded = (F.length(parts[m]) == 2) & (F.length(parts[d]) == 2)
            two = lambda f: F.when(padded, F.date_format(n, f * 2)).otherwise(F.date_format(n, f))
            order = {year: F.date_format(n, "yyyy"), m: two("M"), d: two("d")}
            return F.concat_ws(mark, *[order[i] for i in range(3)])

        return let(new, shown)

    out = let(read(month, day), lambda f: F.when(f.isNotNull(), written(f, month, day)))
    if other:
        out = F.coalesce(out, let(read(*other), lambda f: F.when(f.isNotNull(), written(f, *other))))
    return out


def _ssn(value: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        good = p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        area = p[0] - 1 - (p[0] > 666).cast("int")
        new = feistel(F.array(area, p[1] - 1, p[2] - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)
        return F.when(
            good,
            let(new, lambda v: F.format_string("%03d-%02d-%04d", v[0] + 1 + (v[0] >= 665).cast("int"), v[1] + 1, v[2] + 1)),
        )

    return let(F.transform(F.split(value, "-"), lambda x: x.cast("int")), made)


def _letter_vector(letters: Column) -> tuple[Column, Column, Column]:
    """First of its kind, values and radices: letters and digits stay what they are."""
    kind = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).when(c.rlike("[a-z]"), 97).otherwise(F.ascii(c))
    low = F.transform(letters, kind)
    values = F.zip_with(letters, low, lambda c, s: F.ascii(c) - s)
    radices = F.transform(low, lambda s: F.when(s == 48, 10).when(s.isin(65, 97), 26).otherwise(1))
    return low, values, radices


def _renamed(text: Column, tweak: str, key: str) -> Column:
    low, values, radices = _letter_vector(_characters(text))
    new = feistel(values, radices, tweak, key)
    return F.array_join(F.zip_with(new, low, lambda v, s: F.char(v + s)), "")


def _email(value: Column, key: str) -> Column:
    return F.concat(_renamed(F.substring_index(value, "@", 1), "email", key), F.lit("@"), F.substring_index(value, "@", -1))


def iban_rest(code: Column) -> Column:
    """An IBAN (without spaces) modulo 97, its first four signs moved to the end."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    one = lambda a, c: F.when(c.between("0", "9"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(_characters(turned), F.lit(0), one)


def _iban(value: Column, key: str) -> Column:
    def made(code: Column) -> Column:
        body = _renamed(F.substring(code, F.lit(5), F.length(code)), "iban", key)
        country = F.substring(code, 1, 2)

        def closed(b: Column) -> Column:
            check = 98 - iban_rest(F.concat(country, F.lit("00"), b))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)

        full = let(body, closed)
        spaced = F.regexp_replace(full, "(.{4})(?=.)", "$1 ")
        return F.when(iban_rest(code) == 1, F.when(value.contains(" "), spaced).otherwise(full))

    return let(F.regexp_replace(value, " ", ""), made)


_MAKERS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "iban": _iban,
    "ip": _ip,
    "iso_date": lambda v, k: _date(v, k, 0, 1, 2, "-"),
    "dot_date": lambda v, k: _date(v, k, 2, 1, 0, "."),
    "slash_date": lambda v, k: _date(v, k, 2, 0, 1, "/", other=(1, 0)),
    "ssn": _ssn,
    "phone": _phone,
    "card": _card,
}


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(value: Column, key: str) -> Column:
    """``kind, value`` of one match; null where it fails its format's check."""

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(PATTERNS):
        made = let(_MAKERS[kind](value, key), named(kind))
        found = F.when(value.rlike(_whole(PATTERNS[kind])), made).otherwise(found)
    return found


def _cards_in(tokens: Column) -> Column:
    """``at, groups, digits`` of the cards in a run of digit groups (``tokens``: groups and
    separators by turns): the longest valid one from each group on; of those that overlap,
    the longest, and the first of equals."""
    n_groups = F.floor((F.size(tokens) + 1) / 2).cast("int")
    text = lambda at, n: F.array_join(F.slice(tokens, 2 * at - 1, 2 * n - 1), "")

    def checked(at: Column, n: Column) -> Column:
        def one(digits: Column) -> Column:
            good = F.length(digits).between(13, 19) & ~digits.startswith("0") & F.when(F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0)
            return F.when(good, F.struct(at.alias("at"), n.alias("groups"), F.length(digits).alias("digits")))

        return let(_digits(text(at, n)), one)

    def valid(at: Column) -> Column:
        sizes = F.sequence(F.least(F.lit(19), n_groups - at + 1), F.lit(1), F.lit(-1))
        return F.filter(F.transform(sizes, lambda n: checked(at, n)), lambda c: c.isNotNull())

    first = lambda at: F.get(valid(at), F.lit(0))  # noqa: E731  null if none is valid
    card = "struct<at:int,groups:int,digits:int>"
    none = F.lit(None).cast(card)
    after = lambda a, b: a["at"] + a["groups"] <= b["at"]

    def step(state: Column, c: Column) -> Column:
        done, last, lost = state["done"], state["last"], state["lost"]
        fresh = last.isNull() | after(last, c)
        won = ~fresh & (c["digits"] > last["digits"])
        free = won & lost.isNotNull() & after(lost, c)  # lost to one that now loses
        more = F.when(fresh & last.isNotNull(), F.concat(done, F.array(last))).when(free, F.concat(done, F.array(lost))).otherwise(done)
        return F.struct(
            more.alias("done"), F.when(fresh | won, c).otherwise(last).alias("last"),
            F.when(fresh | free, none).when(won, last).otherwise(lost).alias("lost"),
        )

    start = F.struct(F.array().cast(f"array<{card}>").alias("done"), none.alias("last"), none.alias("lost"))
    found = F.filter(F.transform(F.sequence(F.lit(1), n_groups), first), lambda c: c.isNotNull())
    return F.aggregate(found, start, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))


def _piece(text: Column, is_value: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(is_value).alias("is_value"))


def _run_pieces(run: Column) -> Column:
    """A run of digit groups as the cards in it and the text between them."""

    def cut(v: Column) -> Column:
        tokens, cards = v["tokens"], v["cards"]
        joined = lambda first, n: F.array_join(F.slice(tokens, first, n), "")
        # first token after a card
        behind = lambda c: 2 * (c["at"] + c["groups"] - 1)

        def one(c: Column, i: Column) -> Column:
            first = F.when(i == 0, F.lit(1)).otherwise(behind(F.get(cards, i - 1)))
            return F.array(_piece(joined(first, 2 * c["at"] - 1 - first), False), _piece(joined(2 * c["at"] - 1, 2 * c["groups"] - 1), True))

        rest = F.when(F.size(cards) == 0, F.lit(1)).otherwise(behind(F.element_at(cards, -1)))
        return F.concat(F.flatten(F.transform(cards, one)), F.array(_piece(joined(rest, F.size(tokens) - rest + 1), False)))

    tokens = F.regexp_extract_all(run, F.lit("[0-9]+|[ -]"), F.lit(0))
    both = lambda t: F.struct(t.alias("tokens"), _cards_in(t).alias("cards"))
    return let(let(tokens, both), cut)


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, found`` for every row: the text with pseudonyms, and these in order
    as ``kind, value``.

    Values keep their separators, leading signs and kind; the pseudonym of a value depends
    on the key and its normal form only, so spellings of one number or date stay linked. A
    null text stays null with nothing found, an empty one stays empty. What fails its check
    is left as it is. Repeated rows and null ids pass through, other columns are ignored.
    """
    text = F.col("text")
    parts = F.split(text, ANY, -1)
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def pieces(part: Column, match: Column) -> Column:
        # zip_with gives a null match after the last part.
        values = F.when(match.rlike(_whole(PATTERNS["card"])), _run_pieces(match)).when(match.isNotNull(), F.array(_piece(match, True)))
        return F.when(match.isNull(), F.array(_piece(part, False))).otherwise(F.concat(F.array(_piece(part, False)), values))

    def shown(piece: Column) -> Column:
        made = F.when(piece["is_value"], pseudonym(piece["text"], key))
        return let(made, lambda p: F.struct(p["kind"].alias("kind"), F.coalesce(p["value"], piece["text"]).alias("value")))

    new = F.transform(F.flatten(F.zip_with(parts, matches, pieces)), shown)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.when(text.rlike(HINT), new).alias("new"))
    joined = F.array_join(F.transform("new", lambda n: n["value"]), "")
    return rows.select(
        "doc_id", F.when(F.col("new").isNull(), F.col("text")).otherwise(joined).alias("text"),
        F.coalesce(F.filter("new", lambda n: n["kind"].isNotNull()), F.array().cast("array<struct<kind:string,value:string>>")).alias("found"),
    )
