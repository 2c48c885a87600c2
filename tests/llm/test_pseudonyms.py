"""The column network against one in plain Python, and formats against their checks."""

import hashlib
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from newsgrist.llm.pseudonyms import ROUNDS, feistel, pseudonymise

KEY = "k1"


def plain_feistel(values, radices, tweak, key):
    half = len(values) // 2
    a, ra, b, rb = values[:half], radices[:half], values[half:], radices[half:]
    for turn in range(ROUNDS):
        said = "|".join([key, tweak, str(turn), ",".join(map(str, b))])
        draw = [int(hashlib.sha256(f"{said}|{i}".encode()).hexdigest()[:12], 16) for i in range(len(a))]
        a, ra, b, rb = b, rb, [(x + d) % r for x, d, r in zip(a, draw, ra)], ra
    return a + b


@pytest.mark.parametrize("radices", [[], [7], [10, 10], [3, 5, 2], [17, 4297], [10] * 15, [223, 256, 256, 256]])
def test_network(spark, radices):
    rows = [[(7 * k + i) % r for i, r in enumerate(radices)] for k in range(20)]
    frame = spark.createDataFrame([(r, radices) for r in rows], "v array<int>, r array<int>")
    out = frame.select("v", feistel(F.col("v"), F.col("r"), "t", KEY).alias("e"), "r")
    got = out.select("v", "e", feistel(F.col("e"), F.col("r"), "t", KEY, back=True).alias("back")).collect()
    for row in got:
        assert row.e == plain_feistel(row.v, radices, "t", KEY) and row.back == row.v


def test_network_permutes_a_whole_domain(spark):
    frame = spark.range(3 * 5 * 7).selectExpr("array(cast(id % 3 as int), cast(id div 3 % 5 as int), cast(id div 15 as int)) as v")
    out = frame.select(feistel(F.col("v"), F.array(F.lit(3), F.lit(5), F.lit(7)), "t", KEY).alias("e")).collect()
    assert len({tuple(r.e) for r in out}) == 105


def run(docs, texts, key=KEY):
    got = pseudonymise(docs(list(enumerate(texts))), key).collect()
    return [r.text for r in sorted(got, key=lambda r: r.doc_id)]


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_cards(docs):
    given = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "6011000990139424", "4111111111111112", "41111111111111"]
    got = run(docs, [f"pay {g}, now" for g in given])
    new = [re.search(r"pay (.*), now", t)[1] for t in got]
    assert all(luhn(n) and n != g and n[0] == g[0] for n, g in zip(new[:5], given))
    assert re.sub("[ -]", "", new[1]) == new[0] == re.sub("[ -]", "", new[2])
    assert [re.sub("[0-9]", "9", n) for n in new] == [re.sub("[0-9]", "9", g) for g in given]
    assert new[5:] == given[5:]


def test_cards_beside_other_numbers(docs):
    card, other = "4111111111111111", "378282246310005"
    spaced = "4111 1111 1111 1111"
    given = [
        f"{card} 123", f"{spaced} 12/25", f"order 7 {card}", f"12 33 {spaced} 57-78", f"{card} {other} 9", f"1-{spaced.replace(' ', '-')}-2",
        f"{card} 2024-05-05", f"{card} 22.206.191.89", f"{card} 547-555-0128", f"{card} 547.555.0128", f"{card} 12ab", f"{card} 2024-05-05T10:00:00Z",
        "1 2 3 4 5 6 7 8 9 10 11 12", "12345678901234567890", f"{card}2 1",
    ]
    alone = run(docs, [card, spaced, other, "2024-05-05", "22.206.191.89", "547-555-0128", "547.555.0128", spaced.replace(" ", "-")])
    c, sp, o, day, ip, phone, dotted, hyphens = alone
    assert run(docs, given) == [
        f"{c} 123", f"{sp} 12/25", f"order 7 {c}", f"12 33 {sp} 57-78", f"{c} {o} 9", f"1-{hyphens}-2",
        f"{c} {day}", f"{c} {ip}", f"{c} {phone}", f"{c} {dotted}", f"{c} 12ab", f"{c} {day}T10:00:00Z", *given[12:],
    ]
    found = pseudonymise(docs([(1, given[4])]), KEY).first().found
    assert [(f.kind, f.value) for f in found] == [("card", c), ("card", o)]


def test_dates_of_timestamps(docs):
    given = ["2024-01-05", "2024-01-05T10:00:00Z", "2024-01-05t10", "2024-01-05T1000+01:00", "at 2024-01-05T10Z.", "2024-01-05Tx", "2024-01-05T99:00"]
    got = run(docs, given)
    assert got[0] != given[0] and got[1:5] == [g.replace(given[0], got[0]) for g in given[1:5]] and got[5:] == given[5:]


def test_long_tables_of_numbers(docs):
    text = "10 20 30 40 " * 5_000
    got = run(docs, [text + "x 4111111111111111", text.replace(" ", "-") + "x"])
    assert luhn(got[0][-16:]) and got[0][-16:] != "4111111111111111" and [len(g) for g in got] == [len(text) + 18, len(text) + 1]


def test_dates(docs):
    got = run(docs, ["2024-02-29", "29.02.2024", "2/29/2024", "29/2/2024", "2023-02-29", "31.12.1999", "13/13/2020", "1850-01-01", "9999-12-31"])
    new = date.fromisoformat(got[0])
    assert got[1] == new.strftime("%d.%m.%Y") and got[2] == f"{new.month}/{new.day}/{new.year}" and got[3] == f"{new.day}/{new.month}/{new.year}"
    assert got[4] == "2023-02-29" and got[6:] == ["13/13/2020", "1850-01-01", "9999-12-31"]
    assert date(1900, 1, 1) <= new <= date(2099, 12, 31) and got[5] != "31.12.1999"


def test_all_dates_are_permuted(spark):
    days = spark.range(73_049).selectExpr("id as doc_id", "cast(date_add(date'1900-01-01', cast(id as int)) as string) as text")
    got = pseudonymise(days, KEY)
    assert got.select("text").distinct().count() == 73_049
    assert got.agg(F.min("text"), F.max("text")).first()[:] == ("1900-01-01", "2099-12-31")


def test_other_formats(docs):
    given = [
        "call +1 (547) 555-0128.", "call (547) 555-0128", "call 547-555-0128", "+49 30 1234567", "from 22.206.191.89.", "not 300.1.1.1",
        "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "123-45-6789", "666-45-6789",
        "mail a.b32@mail8.example.com.", "v1.2.3", "42", "+1 (147) 555-0128",
    ]
    got = run(docs, given)
    last = lambda t: re.sub(r"\D", "", t)[-10:]
    assert last(got[0]) == last(got[1]) == last(got[2]) != "5475550128" and re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}\.", got[0])
    assert re.fullmatch(r"\+49 \d\d \d{7}", got[3]) and got[3] != given[3]
    octets = re.fullmatch(r"from (\d+)\.(\d+)\.(\d+)\.(\d+)\.", got[4]).groups()
    assert all(int(o) < 256 for o in octets) and got[4] != given[4]
    code = got[6]
    assert int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 and code[:2] == "DE" and code != given[6]
    assert got[7].replace(" ", "") == code and len(got[7]) == len(given[7])
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[9]) and got[9] != given[9]
    assert re.fullmatch(r"mail [a-z]\.[a-z]\d\d@mail8\.example\.com\.", got[11]) and got[11] != given[11]
    for same in (5, 8, 10, 12, 13, 14):
        assert got[same] == given[same]


def test_keys_matter_and_documents_do_not(docs):
    text = "x 4111111111111111 y 2020-05-05 z 4111111111111111"
    one, two = run(docs, [text, "again: 4111111111111111"])
    card = re.findall(r"\d{16}", one)
    assert card[0] == card[1] == re.search(r"\d{16}", two)[0]
    assert run(docs, [text], "k2")[0] != one


def test_odd_rows(docs):
    long = "word " * 50_000 + "4111111111111111"
    rows = [(1, None), (2, ""), (None, "2020-05-05"), (3, "dup 2020-05-05"), (3, "dup 2020-05-05"), (4, long), (5, "2020-05-05")]
    got = pseudonymise(docs(rows), KEY)
    assert got.columns == ["doc_id", "text", "found"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.text, [f.kind for f in r.found]))
    assert by[1] == [(None, [])] and by[2] == [("", [])] and len(by[3]) == 2 and by[3][0] == by[3][1]
    assert by[None][0][0] == by[5][0][0] == by[3][0][0][4:] and by[5][0][1] == ["iso_date"]
    assert by[4][0][0].startswith("word word") and luhn(by[4][0][0][-16:]) and len(by[4][0][0]) == len(long)
    assert pseudonymise(docs([]), KEY).count() == 0


def test_no_python_in_the_plan(docs):
    plan = pseudonymise(docs([(1, "a")]), KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
