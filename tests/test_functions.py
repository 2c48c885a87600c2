"""Scalar columns against literal cases and Python's own standard library."""

import html
import random
import re
from datetime import datetime
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from newsgrist.fixed_values import TIGHT_PUNCTUATION
from newsgrist.functions import text, times, urls


def test_clean_text(column_of):
    cases = ["AT&amp;T &quot;quoted&quot;", None, "", "  a b \n c\x1c", "&amp;lt;b&amp;gt;",
             "&copy 1", "&notit; & &#x41;&#66", "a&nbsp;b", "&&lt;amp;", "&am&amp;p;", "&#&amp;"]
    want = [" ".join(html.unescape(c or "").split()) for c in cases]
    assert column_of(text.clean_text, cases) == want


def test_white_space_runs(column_of):
    rng = random.Random(3)
    bits = [" ", "  ", "a", "\n", "\x1c", "\u3000", "é", "\U0001f600", ",", ".", "\u180e", "\xa0"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    spaces = [chr(n) for n in range(0x3100)]
    cases += [f"a{x}b {x}c{x} .{x}{x},{x}" for x in spaces if x.isspace() or x in "\u180e\u200b\ufeff!~"]
    assert column_of(text.collapse, cases) == [" ".join(c.split()) for c in cases]
    tight = [" ".join(re.sub(rf"\s+([{TIGHT_PUNCTUATION}])", r"\1", c).split()) or None for c in cases]
    assert column_of(text.clean_description, cases) == tight


def test_unescape_random(column_of):
    rng = random.Random(5)
    bits = ["&", "amp", ";", "lt", "quot", "#39", "#", "x", "41", "copy", " ", "a", "nbsp", "<",
            "&amp;", "&gt;", "&eacute;", "\n", "not", "in", "é", "&#0;", "&#x80;"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    assert column_of(text.unescape, cases) == [html.unescape(c) for c in cases]


def test_unescape_all_names(column_of):
    names = sorted(html.entities.html5)
    cases = [f"x&{n}{after}" for n in names for after in ("", " y", "z;")] + [f"&{n[:-1]}" for n in names]
    cases += ["&" + n[:k] + "&lt" for n in names[::40] for k in range(len(n))] + ["&" + "q" * 40 + ";", "&notin" + "a" * 40]
    assert column_of(text.unescape, cases) == [html.unescape(c) for c in cases]


def test_unescape_numbers(column_of):
    rng = random.Random(7)
    numbers = [*range(0x300), *range(0xD7F0, 0xE010), *range(0xFDC0, 0xFE00), *(p + d for p in range(0x10000, 0x120000, 0x10000) for d in range(-4, 4))]
    numbers += [rng.randrange(0x110000) for _ in range(2000)] + [10**7, 10**8 - 1, 10**30, 16**6, 16**7, 2**64]
    cases = [f"a&#{n}{end}" for n in numbers for end in (";", "b", " ")] + [f"&#{x}{n:{z}x};c" for n in numbers for x, z in (("x", ""), ("X", "09"))]
    assert column_of(text.unescape, cases) == [html.unescape(c) for c in cases]


def test_titles_and_descriptions(column_of):
    assert column_of(text.clean_title, ["  <h1>New Python 3.13 &amp; AI Release</h1>\n", None, "a<br>b"]) == [
        "New Python 3.13 & AI Release", "", "a b"]
    cases = ["<p>Check out the <a href='…'>link</a> &amp; details.</p>", "   ", "", None,
             "a <b>x</b> , y", "one<link rel=x>two<i>three</i>", "a&nbsp;.", "x<P>y</Div>z  !",
             "a  \n .", "< p>", "a<>b"]
    assert column_of(text.clean_description, cases) == [
        "Check out the link & details.", None, None, None, "a x, y", "one twothree", "a .",
        "x y z!", "a.", None, "a<>b"]


def test_title_key(column_of):
    cases = ["\t{Poll} Who *still* writes C_89?  (2031) ", "Ünïcode—Wörd!", "x / y", "R&amp;amp;D", "?!"]
    assert column_of(text.title_key, cases) == ["poll who still writes c_89 2031", "ünïcodewörd", "x y", "rampd", ""]
    assert column_of(text.source_key, ["\n Daily Post  ", None]) == ["daily post", ""]


def test_strip_is_python_strip(column_of):
    cases = ["\x1f a 　", " x\x85", "", "   ", "a\n\nb \n"]
    assert column_of(text.strip, cases) == [c.strip() for c in cases]
    assert column_of(text.is_blank, [None, "", " \t\x1c", "a "]) == [True, True, True, False]


def test_truncate(spark):
    cases = [("seven ships sail south", 16, "seven ships..."), ("unbroken", 6, "unb..."), ("unbroken", 3, "unb"),
             ("unbroken", 8, "unbroken"), (" leading word", 8, " lead..."), ("p q r s t u", 9, "p q r..."),
             ("gap    wide gap", 8, "gap..."), ("any", -1, ""), ("ö" * 12, 7, "öööö...")]
    rows = spark.createDataFrame(cases, "t string, n int, want string")
    got = rows.select("want", text.truncate(F.col("t"), F.col("n")).alias("y")).collect()
    assert [r.y for r in got] == [r.want for r in got]


def test_truncate_keeps_the_bound(spark):
    rng = random.Random(4)
    cases = [("".join(rng.choice("ab é  ") for _ in range(rng.randint(0, 30))), rng.randint(0, 30)) for _ in range(300)]
    rows = spark.createDataFrame(cases, "t string, n int")
    for r in rows.select("t", "n", text.truncate(F.col("t"), F.col("n")).alias("y")).collect():
        assert len(r.y) <= max(r.n, 0) and (r.y == r.t if len(r.t) <= r.n else r.t.startswith(r.y.removesuffix("...")))


def test_markup_and_thousands(column_of):
    assert column_of(text.escape_markup, ["<a> & \"b\"", "&lt;"]) == [
        '&lt;a&gt; &amp; "b"', "&amp;lt;"]
    assert column_of(text.thousands, ["12500", "12k+", "-1234567", None, "7"]) == [
        "12,500", "12k+", "-1,234,567", None, "7"]


URL_CASES = {
    "\tFTP://Files.Net/Pub ": "ftp://files.net/Pub",
    "https://files.net": "https://files.net/",
    "https://files.net:443?z": "https://files.net/?z=",
    "http://files.net:80/a/": "http://files.net/a/",
    "https://files.net:80/": "https://files.net:80/",
    "http://files.net/x?ref_src=1&utm_campaign=c&b=2&gclid=7&a=1": "http://files.net/x?a=1&b=2&ref_src=1",
    "http://files.net/x?w=red+blue%20green&v=%41": "http://files.net/x?v=A&w=red+blue+green",
    "http://files.net/x#part?y=1": "http://files.net/x",
    "http://files.net////deep//er///": "http://files.net/deep/er/",
    "http://Me:Secret@Files.Net/%2Fx": "http://me:secret@files.net/%2Fx",
    "http://files.net/?k=&l&m=%q": "http://files.net/?k=&l=&m=%25q",
    "http://files.net/?MC_CID=x&Utm_Term=y&FBCLID=1": "http://files.net/",
    "http://files.net/?s=.-~*_ß%fe": "http://files.net/?s=.-~%2A_%C3%9F%EF%BF%BD",
    "http://files.net/?n=2&&n=1&n": "http://files.net/?n=&n=1&n=2",
    "http://files.net/?e=f=g": "http://files.net/?e=f%3Dg",
    "": "", None: "", " \n ": "/",
    "tel:+49-Q": "tel:+49-Q", "/only/here?b=2": "/only/here?b=2",
    "ftp:/lone": "ftp:///lone", "files.net/y": "files.net/y",
    "//Cdn/z": "//cdn/z", "ht\ttp://files.net/\ny": "http://files.net/y",
    "http://[::2]:80/w": "http://[::2]/w", "9http://y/": "9http:/y/",
}


def test_canonical_url_literals(column_of):
    assert column_of(urls.canonical_url, list(URL_CASES)) == list(URL_CASES.values())


def test_canonical_query_random(column_of):
    rng = random.Random(9)
    bits = ["a", "=", "&", "+", "%41", "%", "%zz", "%e9", "%C3%A9", "é", " ", "utm_id", "~", "*",
            ";", "?", "/", "%2", "b", "%26", "%3D", "'", "€"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 10))) for _ in range(800)]
    want = [urlencode(sorted(p for p in parse_qsl(c, keep_blank_values=True) if p[0].lower() != "utm_id"))
            for c in cases]
    assert column_of(urls.canonical_query, cases) == want


def test_url_parts_random(column_of):
    rng = random.Random(11)
    bits = ["http:", "https:", "//", "/", "?", "#", "a.com", ":80", ":443", "@", "x", ":", "ftp:",
            " ", "\n", "é", "A", "1", "+", "."]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(800)]

    got = column_of(urls.canonical_url, cases)
    steady = [u for u in got if u == u.strip() and urlsplit(u).scheme]
    assert column_of(urls.canonical_url, steady) == steady  # a canonical url is its own
    for url in got:
        parts = urlsplit(url)
        assert parts.fragment == "" and "//" not in parts.path.removeprefix("//") and parts.netloc == parts.netloc.lower()
        pairs = parse_qsl(parts.query, keep_blank_values=True)
        assert pairs == sorted(pairs)
        assert not (parts.scheme == "http" and parts.netloc.endswith(":80"))


def test_url_error(column_of):
    cases = ["http://[bad/x", "http://bad]/x", "http://[zz]/", "http://[::1]/", "http://[1::2:3]/",
             "http://[1:2:3:4:5:6:7:8]/", "http://[1:2:3]/", "http://[v1.x]/", "http://[::1.2.3.4]/",
             "http://[1.2.3.4]/", "http://a／b/", "http://ok/[", "", "http://[fe80::1%eth0]/",
             "http://[1:2:3:4:5:6:7::]/", "http://[::2:3:4:5:6:7:8]/", "http://[1::2::3]/"]

    def fails(url):
        try:
            urlsplit(url)
        except ValueError:
            return True
        return False

    assert [m is not None for m in column_of(urls.url_error, cases)] == [fails(c) for c in cases]


TIMES = {
    'Sat, 19 Sep 2026 10:00:00 +0000': datetime(2026, 9, 19, 10, 0),
    'invalid-date-string': None,
    '': None,
    '2026': None,
    '2026-09': None,
    '12:00': None,
    '20260919': datetime(2026, 9, 19, 0, 0),
    '20260919T120000Z': datetime(2026, 9, 19, 12, 0),
    '2026-W38-6': datetime(2026, 9, 19, 0, 0),
    '2026-09-19T12': datetime(2026, 9, 19, 12, 0),
    '2026-09-19T': None,
    '2026W386T10': datetime(2026, 9, 19, 10, 0),
    '2026-W53-1': datetime(2026, 12, 28, 0, 0),
    '2020-W53-7': datetime(2021, 1, 3, 0, 0),
    '2026-09-19 10:20:30,1234567+01:00:30': datetime(2026, 9, 19, 9, 20, 0, 123456),
    '2026-09-19T24:00': None,
    '2026-09-19T10:2030': None,
    '2026-09-19T1020:30': None,
    '2026-09-19T1020': datetime(2026, 9, 19, 10, 20),
    '2026-02-30': None,
    '2024-02-29': datetime(2024, 2, 29, 0, 0),
    '2026-09-19T10.5': datetime(2026, 9, 19, 10, 0, 0, 500000),
    '2026-09-19T10:20+0130': datetime(2026, 9, 19, 8, 50),
    '2026-09-19é10': datetime(2026, 9, 19, 10, 0),
    '2026-09-1910': None,
    '0000-01-01': None,
    '2026-09-19T10:20:30z': None,
    '2026-09-19T10:20:30-00:00': datetime(2026, 9, 19, 10, 20, 30),
    '2026-09-19T10:20:30+23:59:59.5': datetime(2026, 9, 18, 10, 20, 30, 500000),
    '19 Sep 2026 10:00 GMT': datetime(2026, 9, 19, 10, 0),
    'Sat 19 Sep 2026 10:00:00 EST': datetime(2026, 9, 19, 15, 0),
    'Sep 19 2026 10:00:00 PDT': datetime(2026, 9, 19, 17, 0),
    'Sat Sep 19 10:00:00 2026': datetime(2026, 9, 19, 10, 0),
    'Saturday, 19-Sep-26 10:00:00 GMT': datetime(2026, 9, 19, 10, 0),
    '19 Sep 70 10:00:00 XYZ': datetime(1970, 9, 19, 10, 0),
    'Sat,19 Sep 2026 10:00:00 -0530': datetime(2026, 9, 19, 15, 30),
    '19 September 2026 10:00:00 +0200 (CEST)': datetime(2026, 9, 19, 8, 0),
    '31 Feb 2026 10:00:00 GMT': None,
    'Sat, 19 Sep 2026 25:00:00 GMT': None,
    '19 Sept 2026 10:00:00 GMT': None,
    '19 Sep 2026': None,
    'Sat, 19 Sep 2026 10:00:00': datetime(2026, 9, 19, 10, 0),
    'Sat, 19 Sep 2026 10:00:00+0200': datetime(2026, 9, 19, 8, 0),
    '19 Sep 2026 10:00:60 GMT': None,
    ' 2026-09-19T10:00:00+02:00 ': datetime(2026, 9, 19, 8, 0),
    'Sat, 19 Sep 2026 10:00:00 +9999': None,
    'Sat, 19 Sep 2026\n 10:00:00 ut': datetime(2026, 9, 19, 10, 0),
}


@pytest.mark.parametrize("chunk", [0, 1])
def test_parse_timestamp(column_of, chunk):
    cases = list(TIMES)[chunk::2]
    assert dict(zip(cases, column_of(times.parse_timestamp, cases))) == {c: TIMES[c] for c in cases}
    assert column_of(times.parse_timestamp, [None]) == [None]


def test_epoch_and_display(column_of):
    assert column_of(times.epoch_timestamp, ["1700000000", "1700000000.5", "x", None, "1e30"]) == [
        datetime(2023, 11, 14, 22, 13, 20), datetime(2023, 11, 14, 22, 13, 20, 500000), None, None, None]
    assert column_of(times.display_time, [datetime(2026, 9, 19, 10, 5)], "timestamp") == ["2026-09-19 10:05 UTC"]


def test_entities_need_no_python(spark):
    """Decoding is built-ins only, and the map of names is folded to one literal."""
    rows = spark.createDataFrame([("a&eacute;b",)], "t string").repartition(1)
    plan = rows.select(text.clean_text(F.col("t")).alias("t"))._jdf.queryExecution()
    assert "Python" not in plan.executedPlan().toString()
    assert "str_to_map" not in plan.optimizedPlan().toString()
