"""OUT-1..5, DQ-2, DQ-3, SRC-17."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsgrist import fixed_values as fixed
from newsgrist.operators import outbox, quality
from newsgrist.schema import METADATA

SCHEMA = ("id int, title string, url string, source string, author string, published_at timestamp,"
          f" description string, categories array<string>, metadata {METADATA}")
META = [f.split(":")[0] for f in METADATA[7:-1].split(",")]
LONG = "word " * 60


ROWS = [
    dict(title="A <b> & c", url="https://e.com/?a=1&b=2", source=" Feed ", author="Ann", published_at=datetime(2026, 9, 19, 10, 5),
         description="Some <text> & more", categories=["AI", " ", "Go"], metadata={"stars": "12500", "language": " Go ", "score": "7"}),
    dict(title="", url="", source="", author=" ", published_at=None, description="", categories=[], metadata=None),
    dict(title="T" * 120, url="https://e.com/x", source="s", author=None, published_at=None, description=LONG, categories=None,
         metadata={"stars": "12k+", "language": ""}),
    dict(title="Many words in this title " * 6, url="https://e.com/y", source="s", author=None, published_at=None,
         description="&" * 300, categories=["X"], metadata={}),
    dict(title="  ", url=" https://e.com/z ", source=None, author="é" * 50, published_at=None, description=" d ", categories=[None, "B"], metadata=None),
]


# Written out for each bound of the message and of its text.
MESSAGES = {
    (4096, 400): [
        '<b>[AI, Go]</b>\n\n<b>A &lt;b&gt; &amp; c</b>\n\nSource: Feed\nStars: 12,500\nLanguage: Go\nScore: 7\nAuthor: Ann\nPublished: 2026-09-19 10:05 UTC\n\nSome &lt;text&gt; &amp; more\n\nRead more: https://e.com/?a=1&amp;b=2',
        '<b>Untitled</b>',
        '<b>[s]</b>\n\n<b>' + 'T' * 120 + '</b>\n\nSource: s\nStars: 12k+\n\n' + 'word ' * 59 + 'word\n\nRead more: https://e.com/x',
        '<b>[X]</b>\n\n<b>' + 'Many words in this title ' * 5 + 'Many words in this title</b>\n\nSource: s\n\n' + '&amp;' * 300 + '\n\nRead more: https://e.com/y',
        '<b>[B]</b>\n\n<b></b>\n\nAuthor: ' + 'é' * 50 + '\n\nd\n\nRead more: https://e.com/z',
    ],
    (250, 400): [
        '<b>[AI, Go]</b>\n\n<b>A &lt;b&gt; &amp; c</b>\n\nSource: Feed\nStars: 12,500\nLanguage: Go\nScore: 7\nAuthor: Ann\nPublished: 2026-09-19 10:05 UTC\n\nSome &lt;text&gt; &amp; more\n\nRead more: https://e.com/?a=1&amp;b=2',
        '<b>Untitled</b>',
        '<b>[s]</b>\n\n<b>' + 'T' * 120 + '</b>\n\nSource: s\nStars: 12k+\n\n' + 'word ' * 10 + 'word...\n\nRead more: https://e.com/x',
        '<b>[X]</b>\n\n<b>' + 'Many words in this title ' * 5 + 'Many words in this title</b>\n\nSource: s\n\nRead more: https://e.com/y',
        '<b>[B]</b>\n\n<b></b>\n\nAuthor: ' + 'é' * 50 + '\n\nd\n\nRead more: https://e.com/z',
    ],
    (140, 60): [
        'Read more: https://e.com/?a=1&amp;b=2',
        '<b>Untitled</b>',
        '<b>[s]</b>\n\n<b>' + 'T' * 67 + '...</b>\n\nSource: s\nStars: 12k+\n\nRead more: https://e.com/x',
        '<b>[X]</b>\n\n<b>' + 'Many words in this title ' * 2 + 'Many words in this title...</b>\n\nSource: s\n\nRead more: https://e.com/y',
        '<b>[B]</b>\n\n<b></b>\n\nAuthor: ' + 'é' * 50 + '\n\nd\n\nRead more: https://e.com/z',
    ],
    (50, 20): [
        'Read more: https://e.com/?a=1&amp;b=2',
        '<b>Untitled</b>',
        'Read more: https://e.com/x',
        'Read more: https://e.com/y',
        'Read more: https://e.com/z',
    ],
    (90, 0): [
        'Read more: https://e.com/?a=1&amp;b=2',
        '<b>Untitled</b>',
        '<b>[s]</b>\n\n<b>TTTTTTTTTTTTTTTTT...</b>\n\nSource: s\nStars: 12k+\n\nRead more: https://e.com/x',
        '<b>[X]</b>\n\n<b>Many words in this title...</b>\n\nSource: s\n\nRead more: https://e.com/y',
        'Read more: https://e.com/z',
    ],
    (20, 400): [
        'Read more: https://e.com/?a=1&amp;b=2',
        '<b>Untitled</b>',
        'Read more: https://e.com/x',
        'Read more: https://e.com/y',
        'Read more: https://e.com/z',
    ],
}


@pytest.mark.parametrize("limit,cap", MESSAGES)
def test_messages(spark, limit, cap):
    data = []
    for i, r in enumerate(ROWS):
        meta = None if r["metadata"] is None else tuple(r["metadata"].get(m) for m in META)
        data.append((i, r["title"], r["url"], r["source"], r["author"], r["published_at"], r["description"], r["categories"], meta))
    out = outbox.with_message(spark.createDataFrame(data, SCHEMA).repartition(2), limit, cap).orderBy("id").collect()
    assert [r.message for r in out] == MESSAGES[limit, cap]


def test_masking(column_of, spark):
    pat = "github_pat_" + "a" * 82
    texts = ["key=hunter22 hunter2", f"x {pat} y", "ghp_" + "A1" * 18 + ".", "bot 12345678:" + "x" * 35, "abc", None]
    got = column_of(lambda c: quality.mask(c, ["hunter2", "hunter22", "abc", "", None]), texts)
    m = fixed.MASK
    assert got == [f"key={m} {m}", f"x {m} y", f"{m}.", f"bot {m}", "abc", None]
    df = spark.createDataFrame([(1, "secret secret", "no"), (2, None, f"{m} secret")], "id int, a string, b string")
    out = quality.mask_columns(df, ["a", "b"], ["secret"]).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, f"{m} {m}", "no", 2), (2, None, f"{m} {m}", 1)]


def test_many_secrets_in_one_pass(column_of, spark):
    rng = random.Random(11)
    secrets = sorted({"".join(rng.choice("ab.$é\\(\n") for _ in range(rng.randint(4, 9))) for _ in range(400)})
    texts = ["".join(rng.choice([rng.choice(secrets), "ab", "x", " "]) for _ in range(rng.randint(0, 8))) for _ in range(200)]

    def masked(t):
        out, i = "", 0
        while i < len(t):
            here = max((s for s in secrets if t.startswith(s, i)), key=len, default=None)
            out += fixed.MASK if here else t[i]
            i += len(here) if here else 1
        return out

    assert column_of(lambda c: quality.mask(c, secrets, []), texts) == [masked(t) for t in texts]
    numbers = [str(n) for n in range(10_000, 15_000)]
    assert column_of(lambda c: quality.mask(c, numbers, []), ["a 12345 b 9999 c 150001 14999"]) == [
        f"a {fixed.MASK} b 9999 c 150001 {fixed.MASK}"]
    plan = spark.createDataFrame([("x",)], "t string").select(quality.mask(F.col("t"), numbers, []).alias("y"))
    assert plan._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_rule_audit(spark):
    rules = quality.rules_frame(spark, {" AI ": [" llm ", "", 5, "ml"], "Empty": [" "], " ": ["x"]})
    assert [(r.category, r.kw_ord, r.keyword) for r in rules.orderBy("cat_ord", "kw_ord").collect()] == [
        ("AI", 0, "llm"), ("AI", 1, "ml"), ("Empty", None, None), ("", 0, "x")]
    assert {(r.rule, r.key) for r in quality.audit_rules(rules).collect()} == {
        ("category name is blank", "2"), ("category has no keywords", "Empty")}
    defaults = quality.rules_frame(spark, fixed.DEFAULT_RULES)
    assert defaults.count() == 118 and quality.audit_rules(defaults).count() == 0


def test_rules_of_a_table(spark):
    rows = [(1, " B ", 0, "c++"), (0, "A", 1, "y "), (0, "A", 0, "x"), (0, "A", 2, " ")]
    rules = quality.rules_of(spark.createDataFrame(rows, quality.RULE_SCHEMA), threshold=2)
    assert rules.categories == {"A": ["x", "y"], "B": ["c++"]} and rules.threshold == 2
    with pytest.raises(ValueError, match="no keywords: B"):
        quality.rules_of(spark.createDataFrame([(0, "A", 0, "x"), (1, "B", 0, " ")], quality.RULE_SCHEMA))


def test_source_audit(spark):
    from newsgrist.schema import SOURCE_SCHEMA

    rows = [
        (0, "feed", "ok", True, 5, "https://x", [], None, []), (1, "feed", "nourl", True, 5, " ", [], None, []),
        (2, "feed", "ftp", True, 5, "ftp://x", [], None, []), (3, "feed", "off", False, 5, "", [], None, []),
        (4, "stories", "hn", True, 0, None, [], "", []), (5, "repos", "gh", True, 5, None, [], None, [" "]),
        (6, "feed", " ", True, 5, "http://x", [], None, None), (6, "feed", "same", True, 5, "http://x", [], None, None),
    ]
    got = {(r.rule, r.key) for r in quality.audit_sources(spark.createDataFrame(rows, SOURCE_SCHEMA)).collect()}
    assert got == {("feed has no url", "nourl"), ("feed url is not http", "ftp"), ("max_items is not positive", "hn"),
                   ("source rank is not unique", "6"), ("story feed is blank", "hn"), ("no search queries", "gh"), ("source name is blank", " ")}


@pytest.mark.parametrize("bad", [dict(threshold=-1), dict(threshold="3"), dict(weights=("a",)), dict(max_age_hours=0),
                                 dict(limit=0), dict(limit=True), dict(limit=2.5)])
def test_bad_numbers(bad):
    good = dict(threshold=3, weights=(3, 1, 1), max_age_hours=48, limit=50)
    quality.check_numbers(**good)
    with pytest.raises(ValueError):
        quality.check_numbers(**{**good, **bad})


def test_delivery_counts(spark):
    df = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "id string, ok boolean")
    assert outbox.delivery_counts(df).first().asDict() == {"sent_articles": 2, "failed_notifications": 1}
    assert df.select(F.count("*")).first()[0] == 3
