"""JN-1, JN-2, AGG-1..3, JOB-1, JOB-2 on literal cases."""

import random

from newsgrist.functions.patterns import any_keyword_pattern
from newsgrist.operators.filters import relevant
from newsgrist.operators.relevance import Rules, keyword_matches, score
from newsgrist.plans.jobs import batch_job, score_job

AI_PY = Rules({"AI": ["artificial intelligence", "llm"], "Programming": ["python", "go", "c++"]})
RAW = ("source string, title string, url string, description string, published_at timestamp,"
       " ord struct<source_rank:int,query_rank:int,pos:bigint>")


def test_keyword_boundaries(column_of):
    words = ["go", "c++", "c#", "machine learning", ".net", "élan", "zero-day", "kiss"]
    cases = [
        ('Fast algorithm design', []),
        ('Why choose Go?', ['go']),
        ('Modern C++20 features', []),
        ('Modern C++ features', ['c++']),
        ('C++, C#.', []),
        ('(c#)', []),
        ('C# and .NET', ['c#', '.net']),
        ('machine  learning!', ['machine learning']),
        ('ÉLAN vital', ['élan']),
        ('xélan', []),
        ('a zero-day', ['zero-day']),
        ('zero-days', []),
        ('go_lang', []),
        ('GO', ['go']),
        ('', []),
        (None, []),
        ('c++', ['c++']),
        ('AT&amp;T c++ ', ['c++']),
        ('ſgo', []),
        ('Kiſs', ['kiss']),
        ('kıss', ['kiss']),
        ('goſ', []),
    ]
    got = column_of(lambda c: keyword_matches(c, words), [c for c, _ in cases])
    assert got == [want for _, want in cases]


def test_keywords_random(column_of):
    """The pattern of a category agrees with its keywords, and each of those with itself alone."""
    rng = random.Random(3)
    words = ["go", "c++", "ide", "open-source", "c#", "a b", "_x", "é", "text-to-image", "sk"]
    bits = ["go", "C++", "c#", " ", "a", "b", "-", "IDE", "open", "source", "_x", "É", "é", ".", "s", "text-to-image", "(", "1"]
    cases = [" ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))).split()) for _ in range(600)]
    got = column_of(lambda c: keyword_matches(c, words), cases)
    any_of = column_of(lambda c: c.rlike(any_keyword_pattern(words)), cases)
    assert any_of == [bool(found) for found in got]
    for text, found in zip(cases, got):
        assert all(w in text.lower() for w in found) and found == [w for w in words if w in found]
    for word in words[:3]:
        alone = column_of(lambda c: keyword_matches(c, [word]), cases)
        assert [bool(x) for x in alone] == [word in found for found in got]


def test_blank_keywords_are_left_out(column_of, spark):
    assert column_of(lambda c: keyword_matches(c, ["python", "", " "]), ["python here", ""]) == [["python"], []]
    assert Rules({"P": ["python", "", " "], "E": []}).categories == {"P": ["python"], "E": []}
    assert scored(spark, [(1, "python", None, [])], Rules({"P": ["python", ""]}))[0][1] == ["P"]


def scored(spark, rows, rules, **kw):
    df = spark.createDataFrame(rows, "id int, title string, description string, categories array<string>")
    out = score(df.repartition(2), rules, **kw).orderBy("id").collect()
    return [(r.relevance_score, r.categories, r.matched_keywords, r.is_relevant) for r in out]


def test_scores(spark):
    rules = Rules(AI_PY.categories, 5, 2, 3, 10)
    rows = [
        (1, "Artificial Intelligence today", None, []),
        (2, "News", "written in Python", []),
        (3, "LLM in Python", "python and go", []),
        (4, "nothing", "", ["ai"]),
        (5, "nothing", None, None),
        (6, "&amp;lt;llm&amp;gt;", None, []),
    ]
    assert scored(spark, rows, rules) == [
        (8.0, ["AI"], ["artificial intelligence"], False),
        (5.0, ["Programming"], ["python"], False),
        (18.0, ["AI", "Programming"], ["go", "llm", "python"], True),
        (3.0, ["AI"], [], False),
        (0.0, [], [], False),
        (8.0, ["AI"], ["llm"], False),
    ]
    assert scored(spark, rows[:1], Rules({}, threshold=0)) == [(0.0, [], [], True)]


def test_default_weights(spark):
    rows = [(1, "python", None, []), (2, "x", "python", [])]
    assert [r[0] for r in scored(spark, rows, AI_PY)] == [4.0, 2.0]


def test_filter_on_score_repeats_no_regex(spark):
    df = spark.createDataFrame([(1, "python", "x", [])], "id int, title string, description string, categories array<string>")
    plan = relevant(score(df, AI_PY), 3)._jdf.queryExecution().optimizedPlan().toString()
    unfiltered = score(df, AI_PY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(_title") == unfiltered.count("RLIKE(_title")


def raws(spark, rows):
    full = [(s, t, u, d, None, (0, 0, i)) for i, (s, t, u, d) in enumerate(rows)]
    return spark.createDataFrame(full, RAW).repartition(2)


def test_score_job_and_batch_job(spark):
    raw = raws(spark, [
        ("a", "Python 3.13", "https://e.com/1?utm_source=x", None),
        ("a", "Python 3.13!", "https://e.com/2", None),
        ("b", "Weather", "https://e.com/3", None),
        ("b", "Broken", "http://[bad/", None),
    ])
    assert score_job(raw, AI_PY).count() == 3
    out = batch_job(raw, AI_PY).orderBy("seq").collect()
    assert [(r.url, r.is_relevant) for r in out] == [("https://e.com/1", True), ("https://e.com/3", False)]
