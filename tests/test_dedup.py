"""DD-1..5 and JN-5 by their defining property."""

import random
import re

import pytest

from newsgrist.functions.components import components
from newsgrist.operators import dedup

SCHEMA = "seq bigint, title string, url string, source string, content_hash string"


def keys_of(row):
    """Families with the keys of a row. Urls here are canonical already."""
    _, title, url, source, digest = row
    keys = {dedup.URL: url, dedup.TITLE: (title.lower(), source.strip().lower())}
    return keys | ({dedup.HASH: digest} if digest else {})


def holds(rows, reasons, known=()):
    """The defining property: kept rows share no key with each other or a known one, and
    each dropped row shares the key of its reason, its first family, with an earlier kept
    row or a known one."""
    kept = [r for r in sorted(rows) if r[0] not in reasons]
    first = {k: "known" for k in known}
    for row in kept:
        for key in keys_of(row).items():
            assert key not in first, row
            first[key] = row[0]
    for row in rows:
        if row[0] in reasons:
            hits = [f for f in (dedup.URL, dedup.HASH, dedup.TITLE)
                    if f in keys_of(row) and (h := first.get((f, keys_of(row)[f]))) is not None and (h == "known" or h < row[0])]
            assert hits and reasons[row[0]] == hits[0], row
    return True


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.seq: r.reason for r in dedup.find_duplicates(df, **kw).collect()}


def random_rows(rng, n, values):
    rows = []
    for i in range(n):
        rows.append((i, f"t{rng.randrange(values)}", f"http://u{rng.randrange(values)}.com/",
                     rng.choice(["A", " a", "b"]), rng.choice([None, "", f"h{rng.randrange(values)}"])))
    return rows


@pytest.mark.parametrize("seed,n,values", [(1, 60, 12), (2, 120, 40), (3, 40, 3), (4, 200, 60)])
def test_random_batches(spark, seed, n, values):
    rows = random_rows(random.Random(seed), n, values)
    assert holds(rows, found(spark, rows))


def test_articles_are_read_once(spark):
    """Cleaning is most of a job: the keys of the articles are made in one pass."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = random_rows(random.Random(9), 60, 15)
    df = spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA)
    reasons = {r.seq: r.reason for r in dedup.find_duplicates(df).collect()}
    assert holds(rows, reasons) and read.value == len(rows)


def test_known_keys(spark):
    rng = random.Random(8)
    rows = random_rows(rng, 80, 25)
    urls, hashes = ["http://u1.com/", "http://u2.com/"], ["h3", "h4"]
    titles = [("T5", "A "), ("t6", "b")]
    known = dedup.known_keys(
        spark.createDataFrame([(u,) for u in urls], "url string"),
        spark.createDataFrame([(h,) for h in hashes], "content_hash string"),
        spark.createDataFrame(titles, "title string, source string"),
    )
    given = [(dedup.URL, u) for u in urls] + [(dedup.HASH, h) for h in hashes]
    given += [(dedup.TITLE, (t.lower(), x.strip().lower())) for t, x in titles]
    assert holds(rows, found(spark, rows, known=known), given)


def chain(n):
    """Row i shares a url with i-1 (odd i) or a title with i-1 (even i)."""
    return [(i, f"t{(i + 1) // 2}", f"http://u{i // 2}.com/", "s", None) for i in range(n)]


def test_chain(spark):
    rows = chain(16)
    reasons = found(spark, rows)
    assert holds(rows, reasons) and len(reasons) == 8


def jobs_of(spark, work):
    """What ``work`` returns, and how many jobs it started."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        before = len(context.statusTracker().getJobIdsForGroup("counted"))
        return work(), len(context.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_long_chain(spark):
    """A chain needs no round per link."""
    rows = chain(10_000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    reasons, jobs = jobs_of(spark, lambda: dedup.find_duplicates(df, reasons=False).collect())
    assert {r.seq for r in reasons} == set(range(1, 10_000, 2))
    assert jobs < 30, jobs


def test_large_components_go_through_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "COMPONENT_PAIRS", 12)
    rows = chain(24) + [(100 + i, *r[1:]) for i, r in enumerate(random_rows(random.Random(5), 50, 20))]
    assert holds(rows, found(spark, rows))


def test_components_of_random_graphs(spark):
    """Against a search; many partitions, so that one step is not enough."""
    rng = random.Random(6)
    names = rng.sample(range(-10**9, 10**9), 400)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [tuple(rng.sample(names[200:], 2)) for _ in range(150)]
    edges += [(names[160], names[160]), *[(n, names[170]) for n in names[171:190]]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    near = {}
    for a, b in edges:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    assert got.keys() == near.keys()
    left = set(near)
    while left:
        group, todo = set(), [next(iter(left))]
        while todo:
            v = todo.pop()
            if v not in group:
                group.add(v)
                todo.extend(near[v])
        assert {got[v] for v in group} == {min(group)}
        left -= group


def test_order_may_be_a_struct(spark):
    df = spark.createDataFrame([((1, 5), "a", "http://u/", "s", None), ((0, 9), "b", "http://u/", "s", None)],
                               "seq struct<a:int,b:int>, title string, url string, source string, content_hash string")
    assert [tuple(r.seq) for r in dedup.find_duplicates(df).collect()] == [(1, 5)]


def test_one_key_holds_most_rows(spark):
    rows = [(i, "", f"http://u{i}.com/", "s", None) for i in range(3000)]
    rows += [(3000 + i, f"x{i}", f"http://u{i}.com/", "z", None) for i in range(10)]
    assert holds(rows, found(spark, rows))


def test_dropped_rows_register_nothing(spark):
    rows = [(1, "a", "http://x/", "s", None), (2, "b", "http://x/", "s", None),
            (3, "B", "http://y/", "S", None)]
    assert found(spark, rows) == {2: dedup.URL}


def test_literals(spark):
    rows = [
        (1, "One", "https://e.com/a", "s", "h1"),
        (2, "Two", "https://e.com/a?utm_source=x", "s", None),     # tracking variant
        (3, "Three", "https://e.com/c", "s", "h1"),                # same hash
        (4, "one!", "https://e.com/d", " S ", None),               # same title and source
        (5, "One", "https://e.com/e", "other", None),              # other source
        (6, "", "", "s", None), (7, "", "", "s", None),            # blank keys collide
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.seq: (r.is_duplicate, r.duplicate_reason) for r in dedup.flag_duplicates(df).collect()}
    assert out == {1: (False, None), 2: (True, "url"), 3: (True, "content_hash"),
                   4: (True, "title_source"), 5: (False, None), 6: (False, None), 7: (True, "url")}
    assert [r.seq for r in dedup.drop_duplicates(df).orderBy("seq").collect()] == [1, 5, 6]


def test_pairs_are_shuffled_with_their_salt(spark):
    df = spark.createDataFrame([(i, "t", "u", "s", None) for i in range(10)], SCHEMA)
    pairs = dedup.article_keys(df, "seq", normalized=False)
    plan = dedup._with_minimum(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[k#\d+, salt#\d+\]", plan)
