"""The as-of join against a scan over all entries for each capture."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsgrist.llm.urlfilter import filter_captures, host_of, intervals, keys_of

T0 = datetime(2024, 1, 1)
HOSTS = ["a.example.com", "b.example.com", "example.com", "c.d.example.org", "hot.net"]


def keys(host, parts):
    labels = host.split(".")
    domains = [".".join(labels[k:]) for k in range(max(len(labels) - 1, 1))]
    return {*domains, *("/".join([host, *parts[:k]]) for k in range(1, len(parts) + 1))}


def active(entries, key, when):
    lists = {e[0] for e in entries}
    out = set()
    for name in lists:
        past = [e for e in entries if e[0] == name and e[1] == key and e[2] <= when]
        if past:
            last = max(e[2] for e in past)
            if any(e[3] for e in past if e[2] == last):
                out.add(name)
    return out


def test_against_a_scan(spark):
    rnd = random.Random(5)
    at = lambda: T0 + timedelta(minutes=rnd.randint(0, 60))
    all_keys = [*HOSTS, "org", "hot.net/a", "hot.net/a/b", "example.org"]
    entries = [(rnd.choice(["x", "y"]), rnd.choice(all_keys), at(), rnd.random() < 0.6) for _ in range(150)]
    captures = []
    for i in range(500):
        host = "hot.net" if i % 3 == 0 else rnd.choice(HOSTS)
        parts = [rnd.choice("ab") for _ in range(rnd.randint(0, 3))]
        captures.append((i, host, parts, at()))
    frame = spark.createDataFrame(
        [(i, f"HTTP://user@{h.upper()}:80/{'/'.join(p)}?q=/z#f", t, "clash", "k") for i, h, p, t in captures],
        "capture_id bigint, url string, fetched_at timestamp, list string, key string",
    )
    listing = spark.createDataFrame(entries, "list string, key string, at timestamp, listed boolean")
    got = {r.capture_id: r for r in filter_captures(frame, listing).collect()}
    assert len(got) == 500
    for i, host, parts, when in captures:
        hits = {k: active(entries, k, when) for k in keys(host, parts)}
        lists = sorted(set().union(*hits.values()))
        assert got[i].lists == lists and got[i].keys == sorted(k for k, v in hits.items() if v)
        assert got[i].blocked == bool(lists) and got[i].n_lists == len(lists)
    assert 50 < sum(r.blocked for r in got.values()) < 480


def test_intervals(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("x", "k", at(1), False), ("x", "k", at(2), True), ("x", "k", at(3), True), ("x", "k", at(5), False), ("x", "k", at(5), False),
            ("x", "k", at(7), True), ("x", "k", at(7), False), ("x", None, at(1), True), ("x", "n", None, True), ("x", "n", at(1), None)]
    got = intervals(spark.createDataFrame(rows, "list string, key string, at timestamp, listed boolean")).collect()
    assert sorted((r.key, r.valid_from, r.valid_to) for r in got if r.valid_to) == [("k", at(2), at(5))]
    assert [(r.valid_from, r.valid_to) for r in got if not r.valid_to] == [(at(7), None)]


def test_edges_of_an_interval(spark):
    listing = spark.createDataFrame(
        [("x", "a.b", T0, True), ("x", "a.b", T0 + timedelta(seconds=9), False)], "list string, key string, at timestamp, listed boolean"
    )
    moments = [-1, 0, 8, 9, 10]
    frame = spark.createDataFrame([(s, "http://a.b/", T0 + timedelta(seconds=s)) for s in moments], "capture_id bigint, url string, fetched_at timestamp")
    assert {r.capture_id for r in filter_captures(frame, listing).collect() if r.blocked} == {0, 8}


def test_odd_rows(spark):
    schema = "capture_id bigint, url string, fetched_at timestamp"
    listing = spark.createDataFrame([("x", "a.b", T0, True)], "list string, key string, at timestamp, listed boolean")
    rows = [(1, None, T0), (2, "http://a.b", None), (3, "no url", T0), (4, "", T0), (None, "http://a.b/x", T0), (5, "http://a.b/", T0), (5, "http://a.b/", T0),
            (6, "http://a.b/" + "p" * 50_000, T0), (7, "http://c.d./", T0)]
    got = filter_captures(spark.createDataFrame(rows, schema), listing).collect()
    assert sorted((str(r.capture_id), r.blocked) for r in got) == [
        ("1", False), ("2", False), ("3", False), ("4", False), ("5", True), ("5", True), ("6", True), ("7", False), ("None", True)]
    none = spark.createDataFrame([], "list string, key string, at timestamp, listed boolean")
    assert filter_captures(spark.createDataFrame(rows, schema), none).where("blocked").count() == 0
    assert filter_captures(spark.createDataFrame([], schema), listing).count() == 0


def test_parts_of_urls(column_of):
    assert column_of(host_of, ["https://U:p@Ex.Com.:8/x", "mailto:a@b", None, "http:///x", "ftp://h"]) == ["ex.com", None, None, None, "h"]
    assert column_of(keys_of, ["http://a.b.c/x//y/?q", "http://h"]) == [["a.b.c", "b.c", "a.b.c/x", "a.b.c/x/y"], ["h"]]


def test_no_python_in_the_plan(spark):
    listing = spark.createDataFrame([("x", "a.b", T0, True)], "list string, key string, at timestamp, listed boolean")
    frame = spark.range(3).select(F.col("id").alias("capture_id"), F.lit("http://a.b").alias("url"), F.lit(T0).alias("fetched_at"))
    plan = filter_captures(frame, listing)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
