"""SNK-1..7, JN-3, JN-4, JN-7, TOP-1, TOP-2, AGG-4, AGG-5, DQ-1."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgrist.functions import bloom
from newsgrist.operators import history, metrics, quality
from newsgrist.operators.store import (
    ArticleStore, ConstraintError, constraint_violations, decode_rows, encode_rows,
    unknown_deliveries, with_delivery,
)
from newsgrist.schema import STORE_COLUMNS, STORE_SCHEMA

T0 = datetime(2026, 9, 19, 10)


def rows(spark, specs):
    """Dicts over defaults, in store schema plus seq."""
    out = []
    for i, spec in enumerate(specs):
        row = dict.fromkeys(STORE_COLUMNS)
        row.update(id=str(i), title=f"t{i}", url=f"https://e.com/{i}", source="s", categories=[], relevance_score=0.0,
                   discovered_at=T0 + timedelta(minutes=i), created_at=T0, sent=False, content_hash=f"{i:064d}")
        row.update(spec)
        out.append(tuple(row[c] for c in STORE_COLUMNS) + (row.get("seq", i),))
    return spark.createDataFrame(out, f"{STORE_SCHEMA}, seq bigint").repartition(2)


@pytest.fixture
def store(spark, tmp_path):
    return ArticleStore(spark, str(tmp_path / "articles"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_create_is_idempotent(store):
    store.create()
    store.create()
    assert store.read().count() == 0 and store.read().columns == STORE_COLUMNS


def test_append_all_or_nothing_and_replay(spark, store):
    store.append(rows(spark, [{}, {}]), 1, T0)
    with pytest.raises(ConstraintError, match="url unique"):
        store.append(rows(spark, [{"id": "8"}, {"id": "9", "url": "https://e.com/1"}]), 2, T0)
    with pytest.raises(ConstraintError, match="id unique"):
        store.append(rows(spark, [{"id": "x", "url": "u1"}, {"id": "x", "url": "u2"}]), 2, T0)
    with pytest.raises(ConstraintError, match="title not null"):
        store.append(rows(spark, [{"id": "x", "url": "u1", "title": None}]), 2, T0)
    assert ids(store.read()) == ["0", "1"]
    store.append(rows(spark, [{}, {}]), 1, T0)  # the same batch again
    assert ids(store.read()) == ["0", "1"]


def test_half_written_batch_is_not_read(spark, store):
    import os

    store.append(rows(spark, [{}]), 1, T0)
    store.append(rows(spark, [{"id": "b", "url": "b"}]), 2, T0)
    os.remove(f"{store.path}/gen=000000001/rows/batch=000000000002/_SUCCESS")
    assert ids(store.read()) == ["0"]


def test_defaults(spark, store):
    store.append(rows(spark, [{"id": None, "discovered_at": None, "created_at": None}]), 1, T0)
    row = store.read().first()
    assert row.id == row.content_hash[:32] and row.discovered_at == row.created_at == T0


def test_upsert(spark, store):
    store.append(rows(spark, [{}, {}]), 1, T0)
    later = T0 + timedelta(days=1)
    store.upsert(rows(spark, [
        {"id": "1", "title": "first", "url": "https://e.com/1", "created_at": later, "seq": 1},
        {"id": "1", "title": "last", "url": "https://e.com/1b", "created_at": later, "seq": 2},
        {"id": "7", "url": "u7", "created_at": later, "seq": 3},
    ]))
    got = {r.id: (r.title, r.url, r.created_at) for r in store.read().collect()}
    assert got == {"0": ("t0", "https://e.com/0", T0), "1": ("last", "https://e.com/1b", T0), "7": ("t2", "u7", later)}
    with pytest.raises(ConstraintError, match="url unique"):
        store.upsert(rows(spark, [{"id": "9", "url": "https://e.com/0"}]))
    assert store.read().count() == 3


def written_rows(spark, store, part):
    return spark.read.parquet(f"{store.path}/gen=000000001/{part}").count()


def test_upsert_writes_its_own_rows_only(spark, store):
    store.append(rows(spark, [{} for _ in range(40)]), 1, T0)
    later = T0 + timedelta(days=1)
    store.upsert(rows(spark, [{"title": f"new{i}", "created_at": later} for i in range(10)]))
    store.upsert(rows(spark, [{"title": "newest", "url": "moved"}, {"id": "n", "url": "https://e.com/0", "created_at": later}]))
    assert written_rows(spark, store, "rows") == 40 and written_rows(spark, store, "changes") == 12
    want = {str(i): (f"new{i}" if i < 10 else f"t{i}", T0) for i in range(40)} | {"0": ("newest", T0), "n": ("t1", later)}
    assert {r.id: (r.title, r.created_at) for r in store.read().collect()} == want
    with pytest.raises(ConstraintError, match="url unique"):
        store.append(rows(spark, [{"id": "q", "url": "moved"}]), 2, T0)
    with pytest.raises(ConstraintError, match="title not null"):
        store.upsert(rows(spark, [{"title": None}]))
    with pytest.raises(ConstraintError, match="url unique"):
        store.upsert(rows(spark, [{"id": "x", "url": "u"}, {"id": "y", "url": "u"}]))
    store.append(rows(spark, [{"id": "q", "url": "free"}]), 2, T0)
    before = sorted(map(str, store.read().collect()))
    store.save_outbox(store.read().select("id"), 2)
    store.compact()
    assert sorted(map(str, store.read().collect())) == before
    assert store.save_outbox(store.read().where("id = 'q'").select("id"), 2).count() == 42
    store.upsert(rows(spark, [{"title": "again", "url": "moved"}]))
    assert {r.title for r in store.read().where("id = '0'").collect()} == {"again"}


def test_marks_and_upserts_in_turn(spark, store):
    """An upsert replaces the flag with its own; a later mark sets it again."""
    mark = lambda n: store.mark_sent(spark.createDataFrame([("0", True, T0 + timedelta(hours=n))], "id string, ok boolean, sent_at timestamp"), n)
    state = lambda: [(r.sent, r.sent_at) for r in store.read().collect()]
    store.append(rows(spark, [{}]), 1, T0)
    mark(1)
    assert state() == [(True, T0 + timedelta(hours=1))]
    store.upsert(rows(spark, [{"title": "x"}]))
    assert state() == [(False, None)]
    mark(2)
    assert state() == [(True, T0 + timedelta(hours=2))]
    store.compact()
    assert state() == [(True, T0 + timedelta(hours=2))]


def test_filters_hold_back_what_is_not_stored(spark):
    stored = spark.createDataFrame([(f"i{n}", f"u{n}") for n in range(2000)], "id string, url string")
    filters = bloom.build(stored, ["id", "url"])
    keys = lambda *values: bloom.digests(spark.createDataFrame([(v,) for v in values], "url string"), ["url"])
    assert bloom.possible(keys(*[f"u{n}" for n in range(2000)], "", None), filters).count() == 2000
    assert bloom.possible(keys(*[f"v{n}" for n in range(2000)]), filters).count() < 100
    # Ids are no urls.
    assert bloom.possible(keys(*[f"i{n}" for n in range(2000)]), filters).count() < 100


def test_filters_of_many_batches(spark, store):
    """Each batch's filter is sized for the table, so that uniting them fills none."""
    for batch in range(6):
        store.append(rows(spark, [{"id": f"{batch}-{i}", "url": f"{batch}/{i}", "content_hash": f"{batch}h{i}"} for i in range(40)]), batch + 1, T0)
    filters = store.key_filters()
    assert [r["count"] > 0 for r in filters.groupBy("words").count().collect()].count(True) <= 4
    asked = spark.createDataFrame([(f"n{i}",) for i in range(1000)], "url string")
    assert bloom.possible(bloom.digests(asked, ["url"]), filters).count() < 100
    every = bloom.digests(store.read(), ["id", "url", "content_hash"])
    assert bloom.possible(every, filters).count() == 6 * 40 * 3
    # A filter that was never written is made up for.
    store._delete(f"{store.path}/gen=000000001/rows_keys/batch=000000000003")
    assert bloom.possible(every, store.key_filters()).count() == 6 * 40 * 3


def test_probes_without_a_possible_hit_read_no_stored_keys(spark, store):
    store.append(rows(spark, [{} for _ in range(50)]), 1, T0)
    filters = store.key_filters()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    new = rows(spark, [{"id": "far", "url": "far", "content_hash": "f" * 64}])
    for found in (history.not_in_history(new, store.read(), filters=filters), history.exists_flags(new, store.read(), filters=filters)):
        assert "parquet" not in plan(found).lower()
        assert found.count() == 1
    known = rows(spark, [{}])
    assert "parquet" in plan(history.not_in_history(known, store.read(), filters=filters)).lower()
    assert history.not_in_history(known, store.read(), filters=filters).count() == 0


def test_mark_sent(spark, store):
    store.append(rows(spark, [{}, {}, {}]), 1, T0)
    results = lambda *r: spark.createDataFrame(list(r), "id string, ok boolean, sent_at timestamp")
    first = results(("0", True, T0), ("1", False, T0), ("nope", True, T0))
    assert ids(unknown_deliveries(store.read(), first)) == ["nope"]
    assert {r.id: r.sent for r in with_delivery(store.read(), first).collect()} == {"0": True, "1": False, "2": False}
    store.mark_sent(first, 1)
    store.mark_sent(results(("0", True, T0 + timedelta(hours=1))), 2)
    got = {r.id: (r.sent, r.sent_at) for r in store.read().collect()}
    assert got == {"0": (True, T0 + timedelta(hours=1)), "1": (False, None), "2": (False, None)}


def test_encode_and_decode(spark):
    df = rows(spark, [{"categories": ["A", 'q"'], "published_at": datetime(2026, 1, 2, 3, 4, 5, 60), "sent": True}]).drop("seq")
    text = encode_rows(df)
    row = text.first()
    assert (row.published_at, row.sent, row.categories) == ("2026-01-02T03:04:05.000060+00:00", 1, '["A","q\\""]')
    assert decode_rows(text, T0).select(*STORE_COLUMNS).collect() == df.collect()
    broken = text.withColumns({c: F.lit("12:00") for c in ("published_at", "discovered_at", "sent_at")})
    for bad in ("{}", "[", "null", "5"):
        got = decode_rows(broken.withColumn("categories", F.lit(bad)), T0).first()
        assert (got.categories, got.published_at, got.sent_at, got.discovered_at) == ([], None, None, T0)
    assert decode_rows(text.withColumn("discovered_at", F.lit(None).cast("string")), T0).first().discovered_at is None


def test_history(spark):
    stored = rows(spark, [{}, {"content_hash": None}, {"content_hash": ""}])
    probe = rows(spark, [{}, {"id": "n1", "url": "new", "content_hash": f"{0:064d}"}, {"id": "n2", "url": "n2", "content_hash": ""},
                         {"id": "n3", "url": "n3", "content_hash": None}, {"id": "1", "url": ""}])
    assert ids(history.not_in_history(probe, stored)) == ["1", "n2", "n3"]
    assert {r.id: r.found for r in history.exists_flags(probe, stored).collect()} == {
        "0": True, "n1": True, "n2": False, "n3": False, "1": True}
    nothing = probe.withColumns({c: F.lit(None).cast("string") for c in ("id", "url", "content_hash")})
    assert not any(r.found for r in history.exists_flags(nothing, stored).collect())
    assert history.in_history(probe, stored).count() == 2


def test_lookup(spark):
    same = [{"content_hash": "h", "created_at": T0 + timedelta(1)}, {"content_hash": "h"}, {}]
    stored = rows(spark, same)
    key = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    assert ids(history.lookup(stored, key("id", "2", "9", "2"), "id")) == ["2"]
    assert ids(history.lookup(stored, key("url", "https://e.com/0"), "url")) == ["0"]
    assert ids(history.lookup(stored, key("content_hash", "h", None), "content_hash")) == ["1"]


def test_top_and_counts(spark):
    stored = rows(spark, [{"relevance_score": s, "sent": t} for s, t in ((1.0, False), (4.0, False), (8.0, False), (9.0, True), (-1.0, False), (8.0, False))])
    assert [r.id for r in history.top_unsent(stored, 3, 50).collect()] == ["5", "2", "1"]
    assert [r.id for r in history.most_recent(stored, 2).collect()] == ["5", "4"]
    assert metrics.article_counts(stored).first().asDict() == {"total_articles": 6, "sent_articles": 1, "unsent_articles": 4}
    assert metrics.status_report(stored, 3).first().asDict() == {
        "total_articles": 6, "sent_articles": 1, "unsent_articles": 4, "unsent_relevant": 3, "unsent_filtered": 1}
    plan = history.top_unsent(stored, 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_audit(spark):
    good = rows(spark, [{}, {"sent": True, "sent_at": T0}])
    assert quality.store_audit(good).count() == 0
    assert quality.store_status(quality.store_audit(good)).first()[0] == "ok"
    bad = rows(spark, [{}, {"id": "0"}, {"sent": True, "content_hash": "x"}, {"source": None}])
    found = {(r.level, r.rule, r.n) for r in quality.store_audit(bad).collect()}
    assert found == {("error", "id unique", 2), ("error", "source not null", 1),
                     ("warning", "content_hash length", 1), ("warning", "sent without time", 1)}
    assert quality.store_status(quality.store_audit(bad)).first()[0] == "damaged"
    assert constraint_violations(rows(spark, [{"url": "u"}, {"url": "u"}])).first().key == "u"


def test_filter_reaches_the_scan(spark, store):
    store.append(rows(spark, [{"relevance_score": 5.0}]), 1, T0)
    from newsgrist.operators.filters import unsent

    plan = unsent(spark.read.schema(STORE_SCHEMA).parquet(f"{store.path}/gen=000000001/rows/batch=000000000001"), 3)
    text = plan.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(relevan" in text
