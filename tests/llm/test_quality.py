"""Held-out accuracy, and that only texts and training labels count."""

import zlib

import numpy as np
import pytest

from newsgrist.llm.quality import estimate_prior, features, fit, keep_quality, score_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(spark, documents, labels).join(labels, "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(out) > 50 and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got)
    good, bad = ([r.predicted for r in out if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_labels_and_other_columns_teach_nothing(spark, small):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    before = sorted(score_quality(spark, documents, labels).collect())
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "1 - toxic as toxic")
    other = documents.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source", "0 as score", "false as trusted")
    assert sorted(score_quality(spark, other, flipped).collect()) == before


def test_negatives_are_not_used(spark, small):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(score_quality(spark, documents, labels.where("quality = 1")).collect()) == sorted(score_quality(spark, documents, labels).collect())


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 30)] + [(None, 1, 0), (40, None, 0), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(i, f"A plain sentence, number {i}, that says a thing.") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "x"), (5, "A plain sentence."), (102, "@@@!!! " * 30_000)]
    got = score_quality(spark, docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    nulls = {r.doc_id: r.score for r in got}
    assert nulls[100] == nulls[101]
    table = docs(rows)
    assert keep_quality(spark, table, labels).columns == table.columns


def test_nothing_to_learn_from(spark, docs):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = score_quality(spark, docs([(1, "a"), (2, None)]), labels).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)] * 2
    assert score_quality(spark, docs([]), labels).count() == 0
    assert keep_quality(spark, docs([(1, "a")]), labels).count() == 1


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (3000, 3)), rng.normal(-2, 1, (1000, 3))
    unlabelled = np.concatenate([good[1500:], bad])
    model = fit(good[:1500], unlabelled, 0.6)
    assert (model.score(good) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior(spark, share):
    rng = np.random.default_rng(1)
    n = 4000
    good = rng.random(n) < share
    score = np.where(good, rng.beta(8, 2, n), rng.beta(2, 8, n))
    trusted = good & (rng.random(n) < 0.5)
    frame = spark.createDataFrame(list(zip(score.tolist(), trusted.tolist())), "score double, trusted boolean")
    assert abs(estimate_prior(frame) - share) < 0.12


def test_features():
    x = features(["Plain words here.", None, "", "word word word word", "AB!! CD!!"])
    assert x.shape[0] == 5 and not x[1].any() and not x[2].any() and np.isfinite(x).all()
    assert x[3, -4] > 0.8 and x[0, -4] == 0
