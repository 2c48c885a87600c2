"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled texts train a logistic model whose loss is the non-negative
unbiased risk: with prior p, risk = p * R+(positives) + max(0, R-(unlabelled) - p *
R-(positives)). Negatives are never shown to it. The prior is estimated from score
histograms over all documents.

A text is described by its shape: how often each kind of sign follows each other kind, and
how often a word repeats the one before. Shapes do not depend on the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgrist.llm.common import small_batches
from newsgrist.llm.shingles import word_hashes

# Documented bounds of the training sample; beyond them rows are drawn by a hash.
MAX_POSITIVES = 6_000
MAX_UNLABELLED = 12_000
THRESHOLD = 0.3
BINS = 1_000

_KINDS = ["lower", "upper", "digit", "space", "line", ".", ",", "!", "|", "$%&#*", "quote", "bracket", "other"]
_N = len(_KINDS)
FEATURES = _N * _N + 4


def _kind_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 128 or c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c in "\n\r":
        return 4
    if c.isspace():
        return 3
    for k, signs in enumerate([".?;:", ",", "!", "|", "$%&#*", "\"'`", "()[]{}<>"]):
        if c in signs:
            return 5 + k
    return 12


_KIND = np.array([_kind_of(b) for b in range(256)], dtype=np.uint8)
# Upper-case letters outside ASCII count as such: they are swapped for one that is in it.
_UPPER = re.compile("[À-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŪŬŮŰŲŹŻŽΑ-ΩА-Я]")


def features(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text; texts without signs give zeros."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    hashes, first = word_hashes(texts)
    counts = np.diff(first)
    again = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes):
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = hashes[1:] == hashes[:-1]
        np.cumsum(same, out=again[1:])
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = (text if text.isascii() else _UPPER.sub("A", text)).encode("utf-8", "surrogatepass")
        kinds = _KIND[np.frombuffer(raw, dtype=np.uint8)]
        pairs = np.bincount(kinds[:-1] * np.uint8(_N) + kinds[1:], minlength=_N * _N)
        out[i, : _N * _N] = np.sqrt(pairs / max(1, len(kinds) - 1))
        words, start = int(counts[i]), first[i]
        repeats = again[start + words] - again[min(start + 1, start + words)] if words else 0
        out[i, _N * _N :] = [
            np.sqrt(repeats / max(1, words)), min(1.0, len(raw) / max(1, words) / 20),
            np.log1p(words) / 12, 1.0 * (words == 0),
        ]
    return out


@dataclass(frozen=True)
class Model:
    """A logistic model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, decay: float = 1e-3) -> Model:
    """Minimise the non-negative risk by full-batch Adam.

    Where the estimated risk on negatives falls below zero, only that term is stepped back
    on, as the non-negative estimator asks.
    """
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))] for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        towards_negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        if negative_risk >= 0:
            gradient = prior * (p.T @ (sp - 1)) / len(p) + towards_negative
        else:
            gradient = -towards_negative
        gradient = gradient + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, drawn by a hash of the text: a broad share of each
    partition, not a prefix."""
    n = rows.count()
    share = min(1.0, most / max(1, n))
    return rows.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def _described(rows: DataFrame, label: int) -> DataFrame:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            x = features(batch.column("text").to_pylist())
            yield pa.record_batch(
                [pa.array([v.tobytes() for v in x], pa.binary()), pa.array([label] * len(x), pa.int32())],
                ["x", "label"],
            )

    return rows.select("text").mapInArrow(describe, "x binary, label int")


def _scored(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (``doc_id, text, ...`` without clashes) with ``score`` instead of ``text``."""
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            score = shared.value.score(features(batch.column("text").to_pylist()))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(score, pa.float64())], [*keep, "score"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(keep).schema)
    return rows.mapInArrow(scored, f"{types}, score double")


def estimate_prior(scores: DataFrame) -> float:
    """Share of positives among all texts, from ``score, trusted``.

    Above any threshold positives make up at most all of the unlabelled texts there, so
    share(all > t) / share(trusted > t) bounds the prior from above; the least such ratio
    with enough trusted texts behind it is the estimate. Counts cover all rows.
    """
    width = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    rows = scores.groupBy(width.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.col("trusted").cast("long")).alias("p")
    ).collect()
    every, trusted = np.zeros(BINS), np.zeros(BINS)
    for row in rows:
        every[row.bin], trusted[row.bin] = row.n, row.p
    above, known = np.cumsum(every[::-1]) / max(1, every.sum()), np.cumsum(trusted[::-1]) / max(1, trusted.sum())
    solid = known >= 0.9  # fewer texts make the ratio too noisy
    if not solid.any():
        return 0.5
    return float(np.clip((above[solid] / known[solid]).min(), 0.05, 0.95))


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> Model | None:
    """A model from positives with ``quality`` = 1 outside the held-out fold and from texts
    taken without their labels. None without any positive or any other text.

    Two rounds: the first, with an even prior, ranks all texts; the prior estimated on all
    of them goes into the second.
    """
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    trusted = ids.where(~held_out(F.col("doc_id"))).distinct().withColumn("trusted", F.lit(True))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    web = texts.where(~held_out(F.coalesce("doc_id", F.lit(1))))
    named = trusted.count()
    share = min(1.0, MAX_POSITIVES / max(1, named))
    drawn = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    positive = web.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")
    sample = _described(positive, 1).unionByName(_described(_sample(web, MAX_UNLABELLED), 0)).collect()
    x = np.frombuffer(b"".join(r.x for r in sample), dtype=np.float32).reshape(-1, FEATURES).astype(float)
    y = np.array([r.label for r in sample])
    if not (y == 1).any() or not (y == 0).any():
        return None
    first = fit(x[y == 1], x[y == 0], 0.5)
    scores = _scored(spark, texts, first).join(trusted, "doc_id", "left")
    prior = estimate_prior(scores.select("score", F.coalesce("trusted", F.lit(False)).alias("trusted")))
    return fit(x[y == 1], x[y == 0], prior)


def score_quality(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    ``score`` is the chance of label 1 by the whole text alone; ``predicted`` is 1 from
    ``THRESHOLD`` on. Null and empty texts get the score of an empty text. A null ``doc_id``
    is not held out. Labels with null ids or values teach nothing; without any usable
    positive all scores are 0.5. Repeated rows give repeated results; other columns are
    ignored.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = train(spark, documents, labels)
    if model is None:
        scored = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = _scored(spark, rows, model)
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_quality(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``score_quality`` predicts as 1, with all columns."""
    model = train(spark, documents, labels)
    if model is None:
        return documents
    shared = spark.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            score = shared.value.score(features(batch.column(at).to_pylist()))
            yield batch.filter(pa.array(score >= THRESHOLD))

    return documents.mapInArrow(kept, documents.schema)
