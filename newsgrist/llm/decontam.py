"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

A document leaks an item when a window of as many words as the item has a weighted-shingle
similarity (sum of least over sum of greatest counts) of at least the threshold. Such a
window shares most of its shingles with the item, so only stretches of a document with that
many of the item's shingles are turned into windows; this loses nothing, and it is what
proposes items. Each window's 256-bit SimHash is then looked up in an index by blocks:
fingerprints within ``RADIUS`` bits agree in at least one of ``RADIUS + 1`` blocks. The
lookup only rules items out; what is within the radius is checked exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrist.llm.common import small_batches
from newsgrist.llm.minhash import features
from newsgrist.llm.shingles import U, WIDTH, mix, shingle_hashes

THRESHOLD = 0.8
BITS = 256
# Copies of a shingle vote as elements of their own, so a bit differs with a chance that
# depends on the similarity alone: at 0.8 at most arccos(8/9) / pi. Two fingerprints then
# differ in 39 bits on average, by 5.7 bits either way: 63 is over four deviations away.
RADIUS = 63
# The benchmark goes through in blocks of at most so many text bytes and items; every task
# gets one block at a time, whatever the benchmark's size.
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 5_000

_FILTER_BITS = 22


def simhash(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits as bytes; each element of ``features`` votes once on every bit."""
    lanes = np.arange(BITS // 64, dtype=U) * U(0xD1B54A32D192ED03)
    elements = features(*np.unique(shingles, return_counts=True))
    words = mix(elements[:, None] ^ lanes[None, :])
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts of two multisets; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(nx[i], ny[j]).sum())
    return shared / (len(a) + len(b) - shared)


@dataclass(frozen=True)
class Index:
    """One block of benchmark items."""

    ids: np.ndarray
    shingles: list[np.ndarray]
    prints: np.ndarray  # items x BITS / 8
    vocabulary: np.ndarray  # all shingles, sorted, once each
    owners: list[np.ndarray]  # items that hold each of them
    seen: np.ndarray  # a bitmap of the vocabulary's low bits
    blocks: dict[tuple[int, bytes], list[int]]

    def near(self, print_: np.ndarray) -> set[int]:
        """All items whose fingerprint is within ``RADIUS`` bits, found by equal blocks."""
        found = {i for key in _block_keys(print_) for i in self.blocks.get(key, ())}
        if not found:
            return found
        some = np.array(sorted(found))
        apart = np.unpackbits(self.prints[some] ^ print_, axis=1).sum(axis=1)
        return set(some[apart <= RADIUS].tolist())


def _block_keys(print_: np.ndarray) -> list[tuple[int, bytes]]:
    """``RADIUS + 1`` blocks of equal width: fewer differing bits leave one block alike."""
    width = BITS // (RADIUS + 1)
    bits = np.unpackbits(print_).reshape(-1, width)
    return [(k, row.tobytes()) for k, row in enumerate(bits)]


def build_index(ids: list[int], texts: list[str]) -> Index:
    hashes, first = shingle_hashes(texts)
    own = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
    vocabulary, at = np.unique(hashes, return_inverse=True)
    item = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.argsort(at, kind="stable")
    owners = [np.unique(x) for x in np.split(item[order], np.flatnonzero(np.diff(at[order])) + 1)] if len(hashes) else []
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[(vocabulary >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
    prints = np.array([simhash(s) for s in own], dtype=np.uint8).reshape(len(own), BITS // 8)
    blocks: dict[tuple[int, bytes], list[int]] = defaultdict(list)
    for i, print_ in enumerate(prints):
        for key in _block_keys(print_):
            blocks[key].append(i)
    return Index(np.array(ids), own, prints, vocabulary, owners, seen, dict(blocks))


def leaks_of(document: np.ndarray, index: Index, threshold: float) -> list[tuple[int, float, int]]:
    """``(item, similarity, first word)`` of the best window for each item that leaks."""
    low = index.seen[(document >> U(64 - _FILTER_BITS)).astype(np.int64)]
    places = np.flatnonzero(low)
    if not len(places):
        return []
    at = np.minimum(np.searchsorted(index.vocabulary, document[places]), len(index.vocabulary) - 1)
    real = index.vocabulary[at] == document[places]
    anchors: dict[int, list[int]] = defaultdict(list)
    for place, word in zip(places[real].tolist(), at[real].tolist()):
        for item in index.owners[word].tolist():
            anchors[item].append(place)
    out = []
    for item, where in anchors.items():
        own = index.shingles[item]
        n = min(len(own), len(document))
        # shared / (n + |item| - shared) >= threshold
        need = int(np.ceil(threshold * (n + len(own)) / (1 + threshold) - 1e-9))
        if len(where) < need:
            continue
        places_ = np.array(where)
        # A window with `need` anchors starts within reach of an anchor and of the one
        # `need - 1` further on.
        last = places_[need - 1 :]
        firsts = places_[: len(last)]
        starts = {
            s
            for a, b in zip(firsts.tolist(), last.tolist())
            for s in range(max(0, b - n + 1), min(a, len(document) - n) + 1)
        }
        best = (0.0, 0)
        for start in sorted(starts):
            window = document[start : start + n]
            if item in index.near(simhash(window)):
                found = similarity(window, own)
                if found > best[0]:
                    best = (found, start)
        if best[0] >= threshold:
            out.append((int(index.ids[item]), best[0], best[1]))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks that are small by construction, one at a time on the driver."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")
    ).distinct()
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
        if size >= BLOCK_BYTES or len(ids) >= BLOCK_ITEMS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words`` of each item a document leaks.

    One row for each document and item, with the document's most similar window (the first
    of equals); repeated rows of a table give repeated, equal results. Null or empty texts,
    and texts without words, leak nothing, and such items are not leaked. Items shorter than
    a shingle count as one shingle and are found only in texts that equal them. Benchmark
    rows with a null id are passed over; items of one id with different texts are each
    looked for. Columns other than the ids and texts are ignored.
    """
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = []
    for ids, items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(build_index(ids, items))
        parts.append(texts.mapInArrow(_finder(shared, threshold), schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _finder(shared, threshold: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        width = {int(i): len(s) + WIDTH - 1 for i, s in zip(index.ids, index.shingles)}
        for batch in small_batches(batches, "text"):
            hashes, first = shingle_hashes(batch.column("text").to_pylist())
            hit = index.seen[(hashes >> U(64 - _FILTER_BITS)).astype(np.int64)]
            some = np.add.reduceat(np.append(hit, False), first[:-1]) * (np.diff(first) > 0)
            rows = []
            for i in np.flatnonzero(some).tolist():
                doc = batch.column("doc_id")[i].as_py()
                rows += [(doc, *leak) for leak in leaks_of(hashes[first[i] : first[i + 1]], index, threshold)]
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([width[r[1]] for r in rows], pa.int64()),
                ],
                ["doc_id", "item_id", "similarity", "first_word", "n_words"],
            )

    return find


def drop_leaking(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that leak no item, with all their columns."""
    at = documents.columns.index("text")
    out = documents
    for ids, items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(build_index(ids, items))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text"):
                hashes, first = shingle_hashes(batch.column(at).to_pylist())
                kept = [not leaks_of(hashes[a:b], shared.value, threshold) for a, b in zip(first[:-1], first[1:])]
                yield batch.filter(pa.array(kept))

        out = out.mapInArrow(clean, documents.schema)
    return out
