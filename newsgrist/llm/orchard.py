"""Product quantisation of vectors, its nearest entries found by Orchard's search.

Every codebook entry has a list of all other entries by distance. A search stands at an entry
and walks its list: an entry that is nearer to the query (or as near, with a lower index)
becomes the new stand, and its list is walked from the start; an entry more than twice as far
from the stand as the query is ends it, since by the triangle inequality no later one can be
nearer. Entries looked at are marked and not looked at again. Everything is integers, so ties
are exact.

Codebooks are small by their parameters (parts x entries); they go through the driver and with
the tasks. Vectors stay where they are: a round gathers sums and counts by part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import with_salted_lookup

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Larger components are set to this, so that sums of squares stay within 64 bits.
LARGEST = 1 << 26
# Queries searched side by side.
STEP = 4096

Codebooks = np.ndarray  # parts x entries x width


def kept_vectors(embeddings: DataFrame, parts: int, width: int | None = None) -> DataFrame:
    """(vec_id, vector, label) with integer components, of the vectors without null, NaN or
    infinite components that fall into ``parts`` parts; with ``width`` only of that length."""
    known = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = embeddings.where(known & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    if width is not None:
        rows = rows.where(F.size("embedding") == width)
    limit = F.lit(float(LARGEST))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(-limit, F.least(limit, x.cast("double") * SCALE))).cast("bigint"))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("vector"), "label")


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all others by (squared distance, index), and those distances."""
    gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gaps, axis=1, kind="stable")
    own = order == np.arange(len(entries))[:, None]
    others = order[~own].reshape(len(entries), -1)
    return others, np.take_along_axis(gaps, others, axis=1)


def nearest(queries: np.ndarray, entries: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each query; ties to the lower
    index. All queries take their next step together."""
    others, gaps = lists
    n = len(queries)
    stand = np.zeros(n, dtype=np.int64)
    best = ((queries - entries[0]) ** 2).sum(axis=1)
    place = np.zeros(n, dtype=np.int64)
    marked = np.zeros((n, len(entries)), dtype=bool)
    marked[:, 0] = True
    active = np.arange(n) if len(entries) > 1 else np.empty(0, dtype=np.int64)
    while len(active):
        at, step = stand[active], place[active]
        # Twice the distance is four times its square.
        going = gaps[at, step] <= 4 * best[active]
        active, at, step = active[going], at[going], step[going]
        seen = others[at, step]
        place[active] += 1
        fresh = ~marked[active, seen]
        rows, seen = active[fresh], seen[fresh]
        marked[rows, seen] = True
        far = ((queries[rows] - entries[seen]) ** 2).sum(axis=1)
        better = (far < best[rows]) | ((far == best[rows]) & (seen < stand[rows]))
        moved = rows[better]
        stand[moved], best[moved], place[moved] = seen[better], far[better], 0
        active = active[place[active] < others.shape[1]]
    return stand, best


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, STEP):
            batch = whole.slice(start, STEP)
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield batch, vectors.astype(np.int64).reshape(batch.num_rows, width)


def _assigned(vectors: np.ndarray, books: Codebooks, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance for each vector and part."""
    width = books.shape[2]
    found = [nearest(vectors[:, p * width : (p + 1) * width], books[p], lists[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids: at most ``entries`` rows reach the
    driver. Of equal ids the lesser vector comes first, null ids last."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    whole = np.array([r.vector for r in rows], dtype=np.int64)
    return whole.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; unused ones stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [neighbour_lists(b) for b in books]
        total, count = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for _, block in _batches(batches, parts * width):
            chosen, _ = _assigned(block, books, lists)
            for p in range(parts):
                np.add.at(total[p], chosen[:, p], block[:, p * width : (p + 1) * width])
                count[p] += np.bincount(chosen[:, p], minlength=entries)
        used = np.flatnonzero(count.ravel())
        yield pa.record_batch(
            [
                pa.array(np.repeat(used, width), pa.int32()), pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                pa.array(total.reshape(-1, width)[used].ravel(), pa.int64()), pa.array(np.repeat(count.ravel()[used], width), pa.int64()),
            ],
            ["slot", "place", "total", "n"],
        )

    found = vectors.select("vector").mapInArrow(sums, "slot int, place int, total bigint, n bigint")
    out = books.reshape(-1, width).copy()
    # parts x entries x width rows at most
    for r in found.groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.slot, r.place] = r.total // r.n
    return out.reshape(books.shape)


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = improved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    parts, _, width = books.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [neighbour_lists(b) for b in books]
        for batch, block in _batches(batches, parts * width):
            chosen, far = _assigned(block, books, lists)
            codes = [bytes(row).hex() for row in chosen.astype(np.uint8)]
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(far.sum(axis=1), pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    label = dict(vectors.dtypes)["label"]
    return vectors.select("vec_id", "label", "vector").mapInArrow(coded, f"vec_id bigint, label {label}, code string, error bigint")


def compress_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every kept vector.

    Left out are vectors that are null or empty, hold null, NaN or infinite components or have
    a length that is no multiple of ``parts``, and of the others those of another length than
    the one with the smallest id. ``entries`` is at most 256. With fewer vectors than entries the
    codebooks have fewer entries. Repeated rows count each; of equal ids the lesser vector
    comes first. Null labels are one group. Components of 2^18 or more in size count as 2^18.
    An empty table gives no rows; other columns are ignored.
    """
    # The vector with the smallest id tells the length.
    first = kept_vectors(embeddings, parts).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("n")).collect()
    width = first[0].n if first else parts
    vectors = cut_lineage(kept_vectors(embeddings, parts, width))
    if not first:
        none = vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return none.withColumns({"label_error": F.col("error"), "codebooks_sha256": F.lit(codebooks_digest(np.empty(0)))})
    books = train(vectors, parts, entries, rounds)
    codes = cut_lineage(encode(vectors, books).withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    totals = codes.groupBy("group").agg(F.sum("error").alias("label_error"))
    out = with_salted_lookup(codes, totals, "group", F.coalesce("vec_id", F.lit(-1)))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
