"""Near-dedup by BagMinHash.

A document is a bag of word shingles with counts. BagMinHash gives every shingle Poisson
processes over its weight axis; a signature entry is the earliest point that falls on it, so
two entries are equal with a chance that is the bags' weighted Jaccard similarity. Bands of
entries propose pairs, full bags decide on them, and linked documents form classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import with_salted_lookup
from newsgrist.llm.common import small_batches, unused
from newsgrist.llm.shingles import U, mix, shingle_hashes

THRESHOLD = 0.8
# A pair at similarity 0.8 shares a band with chance 1 - (1 - 0.8**4)**24 > 0.999996.
BANDS, BAND_ROWS = 24, 4
ENTRIES = BANDS * BAND_ROWS

_GOLDEN = 0x9E3779B97F4A7C15


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1], fixed by the seed."""
    bits = mix(seed + U(salt * _GOLDEN % (1 << 64)))
    return ((bits >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (sorted within each text), their counts, and ``first`` per text."""
    hashes, first = shingle_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hashes)))
    out_first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.bincount(owner[at], minlength=len(texts)), out=out_first[1:])
    return hashes[at], counts, out_first


def signatures(shingles: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BagMinHash signatures, one row of ``ENTRIES`` 32-bit integers for each bag.

    The weight axis of a shingle is cut at 1, 2, 4, 8, ... into intervals, each with its own
    process of a rate equal to its width. A count takes the intervals below it whole; of the
    one it ends in, a point counts only if its place on the axis, fixed by halving, lies
    below the count. Points come in order of time, and an interval is done once its time is
    beyond the latest entry of its bag. Empty bags get all zeros.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    doc, seed, weight, low, width = [owner], [mix(shingles)], [counts], [np.zeros(len(shingles))], [np.ones(len(shingles))]
    start = 1
    while len(more := np.flatnonzero(counts > start)):
        doc.append(owner[more])
        seed.append(mix(shingles[more] + U(start * _GOLDEN % (1 << 64))))
        weight.append(counts[more])
        low.append(np.full(len(more), float(start)))
        width.append(np.full(len(more), float(start)))
        start *= 2
    doc, seed, weight, low, width = map(np.concatenate, (doc, seed, weight, low, width))
    inside = weight >= low + width

    best = np.full(n * ENTRIES, np.inf)
    mark = np.zeros(n * ENTRIES, dtype=np.uint32)
    latest = np.full(n, np.inf)
    time = np.zeros(len(doc))
    live = np.arange(len(doc))
    point = 0
    while len(live):
        point += 1
        s = seed[live] + U(point * 0xD1B54A32D192ED03 % (1 << 64))
        time[live] -= np.log(_uniform(s, 1)) / width[live]
        on = time[live] < latest[doc[live]]
        live, s = live[on], s[on]
        if not len(live):
            break
        counted = inside[live]
        if not counted.all():
            place = low[live] + width[live] * _uniform(s, 2)
            counted = counted | (place <= weight[live])
        chosen, s = live[counted], s[counted]
        draw = mix(s ^ U(0xA0761D6478BD642F))
        slot = doc[chosen] * ENTRIES + (draw % U(ENTRIES)).astype(np.int64)
        t = time[chosen]
        np.minimum.at(best, slot, t)
        won = best[slot] == t
        mark[slot[won]] = (draw[won] >> U(32)).astype(np.uint32)
        latest = best.reshape(n, ENTRIES).max(axis=1)
    mark[np.isinf(best)] = 0
    return mark.reshape(n, ENTRIES)


def features(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bag as a sorted set: the k-th copy of a shingle is an element of its own. Shared
    elements are then the sum of least counts."""
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    each = np.repeat(shingles, counts)
    return np.sort(np.where(copy > 0, mix(each + copy.astype(U) * U(_GOLDEN)), each))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts of two bags, given by ``features``."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - shared
    return shared / every if every else 1.0


def overlaps(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """``overlap`` of all ``rows`` with all ``others``, by products of 0/1 matrices over a
    few thousand elements at a time."""
    both = [*rows, *others]
    sizes = np.array([len(x) for x in both], dtype=np.float64)
    owner = np.repeat(np.arange(len(both)), sizes.astype(np.int64))
    _, element, held = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    common = held[element] > 1
    element, owner = element[common], owner[common]
    numbers, element = np.unique(element, return_inverse=True)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    shared = np.zeros((len(rows), len(others)), dtype=np.float64)
    for low in range(0, len(numbers), 2048):
        a, b = np.searchsorted(element, [low, low + 2048])
        part = np.zeros((len(both), min(2048, len(numbers) - low)), dtype=np.float32)
        part[owner[a:b], element[a:b] - low] = 1
        shared += part[: len(rows)] @ part[len(rows) :].T
    every = sizes[: len(rows), None] + sizes[None, len(rows) :] - shared
    return shared / np.maximum(every, 1)


def _bag_key(shingles: np.ndarray, counts: np.ndarray) -> bytes:
    """Equal for equal bags only, as far as 128 bits tell."""
    return hashlib.blake2b(shingles.tobytes() + counts.astype("<i8").tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        shingles, counts, first = bags(batch.column("text").to_pylist())
        rows = signatures(shingles, counts, first)
        spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
        keys = [_bag_key(shingles[a:b], counts[a:b]) for a, b in spans]
        grouped = rows.reshape(len(spans), BANDS, BAND_ROWS).astype(np.uint64)
        band = np.zeros((len(spans), BANDS), dtype=U)
        for k in range(BAND_ROWS):
            band = mix(band * U(_GOLDEN) + grouped[:, :, k])
        band = mix(band + np.arange(BANDS, dtype=U)).view(np.int64)
        empty = np.diff(first) == 0
        yield pa.record_batch(
            [
                batch.column("doc_id"), pa.array(keys, pa.binary()),
                pa.array([int(counts[a:b].sum()) for a, b in spans], pa.int64()),
                pa.array([[] if e else b for e, b in zip(empty, band.tolist())], pa.list_(pa.int64())),
            ],
            ["doc_id", "bag", "size", "bands"],
        )


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        shingles, counts, first = bags(batch.column("text").to_pylist())
        spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
        sets = [features(shingles[a:b], counts[a:b]) for a, b in spans]
        yield pa.record_batch(
            [
                pa.array([_bag_key(shingles[a:b], counts[a:b]) for a, b in spans], pa.binary()),
                pa.array([x.tobytes() for x in sets], pa.binary()),
            ],
            ["bag", "features"],
        )


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def _verified(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("features"), batch.column("other_features"))
            found = [overlap(_set(a.as_py()), _set(b.as_py())) >= threshold for a, b in pairs]
            yield pa.record_batch([batch.column("bag"), batch.column("other")], ["bag", "other"]).filter(pa.array(found, pa.bool_()))

    return verify


def _cell_links(threshold: float):
    """Links between classes within one cell; of those that join the same classes, one."""

    def compare(group: pa.Table) -> pa.Table:
        keys = group.column("bag").to_pylist()
        names, classes = np.unique(np.array([c.hex() for c in group.column("class").to_pylist()]), return_inverse=True)
        sets = [_set(x) for x in group.column("features").to_pylist()]
        side = np.array(group.column("right").to_pylist())
        rows, others = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(others):  # a block with itself
            others = rows
        near = overlaps([sets[i] for i in rows], [sets[j] for j in others]) >= threshold
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(near & (classes[rows][:, None] != classes[others][None, :]))):
            a, b = root(classes[rows[i]]), root(classes[others[j]])
            if a != b:
                parent[a] = b
                out.append((keys[rows[i]], keys[others[j]]))
        return pa.table({"bag": pa.array([a for a, _ in out], pa.binary()), "other": pa.array([b for _, b in out], pa.binary())})

    return compare


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after new links: ``labels`` (bag, class) coarsened until links stay inside.

    Works on classes only: each round every class takes the least class it is linked to, and
    what that one takes, so chains shorten by half. Rounds are written tables.
    """
    a, b = labels.select("bag", F.col("class").alias("a")), labels.select(F.col("bag").alias("other"), F.col("class").alias("b"))
    pairs = links.join(a, "bag").join(b, "other").where("a <> b").select("a", "b")
    pairs = cut_lineage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    moves = []
    while not pairs.isEmpty():
        # Every class points to its least neighbour, if that is less than itself.
        step = pairs.groupBy("a").agg(F.min("b").alias("b"))
        after = step.select(F.col("a").alias("b"), F.col("b").alias("c"))
        step = cut_lineage(step.join(after, "b", "left").select("a", F.coalesce("c", "b").alias("b")))
        moves.append(step)
        to = step.select(F.col("a").alias("x"), F.col("b").alias("y"))
        moved = (
            pairs.join(to, pairs.a == to.x, "left").select(F.coalesce("y", "a").alias("a"), "b")
        )
        moved = moved.join(to, moved.b == to.x, "left").select("a", F.coalesce("y", "b").alias("b"))
        pairs = cut_lineage(
            moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
    for step in moves:
        labels = labels.join(step, labels["class"] == step.a, "left").select("bag", F.coalesce("b", "class").alias("class"))
    return cut_lineage(labels)


NULL_ID = -(1 << 63)
# What one side of a cell holds: bags and elements.
CELL_BAGS, CELL_ELEMENTS = 512, 1 << 20
# Ids of 8 bytes that may be broadcast: 8 MB.
BROADCAST_IDS = 1_000_000


def _id(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NULL_ID))


def _signed(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_sign, "doc_id bigint, bag binary, size bigint, bands array<bigint>")


def _first_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Every bag of a bucket against the bucket's least bag. Sizes too far apart for the
    threshold rule a pair out without its shingles."""
    least, most = F.least("size", "center_size"), F.greatest("size", "center_size")
    pairs = members.where((F.col("bag") != F.col("center")) & (least >= threshold * most)).select(
        "bag", F.col("center").alias("other")
    ).distinct()
    with_own = pairs.join(sets.select("bag", "features"), "bag")
    centers = sets.select(F.col("bag").alias("other"), F.col("features").alias("other_features"))
    both = with_salted_lookup(with_own, centers, "other", "bag", how="inner")
    return both.mapInArrow(_verified(threshold), "bag binary, other binary")


def _cells(members: DataFrame, labels: DataFrame) -> DataFrame:
    """What is left to compare: in each bucket the bags outside the largest class, against
    each other and against that class. ``cell, bag, class, right`` with bounded cells.

    The bucket's least bag has met all others already.
    """
    rest = members.where("bag <> center").join(labels, "bag")
    classes = rest.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("size").alias("elements"))
    large = F.max(F.struct("n", "class", "elements")).alias("top")
    buckets = classes.groupBy("band").agg(large, F.sum("n").alias("n"), F.sum("elements").alias("elements"))

    def blocks(n, elements):
        return F.greatest(F.ceil(n / CELL_BAGS), F.ceil(elements / CELL_ELEMENTS), F.lit(1)).cast("int")

    buckets = buckets.where("n > top.n").select(
        "band", F.col("top.class").alias("base"),
        blocks(F.col("top.n"), F.col("top.elements")).alias("base_blocks"),
        blocks(F.col("n") - F.col("top.n"), F.col("elements") - F.col("top.elements")).alias("blocks"),
    )
    open_ = with_salted_lookup(rest.select("band", "bag", "class"), buckets, "band", "bag", how="inner")
    base = F.col("class") == F.col("base")
    own = F.pmod(F.xxhash64("bag"), F.when(base, F.col("base_blocks")).otherwise(F.col("blocks"))).cast("int")
    rows = open_.select("band", "bag", "class", base.alias("base"), own.alias("own"), "blocks", "base_blocks")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own_cells = F.transform(
        every, lambda k: F.struct(F.lit(False).alias("base"), F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"), (F.col("own") > k).alias("right"))
    )
    with_base = F.transform(
        F.sequence(F.lit(0), F.col("base_blocks") - 1),
        lambda k: F.struct(F.lit(True).alias("base"), F.col("own").alias("i"), k.alias("j"), F.lit(False).alias("right")),
    )
    base_cells = F.transform(
        every, lambda k: F.struct(F.lit(True).alias("base"), k.alias("i"), F.col("own").alias("j"), F.lit(True).alias("right"))
    )
    cells = F.when(F.col("base"), base_cells).otherwise(F.concat(own_cells, with_base))
    named = F.struct("band", "cell.base", "cell.i", "cell.j")
    placed = cut_lineage(
        rows.select("band", "bag", "class", F.explode(cells).alias("cell")).select(named.alias("cell"), "bag", "class", "cell.right")
    )
    mixed = placed.groupBy("cell").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    return placed.join(mixed.select("cell"), "cell", "left_semi")


def near_duplicates(documents: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size, bag`` for every row of ``documents``.

    Documents are linked when their bags of five-word shingles overlap by ``threshold`` or
    more; a class is what links connect, named by its smallest ``doc_id`` (null if it has
    only null ids). Texts with fewer than five words are one shingle; null and empty texts
    and those without words are one class. Each row gives one row, repeated ones too; other
    columns are ignored. Only rows with equal bags are joined without a comparison.

    A pair at the threshold that shares no band (a chance below 4e-6, less above it) is the
    only link that can be missed: in each bucket all pairs of different classes are checked.
    """
    signed = cut_lineage(_signed(documents))
    one = [F.any_value(c).alias(c) for c in ("size", "bands")]
    bags_ = signed.groupBy("bag").agg(F.min("doc_id").alias("first_id"), *one)
    banded = bags_.select("bag", "first_id", "size", F.explode("bands").alias("band"))
    marks = [F.bit_xor(F.xxhash64("bag", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("bag", "size")).alias("center"), *marks)
    # Near copies share many bands: of buckets with the same bags one is enough.
    buckets = buckets.where("n > 1").groupBy("n", "center", "mark0", "mark1").agg(F.min("band").alias("band"))
    buckets = buckets.select("band", F.col("center.bag").alias("center"), F.col("center.size").alias("center_size"))
    members = cut_lineage(with_salted_lookup(banded, buckets, "band", "bag", how="inner"))

    candidates = members.select("bag", _id("first_id").alias("_id")).distinct()
    wanted = cut_lineage(candidates.select("_id").distinct())
    if wanted.count() <= BROADCAST_IDS:  # else the texts are dealt by id
        wanted = F.broadcast(wanted)
    texts = documents.select(_id().alias("_id"), "text").join(wanted, "_id", "left_semi").select("text")
    sets = texts.mapInArrow(_with_features, "bag binary, features binary")
    sets = cut_lineage(sets.groupBy("bag").agg(F.any_value("features").alias("features")))

    labels = candidates.select("bag", F.col("bag").alias("class"))
    labels = _relabel(labels, cut_lineage(_first_links(members, sets, threshold)))
    cells = _cells(members, labels).join(sets, "bag")
    more = cells.groupBy("cell").applyInArrow(_cell_links(threshold), "bag binary, other binary")
    labels = _relabel(labels, cut_lineage(more.distinct()))

    sized = signed.groupBy("bag").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    classed = sized.join(labels, "bag", "left").withColumn("class", F.coalesce("class", "bag"))
    classes = classed.groupBy("class").agg(
        F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"),
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "bag")).alias("least"),
    )
    per_bag = classed.select("bag", "class").join(classes, "class").select("bag", "class_id", "class_size", F.col("least.bag").alias("kept_bag"))
    rows = signed.select("doc_id", "bag")
    return with_salted_lookup(rows, per_bag, "bag", F.coalesce("doc_id", F.lit(-1))).select(
        "doc_id", "class_id", "class_size", "bag", (F.col("bag") == F.col("kept_bag")).alias("kept_bag")
    )


def drop_near_duplicates(documents: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``near_duplicates``, with all columns: of those with the
    smallest ``doc_id`` one whose bag is the least."""
    own, bag = unused(documents, "_id"), unused(documents, "_bag")
    found = near_duplicates(documents, threshold=threshold).where("kept_bag and doc_id <=> class_id")
    kept = found.select(_id().alias(own), F.col("bag").alias(bag)).distinct()
    at = documents.columns.index("text")

    def with_bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            shingles, counts, first = bags(batch.column(at).to_pylist())
            keys = [_bag_key(shingles[a:b], counts[a:b]) for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, bag])

    schema = StructType([*documents.schema.fields, StructField(bag, BinaryType())])
    rows = documents.mapInArrow(with_bag, schema).withColumn(own, _id())
    return rows.join(kept, [own, bag], "left_semi").dropDuplicates([own, bag]).select(*documents.columns)
