"""Exact dedup by content sort.

Sampled splitters deal the normalised texts to ranges, every range is sorted (Spark's
external sort), and neighbours are compared in full. Equal texts lie side by side; a run of
them may go on in the next range, so a hot text never has to fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import with_salted_lookup
from newsgrist.llm.common import unused

# Bytes of a text that a splitter holds: what the driver gets of each sampled row.
SPLITTER_BYTES = 48


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space as one space; null as empty.

    Lone spaces stay as they are, so only other runs have to be replaced.
    """
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " "
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range -> their run. ``edge_text`` is set on the first row of runs
    that share (_head, _hash) with the range's first or last row: they may go on elsewhere."""
    base = TaskContext.get().partitionId() << 40
    run, last, digest = -1, None, None
    first_class: tuple | None = None
    # First rows of the runs of the current class, kept back until it is known not to be last.
    pending: list[tuple[int, str]] = []
    pending_class: tuple | None = None
    for batch in batches:
        texts, heads, hashes = (batch.column(k) for k in ("_text", "_head", "_hash"))
        n = batch.num_rows
        if not n:
            continue
        same = [False] * n
        if n > 1:
            same[1:] = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_pylist()
        same[0] = last is not None and texts[0].as_py() == last
        runs, digests, starts, edges = [], [], [], []
        for i, equal in enumerate(same):
            edge = None
            if not equal:
                run += 1
                text = texts[i].as_py()
                digest = hashlib.sha256(text.encode()).hexdigest()
                here = (heads[i].as_py(), hashes[i].as_py())
                if here != pending_class:
                    pending, pending_class = [], here
                if first_class is None:
                    first_class = here
                if here == first_class:
                    edge = text
                else:
                    pending.append((run, text))
            runs.append(base + run)
            digests.append(digest)
            starts.append(not equal)
            edges.append(edge)
        last = texts[n - 1].as_py()
        yield pa.record_batch(
            [
                batch.column("_row"), batch.column("doc_id"), pa.array(runs, pa.int64()),
                pa.array(digests, pa.string()), pa.array(starts, pa.bool_()),
                pa.array(edges, pa.string()),
            ],
            ["_row", "doc_id", "run", "text_sha256", "starts", "edge_text"],
        )
    if pending and pending_class != first_class:
        k = len(pending)
        yield pa.record_batch(
            [
                pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()),
                pa.array([base + r for r, _ in pending], pa.int64()), pa.nulls(k, pa.string()),
                pa.nulls(k, pa.bool_()), pa.array([t for _, t in pending], pa.string()),
            ],
            ["_row", "doc_id", "run", "text_sha256", "starts", "edge_text"],
        )


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``documents``.

    Texts are equal when their normalised forms are; a null text counts as empty. Of equal
    texts the row with the smallest ``doc_id`` is kept (null ids come last; of repeated rows
    with the smallest id one is kept). Every input row gives one row, also repeated ones. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = normalised(F.col("text"))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("_text"))
    rows = rows.select(
        "doc_id", "_text", F.lit(True).alias("_row"),
        F.substring(F.encode("_text", "utf-8"), 1, SPLITTER_BYTES).alias("_head"),
        F.xxhash64("_text").alias("_hash"),
    )
    id_order = F.col("doc_id").asc_nulls_last()
    ranges = rows.repartitionByRange("_head", "_hash", id_order).sortWithinPartitions(
        "_head", "_hash", "_text", id_order
    )
    found = cut_lineage(
        ranges.mapInArrow(
            _runs,
            "_row boolean, doc_id bigint, run bigint, text_sha256 string, starts boolean, edge_text string",
        )
    )
    members = found.where("_row").drop("_row", "edge_text")

    # Runs at range edges with the same text are one group: a few for each range.
    edges = found.where("edge_text is not null").select("run", "edge_text")
    joined = edges.groupBy("edge_text").agg(F.min("run").alias("group")).join(edges, "edge_text")
    stats = members.groupBy("run").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n")
    ).join(joined.select("run", "group"), "run", "left")
    stats = stats.withColumn("group", F.coalesce("group", "run"))
    # A group of one run needs nothing more; the others meet under their first run.
    whole = stats.groupBy("group").agg(
        F.sum("n").alias("group_size"),
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "run")).alias("least"),
    )
    per_run = stats.select("run", "group").join(whole, "group").select(
        "run", "group_size", F.col("least.first_id").alias("keep_id"), F.col("least.run").alias("kept_run")
    )
    row_id = F.coalesce("doc_id", F.lit(-1))
    out = with_salted_lookup(members, per_run, "run", row_id)
    return out.select(
        "doc_id", "keep_id", "group_size",
        (F.col("starts") & (F.col("run") == F.col("kept_run"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``exact_duplicates`` keeps, with all their columns.

    Rows are known by ``doc_id`` (null counts as an id of its own) and normalised text; of
    rows equal in both one stays.
    """
    null_id = F.lit(-(1 << 63))
    own, sha = unused(documents, "_id"), unused(documents, "_sha")
    kept = exact_duplicates(documents).where("kept").select(
        F.coalesce("doc_id", null_id).alias(own), F.col("text_sha256").alias(sha)
    )
    rows = documents.withColumns(
        {own: F.coalesce(F.col("doc_id").cast("bigint"), null_id), sha: F.sha2(normalised(F.col("text")), 256)}
    )
    # Both sides are dealt and sorted by the join's keys, which the last step uses again.
    return rows.join(kept, [own, sha], "left_semi").dropDuplicates([own, sha]).select(*documents.columns)
