"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import with_salted_lookup


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (a, b), and the least vertex of each one's component."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(ids))
    u, w = place[: len(a)], place[len(a) :]
    while len(u):
        low, high = np.minimum(up[u], up[w]), np.maximum(up[u], up[w])
        apart = low != high
        u, w = u[apart], w[apart]
        np.minimum.at(up, high[apart], low[apart])
        while not np.array_equal(up, above := up[up]):
            up = above
    return ids, ids[up]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if edges:
        v, r = roots(*(np.concatenate(x) for x in zip(*edges)))
        yield pa.record_batch([pa.array(v), pa.array(r)], ["v", "r"])


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b), both bigint and not null.

    Vertices should be hashes, so that the least of a few is a random one. Edges are dealt by
    their first end; every task joins what it holds and passes on only a vertex's roots. Roots
    of one vertex are the edges of the next step, so a step leaves a fraction of the vertices,
    and what fits one task is done in one step. A vertex meets as many roots as it has been in
    tasks; a hot one as the second end is dealt with the first.
    """
    steps = []
    while True:
        links = edges.repartition("a").mapInArrow(_contracted, "v bigint, r bigint")
        by_root = Window.partitionBy("v").orderBy("r")
        links = links.withColumns({"m": F.first("r").over(by_root), "nth": F.row_number().over(by_root)})
        links = cut_lineage(links)
        steps.append(links.where("nth = 1").select("v", "m"))
        apart = links.where("r <> m")
        if apart.isEmpty():
            break
        edges = apart.select(F.col("r").alias("a"), F.col("m").alias("b")).distinct()
    found = steps[0].withColumnRenamed("m", "component")
    for step in steps[1:]:
        step = step.select(F.col("v").alias("component"), "m")
        found = with_salted_lookup(found, step, "component", "v").select("v", F.coalesce("m", "component").alias("component"))
    return found
