"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Bytes of text that one vectorised step works on; a longer text is cut between words.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called like that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that ``column`` holds about ``STEP_BYTES`` in each, one row at least."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        sizes = np.array([0 if v is None else v for v in pc.binary_length(values).to_pylist()])
        cut = np.cumsum(sizes) // STEP_BYTES
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)
