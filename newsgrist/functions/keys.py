"""Looking for the keys of some rows in a long stored table.

Only ids and digests of 16 bytes move; the stored table is scanned on its key columns and not
shuffled while the keys asked for are few enough to be broadcast. With ``filters`` of the
stored keys (``bloom.build``), keys they hold back are not looked for, and if none is left the
stored table is not read at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgrist.functions.bloom import digests, key_digest, possible
from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import BROADCAST_KEYS, with_salted_lookup


def _wanted(keys: DataFrame, columns: list[str], filters: DataFrame | None) -> DataFrame | None:
    """Digests to look for, marked for broadcast within the bound; None if there are none."""
    wanted = digests(keys, columns).distinct()
    if filters is not None:
        wanted = cut_lineage(possible(wanted, filters))
    n = wanted.count()
    if n == 0:
        return None
    return F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted


def having(table: DataFrame, keys: DataFrame, column: str, filters: DataFrame | None = None) -> DataFrame:
    """Rows of ``table`` whose non-empty ``column`` is among those of ``keys``."""
    wanted = _wanted(keys, [column], filters)
    if wanted is None:
        return table.where(F.lit(False))
    rows = table.where(F.col(column) != "").withColumn("digest", key_digest(column))
    return rows.join(wanted, "digest", "left_semi").drop("digest")


def stored_values(store: DataFrame, keys: DataFrame, column: str, filters: DataFrame | None = None) -> DataFrame:
    """Distinct non-empty values of ``column`` that both ``keys`` and the store hold; only
    this column of the store is read."""
    return having(store.select(column), keys, column, filters).distinct()


def rows_having(
    rows: DataFrame, row_id: str, columns: list[str], store: DataFrame, filters: DataFrame | None = None
) -> DataFrame:
    """``row_id`` of the rows (data at rest) of which a non-empty key in ``columns`` is in the
    same column of the store: one pass over the store for all columns. A value of most of the
    rows is many small groups."""
    wanted = _wanted(rows, columns, filters)
    if wanted is None:
        return rows.select(row_id).where(F.lit(False))
    known = digests(store, columns).join(wanted, "digest", "left_semi").distinct()
    probes = digests(rows, columns, row_id)
    return with_salted_lookup(probes, known, "digest", row_id, how="inner").select(row_id).distinct()
