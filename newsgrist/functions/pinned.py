"""Columns computed once, whatever is done with them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pinned(rows: DataFrame, *keep: str | Column, **fields: Column) -> DataFrame:
    """``keep`` and the computed ``fields``, of which no filter gets a copy.

    Catalyst moves a filter below a projection by repeating the projected expression in it,
    so a filter on a parsed or searched column would parse or search twice. Generated
    columns are where that stops; filters on other columns still pass through to the scan.
    """
    struct = F.struct(*[column.alias(name) for name, column in fields.items()])
    return rows.select(*keep, F.inline(F.array(struct)))
