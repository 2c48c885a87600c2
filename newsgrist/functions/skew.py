"""Equi-joins that survive a key holding a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 256
COPIES = 4

# What may be broadcast: settings of at most so many rows and bytes, and so many digests of
# 16 bytes (8 MB).
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
BROADCAST_KEYS = 500_000


def salt_of(row_id: str | Column, salts: int = SALTS) -> Column:
    """A salt fixed by the row, so recomputed tasks give the same one."""
    column = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def with_salted_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, row_id: str | Column, *, how: str = "left"
) -> DataFrame:
    """``rows`` joined to ``lookup`` (unique by ``key``) without gathering a key in one task.

    The key join runs on the distinct (key, salt) pairs, at most ``SALTS`` per key; the rows
    then fetch their answer by (key, salt). Both use one exchange of the rows.
    """
    salted = rows.withColumn("_salt", salt_of(row_id)).repartition(key, "_salt")
    pairs = salted.select(key, "_salt").where(F.col(key).isNotNull()).distinct()
    answers = pairs.join(lookup, key)
    return salted.join(answers, [key, "_salt"], how).drop("_salt")


def with_copied_lookup(rows: DataFrame, lookup: DataFrame, key: str, row_id: str | Column) -> DataFrame:
    """``rows`` inner-joined to ``lookup`` (unique by ``key``), for rows that ask for many
    different keys each.

    Rows and lookup meet once, by (key, salt), with a copy of the lookup for each of
    ``COPIES`` salts: where most keys are rare, that moves less than the pairs of keys and
    salts would. A key of every row is at most a ``COPIES``-th of the rows in one task, which
    have many other keys.
    """
    salts = F.explode(F.array(*[F.lit(n) for n in range(COPIES)]))
    salted = rows.withColumn("_salt", salt_of(row_id, COPIES))
    # Estimates know nothing of the copies, so no broadcast is to be chosen by them.
    return salted.join(lookup.withColumn("_salt", salts).hint("merge"), [key, "_salt"]).drop("_salt")


def fits(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (data at rest) has at most ``rows`` rows and ``size`` bytes as JSON
    text. Both are sums that combine map-side."""
    found = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")
    ).first()
    return found.rows <= rows and found.size <= size


def with_settings(rows: DataFrame, settings: DataFrame, key: str, row_id: str | Column) -> DataFrame:
    """``rows`` inner-joined to a settings table (unique by ``key``).

    Within the bound the table is broadcast and the rows stay where they are; beyond it, the
    salted lookup takes over.
    """
    if fits(settings, BROADCAST_ROWS):
        return rows.join(F.broadcast(settings), key)
    return with_salted_lookup(rows, settings, key, row_id, how="inner")
