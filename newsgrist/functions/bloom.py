"""Bloom filters of stored keys, as tables.

A key sets ``BITS`` bits of one 64-bit word, picked by its digest; a filter is the words that
are not zero, so it is built by one aggregation and probed by one equi-join, on any cluster and
of any size. Filters of one size are united by OR, word by word. Each is as large as the table
has come to need by then, so those of one size hold no more keys together than the size is
for, and there are as many sizes as the table has doubled. About one key in a hundred that is
not there is let through; none that is there is held back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 5
KEYS_PER_WORD = 4

SCHEMA = "words bigint, word bigint, bits bigint"


def key_digest(column: str) -> Column:
    """16 bytes that stand for a key and the column it is one of."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.lit(column), F.col(column)).cast("binary")))


def _mask(digest: Column) -> Column:
    spots = F.xxhash64(digest, F.lit("bits"))
    out = F.lit(0).cast("bigint")
    for k in range(BITS):
        spot = F.shiftrightunsigned(spots, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), spot))
    return out


def _word(digest: Column, words: Column) -> Column:
    return F.pmod(F.xxhash64(digest), words)


def digests(rows: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """``keep`` and (digest) for every non-empty key in ``columns`` of ``rows``."""
    keys = F.array(*[F.struct(F.when(F.col(c) != "", key_digest(c)).alias("digest")) for c in columns])
    return rows.select(*keep, F.inline(keys)).where("digest is not null")


def build(rows: DataFrame, columns: list[str], stored: int | None = None) -> DataFrame:
    """The filter of ``rows`` (data at rest), which are part of a table of ``stored`` rows. Its
    size is a power of two."""
    keys = (rows.count() if stored is None else stored) * len(columns)
    words = F.lit(1 << max(0, -(-keys // KEYS_PER_WORD) - 1).bit_length()).cast("bigint")
    found = digests(rows, columns).select(words.alias("words"), _word(F.col("digest"), words).alias("word"), _mask(F.col("digest")).alias("mask"))
    return found.groupBy("words", "word").agg(F.bit_or("mask").alias("bits"))


def possible(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """The distinct (digest) of ``keys`` that some filter lets through. Each key is asked once,
    so no word meets more than its share of them."""
    sizes = [r.words for r in filters.select("words").distinct().collect()]  # powers of two
    united = filters.groupBy("words", "word").agg(F.bit_or("bits").alias("bits"))
    words = F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<bigint>"))
    asked = keys.select("digest").distinct().select("digest", words.alias("words"))
    asked = asked.withColumns({"word": _word(F.col("digest"), F.col("words")), "mask": _mask(F.col("digest"))})
    hits = asked.join(united, ["words", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return hits.select("digest").distinct()
