"""Order-aware dedup over several keys (DD-1..5, JN-5).

A row is a duplicate if an earlier *kept* row shares one of its keys: its url, its
canonical url, its content hash, or title and source. Dropped rows block nobody. Processing
in order equals the greedy independent set of the "shares a key" graph:

1. per key, the smallest undecided row; a row smallest for all its keys is kept;
2. other rows with a key of a kept row are dropped;
3. what is left falls into components that share no key. Each one of bounded size is decided
   in order, in one pass over its sorted rows, however long its chains are;
4. larger ones go through 1 and 2 again, which breaks them up, then through 3.

Only (key, row number) pairs move, never articles, and after the first count only pairs of
keys with two or more rows. Keys that hold a large share of the rows are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrist.functions import text, urls
from newsgrist.functions.components import components
from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import salt_of, with_salted_lookup

URL, HASH, TITLE = "url", "content_hash", "title_source"
_PRIORITY = {URL: 1, HASH: 2, TITLE: 3}

# Pairs of a component that one task decides; larger components go through rounds.
COMPONENT_PAIRS = 200_000
# Rounds before components are looked for again.
ROUNDS = 3


def _key(family: str, *values: Column) -> Column:
    """128 bits of a digest: rows move 16 bytes per key instead of urls and titles."""
    joined = F.concat_ws("\x00", F.lit(family), *values)
    return F.struct(
        F.unhex(F.substring(F.sha2(joined, 256), 1, 32)).alias("k"),
        F.lit(_PRIORITY[family]).alias("family"),
    )


def url_keys(url: Column) -> list[Column]:
    plain = F.coalesce(url, F.lit(""))
    return [_key(URL, plain), _key(URL, urls.canonical_url(plain))]


def hash_key(content_hash: Column) -> Column:
    """Null (no key) for a null or empty hash."""
    return F.when(F.coalesce(content_hash, F.lit("")) != "", _key(HASH, content_hash))


def title_source_key(title: Column, source: Column, *, cleaned: bool = False) -> Column:
    return _key(
        TITLE, text.title_key(F.coalesce(title, F.lit("")), cleaned=cleaned), text.source_key(source)
    )


def article_keys(articles: DataFrame, seq: str, *, normalized: bool) -> DataFrame:
    """(k, family, seq): the keys of every article.

    ``normalized`` says the articles come from ``normalize``: their hash covers the canonical
    url, so equal hashes imply an equal url key and the hash key is left out; titles need no
    first cleaning.
    """
    keys = url_keys(F.col("url")) + [
        title_source_key(F.col("title"), F.col("source"), cleaned=normalized)
    ]
    if not normalized:
        keys.append(hash_key(F.col("content_hash")))
    distinct = F.array_distinct(F.array_compact(F.array(*keys)))
    rows = articles.select(F.col(seq).alias("seq"), distinct.alias("keys"))
    # Never empty; the outer form spares the filter on the array, which would compute it twice.
    return rows.select("seq", F.explode_outer("keys").alias("key")).select("key.k", "key.family", "seq")


def known_keys(
    urls_seen: DataFrame | None = None,
    hashes_seen: DataFrame | None = None,
    titles_seen: DataFrame | None = None,
) -> DataFrame | None:
    """(k): keys of earlier runs from ``(url)``, ``(content_hash)`` and ``(title, source)``."""
    parts = []
    if urls_seen is not None:
        both = F.array(*url_keys(F.col("url")))
        parts.append(urls_seen.select(F.explode(both).alias("key")))
    if hashes_seen is not None:
        parts.append(
            hashes_seen.select(hash_key(F.col("content_hash")).alias("key")).where("key is not null")
        )
    if titles_seen is not None:
        parts.append(
            titles_seen.select(title_source_key(F.col("title"), F.col("source")).alias("key"))
        )
    if not parts:
        return None
    keys = parts[0]
    for part in parts[1:]:
        keys = keys.union(part)
    return keys.select("key.k").distinct()


def _with_minimum(pairs: DataFrame, *, shared_only: bool = False) -> DataFrame:
    """``pairs`` with ``m``, the smallest seq of their key; optionally without keys of one row.

    The pairs are shuffled by (key, salt) for the minima per (key, salt) and for the join back.
    Pairs that cost anything to make should be at rest: the two sides read different columns,
    so Spark takes two exchanges, each with all that comes before it. The window over a key
    sees at most one row per salt.
    """
    salted = pairs.withColumn("salt", salt_of("seq")).repartition("k", "salt")
    partial = salted.groupBy("k", "salt").agg(F.min("seq").alias("m"), F.count("*").alias("n"))
    key = Window.partitionBy("k")
    minima = partial.select(
        "k", "salt", F.min("m").over(key).alias("m"), F.sum("n").over(key).alias("n")
    )
    if shared_only:
        minima = minima.where(F.col("n") > 1)
    return salted.join(minima, ["k", "salt"]).select("k", "family", "seq", "m")


def _with_kept(pairs: DataFrame) -> DataFrame:
    """``kept``: the row is the smallest of all its keys. A row has at most four pairs."""
    row = Window.partitionBy("seq")
    return pairs.withColumn("kept", F.min(F.col("m") == F.col("seq")).over(row)).drop("m")


def _undecided(marked: DataFrame) -> DataFrame:
    """Pairs of rows neither kept nor sharing a key with a kept row."""
    claimed = marked.where("kept").select("k", F.lit(True).alias("claimed"))
    rest = with_salted_lookup(marked.where("not kept").drop("kept"), claimed, "k", "seq")
    blocked = F.max(F.coalesce("claimed", F.lit(False))).over(Window.partitionBy("seq"))
    return (
        rest.withColumn("blocked", blocked).where("not blocked").select("k", "family", "seq")
    )


def _with_component(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``row``, a hash of seq, and ``component``, the least hash it is linked to."""
    row = F.xxhash64("seq")
    linked = _with_minimum(pairs).where(F.col("seq") != F.col("m"))
    found = components(linked.select(row.alias("a"), F.xxhash64("m").alias("b")))
    found = found.withColumnRenamed("v", "row")
    joined = pairs.withColumn("row", row).join(found, "row", "left")
    return joined.withColumn("component", F.coalesce("component", "row"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs sorted by (component, seq) -> those of kept rows. A row is kept if none of its
    keys belongs to an earlier kept one of its component."""
    claimed: set[bytes] = set()
    component = None
    rest: pa.Table | None = None

    def decided(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        """The kept pairs, and the pairs of the last row unless it is complete."""
        nonlocal component
        rows, keys = table.column("row").to_numpy(), table.column("k").to_pylist()
        of = table.column("component").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (of[1:] != of[:-1])])).tolist()
        ends = [*first[1:], len(rows)]
        whole = len(first) if last else len(first) - 1
        keep = np.zeros(len(rows), dtype=bool)
        for start, end in zip(first[:whole], ends):
            if of[start] != component:
                component = of[start]
                claimed.clear()
            own = keys[start:end]
            if claimed.isdisjoint(own):
                claimed.update(own)
                keep[start:end] = True
        return table.filter(pa.array(keep)), table.slice(ends[whole - 1] if whole else 0)

    for batch in batches:
        if batch.num_rows:
            new = pa.Table.from_batches([batch])
            kept, rest = decided(new if rest is None else pa.concat_tables([rest, new]), False)
            yield from kept.select(["k", "family", "seq"]).to_batches()
    if rest is not None and rest.num_rows:
        yield from decided(rest, True)[0].select(["k", "family", "seq"]).to_batches()


def _kept_pairs(marked: DataFrame) -> DataFrame:
    """All kept pairs, given the (cut) first round.

    Small components take one pass each. In the others every round settles the least row of
    every key; the passes in between take what has fallen apart.
    """
    kept = marked.where("kept").drop("kept")
    schema = marked.drop("kept").schema
    undecided = cut_lineage(_undecided(marked))
    while n := undecided.count():
        small = pairs = cut_lineage(_with_component(undecided))
        over = n > COMPONENT_PAIRS
        if over:
            large = pairs.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > COMPONENT_PAIRS)
            pairs = cut_lineage(with_salted_lookup(pairs, large.select("component", F.lit(True).alias("large")), "component", "row"))
            small = pairs.where("large is null").drop("large")
        ordered = small.repartition("component").sortWithinPartitions("component", "seq", "row")
        kept = kept.unionByName(ordered.mapInArrow(_in_order, schema))
        if not over:
            break
        undecided = pairs.where("large").select("k", "family", "seq")
        for _ in range(ROUNDS):
            marked = cut_lineage(_with_kept(_with_minimum(undecided)))
            kept = kept.unionByName(marked.where("kept").drop("kept"))
            undecided = cut_lineage(_undecided(marked))
    return kept


def find_duplicates(
    articles: DataFrame, seq: str = "seq", *, normalized: bool = False,
    known: DataFrame | None = None, reasons: bool = True,
) -> DataFrame:
    """(seq, reason) of the duplicates in ``articles``; ``seq`` is their unique order, a
    number or any other type that sorts, such as the ``ord`` struct.

    ``known`` holds keys of earlier runs (``known_keys``): rows with one of them are dropped
    first and block nobody. ``reason`` is the first matching family, url before hash before
    title and source, over known keys and all kept rows (DD-5); without ``reasons`` the
    result is (seq) only and one lookup cheaper.
    """
    # Written first: minima and join read the pairs through exchanges of their own, and what
    # makes them, cleaning included, would run for each.
    pairs = cut_lineage(article_keys(articles, seq, normalized=normalized))
    seen = None
    if known is None:
        shared = cut_lineage(_with_kept(_with_minimum(pairs, shared_only=True)))
        first = shared
    else:
        shared = cut_lineage(_with_minimum(pairs, shared_only=True).drop("m"))
        hits = with_salted_lookup(pairs, known.select("k"), "k", "seq", how="inner")
        seen = cut_lineage(hits.groupBy("seq").agg(F.min("family").alias("family")))
        alive = shared.join(seen.select("seq"), "seq", "left_anti")
        first = cut_lineage(_with_kept(_with_minimum(alive)))

    kept = _kept_pairs(first)
    if not reasons:
        dropped = first.select("seq").distinct().join(kept.select("seq"), "seq", "left_anti")
        return dropped if seen is None else dropped.unionByName(seen.select("seq"))

    holders = kept.select("k", F.col("seq").alias("holder"))
    matches = (
        with_salted_lookup(shared.select("k", "family", "seq"), holders, "k", "seq", how="inner")
        .where(F.col("holder") < F.col("seq"))
        .select("seq", "family")
    )
    if seen is not None:
        matches = matches.unionByName(seen)
    names = F.create_map(*[F.lit(x) for name, rank in _PRIORITY.items() for x in (rank, name)])
    return matches.groupBy("seq").agg(F.min("family").alias("family")).select(
        "seq", names[F.col("family")].alias("reason")
    )


def flag_duplicates(
    articles: DataFrame, seq: str = "seq", *, normalized: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """DD-2, DD-5: every article with ``is_duplicate`` and ``duplicate_reason``."""
    found = find_duplicates(articles, seq, normalized=normalized, known=known)
    found = found.select(F.col("seq").alias(seq), F.col("reason").alias("duplicate_reason"))
    return articles.join(found, seq, "left").withColumn(
        "is_duplicate", F.col("duplicate_reason").isNotNull()
    )


def drop_duplicates(
    articles: DataFrame, seq: str = "seq", *, normalized: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """DD-1, DD-3: the articles kept."""
    found = find_duplicates(articles, seq, normalized=normalized, known=known)
    return articles.join(found.select(F.col("seq").alias(seq)), seq, "left_anti")
