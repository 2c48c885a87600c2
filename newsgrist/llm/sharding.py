"""Shards of equal counts that keep linked documents together.

Documents with equal texts are linked. All start in shards dealt evenly by a hash; then, in
rounds, the members of each group are drawn to the shard that holds most of their
neighbours, as far as the quotas between shards allow: first the few groups that take up
much of a shard, then the others in what is left. Counts per (group, shard), not documents,
take part in the rounds, so a group of a third of all rows is at most as many rows as there
are shards. Documents without links fill the shards up, so counts never differ by more than
one. Columns only: no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import with_salted_lookup

LAW = "rows"
ROUNDS = 6
# Rows are ranked within so many buckets of a hash; each bucket is one window.
BUCKETS = 1024
# A group larger than this part of a shard is placed before all others.
LARGE = 16

_TIE = 0x5EED


def _bucket(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(_TIE), *columns), F.lit(BUCKETS)).cast("int")


def ranked(rows: DataFrame, by: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """``rows`` with their number from 0 within ``by``, without a window over a whole ``by``.

    Rows are numbered within (by, bucket); the counts of the buckets before are added.
    """
    parts = rows.withColumn("_bucket", bucket)
    counts = parts.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    if not by:  # at most BUCKETS rows
        before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = parts.withColumn("_number", F.row_number().over(within) - 1)
    return numbered.join(offsets, [*by, "_bucket"]).withColumn(
        name, (F.col("_before") + F.col("_number")).cast("bigint")
    ).drop("_bucket", "_before", "_number")


def _loads(cells: DataFrame, shards: int) -> list[int]:
    """Linked rows in each shard: as many numbers as shards reach the driver."""
    found = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may go from one shard to another: as many as want to come back the
    other way, and what is left of the room, in equal parts of what is asked for."""
    out = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}
    for b, free in enumerate(room):
        asked = {a: n - out[a, b] for (a, to), n in wanted.items() if to == b}
        total = sum(asked.values())
        left = min(free, total)
        for a, n in sorted(asked.items()):
            share = min(left, n, -(-free * n // total)) if total else 0
            out[a, b] += share
            left -= share
    return out


def propagate(cells: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Cells (``link, shard, n``: n members of a group in a shard) after label propagation.

    In each round every cell asks to join the shard that holds most of its group's members,
    leaving out shards that the group fills alone (ties: a hash of group and shard). Asking
    is granted up to the quota of the pair of shards, first where most of a group already
    is; the cell at the quota's edge moves in part. So no shard ever holds more than its
    capacity, if it did not at first. Rounds end early when nothing moves.
    """
    shards = len(capacity)
    pairs = [(a, b) for a in range(shards) for b in range(shards)]
    for turn in range(rounds):
        full = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in capacity]), F.col("shard") + 1)
        favour = F.struct(
            (F.col("n") < full).cast("int").alias("open"), "n",
            F.xxhash64("link", "shard", F.lit(turn)).alias("tie"), "shard",
        )
        # The neighbours' labels: a group's members per shard, joined back to each cell.
        best = cells.groupBy("link").agg(F.max(favour).alias("best"), F.sum("n").alias("size"))
        movers = cells.join(best, "link").where("best.open = 1 and best.shard <> shard and best.n >= n").select(
            "link", "shard", F.col("best.shard").alias("to"), "n",
            F.floor((1 - F.col("best.n") / F.col("size")) * (BUCKETS - 1)).cast("int").alias("rank"),
            _bucket("link").alias("part"),
        )
        movers = cut_lineage(movers)
        # Movers in order of falling share, in buckets: the sums of those before are added.
        per = movers.groupBy("shard", "to", "rank", "part").agg(F.sum("n").alias("sum"))
        flows = {(r.shard, r.to): r.n for r in per.groupBy("shard", "to").agg(F.sum("sum").alias("n")).collect()}
        room = [c - n for c, n in zip(capacity, _loads(cells, shards))]
        allowed = quotas(flows, room)
        if not any(allowed.values()):
            break
        ahead = Window.partitionBy("shard", "to").orderBy("rank", "part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.select("shard", "to", "rank", "part", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("before"))
        inside = Window.partitionBy("shard", "to", "rank", "part").orderBy("link").rowsBetween(Window.unboundedPreceding, -1)
        queued = movers.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        table = F.array(*[F.lit(allowed.get(p, 0)).cast("bigint") for p in pairs])
        quota = F.element_at(table, F.col("shard") * shards + F.col("to") + 1)
        moved = F.greatest(F.least(quota - F.col("before") - F.col("own"), F.col("n")), F.lit(0))
        admitted = queued.join(offsets, ["shard", "to", "rank", "part"]).withColumn("moved", moved).where("moved > 0")
        changes = admitted.select("link", F.inline(F.array(
            F.struct("shard", (-F.col("moved")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")),
        )))
        cells = cut_lineage(
            cells.select("link", "shard", "n").unionByName(changes).groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        )
    return cells


def _large_cells(spark: SparkSession, large: list, shards: int) -> DataFrame:
    """Large groups dealt row by row over the shards, as cells."""
    out, at = [], 0
    for group in large:
        for shard in range(shards):
            n = (at + group["size"] - shard + shards - 1) // shards - (at - shard + shards - 1) // shards
            if n:
                out.append((bytes(group.link), shard, n))
        at += group["size"]
    return spark.createDataFrame(out, "link binary, shard int, n bigint")


def _filled(rows: DataFrame, number: str, room: list[int]) -> DataFrame:
    """``rows`` with the shard whose part of all the room their number falls into."""
    ends = [sum(room[: s + 1]) for s in range(len(room))]
    target = F.lit(len(room) - 1)
    for s in range(len(room) - 2, -1, -1):
        target = F.when(F.col(number) < ends[s], s).otherwise(target)
    return rows.withColumn("shard", target)


def assign_shards(documents: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes plus 1, a null text having none; null and empty texts
    are equal texts. Law ``rows``: counts of shards differ by one at most, so ``grown_shard``
    is null. ``slot`` numbers a shard's rows from 0, by a hash bucket and ``doc_id``.
    Repeated rows and null ids take places of their own. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("link"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("link")]
    rows = cut_lineage(rows)
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = cut_lineage(rows.groupBy("link").agg(F.count("*").alias("size")))

    # Large groups first: no more than LARGE * shards of them can exist.
    large = sizes.where(F.col("size") * (LARGE * shards) > total).orderBy("link").collect()
    cells, room = _large_cells(documents.sparkSession, large, shards), capacity
    if large:
        cells = propagate(cells, capacity, rounds)
        room = [c - n for c, n in zip(capacity, _loads(cells, shards))]
    lone = F.col("size") == 1
    known = sizes.select("link", F.when(F.col("size") * (LARGE * shards) > total, 2).when(~lone, 1).otherwise(0).alias("kind"))
    rows = cut_lineage(with_salted_lookup(rows, known, "link", F.coalesce("doc_id", F.lit(-1)), how="inner"))

    # The rest is dealt evenly into what is left, in the order of a hash.
    dealt = _filled(ranked(rows.where("kind < 2"), [], order, _bucket("doc_id"), "place"), "place", room).where("kind = 1")
    start = cut_lineage(dealt.groupBy("link", "shard").agg(F.count("*").alias("n")))
    small_cells = propagate(start, room, rounds)
    room = [c - n for c, n in zip(room, _loads(small_cells, shards))]
    cells = cells.unionByName(small_cells)

    # A group's final counts as intervals of its members' numbers.
    upto = Window.partitionBy("link").orderBy("shard")
    spans = cells.withColumn("upto", F.sum("n").over(upto)).groupBy("link").agg(
        F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("spans")
    )
    linked = with_salted_lookup(rows.where("kind > 0"), spans, "link", F.coalesce("doc_id", F.lit(-1)), how="inner")
    members = ranked(cut_lineage(linked), ["link"], [F.col("doc_id").asc_nulls_first()], _bucket("doc_id"), "number")
    placed = members.withColumn("shard", F.filter("spans", lambda s: s["upto"] > F.col("number"))[0]["shard"])

    # Documents without links fill the shards up.
    singles = _filled(ranked(rows.where("kind = 0"), [], order, _bucket("doc_id"), "number"), "number", room)
    columns = ["doc_id", "size", "text_crc32", "link", "shard"]
    placed, singles = placed.select(columns), singles.select(columns)

    final = cut_lineage(placed.unionByName(singles))
    slots = ranked(final, ["shard"], order, _bucket("doc_id"), "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
