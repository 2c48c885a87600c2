"""What each quality filter removes, in every order of filters.

A document's five verdicts are five bits. A part of the table is then 32 counts, and the
"removal game" v(S) = documents that fail a filter of S has 32 coalitions. Its Hart-Mas-Colell
potential follows from smaller coalitions,

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,    P(empty) = 0,

and filter i's Shapley value is P(all) - P(all without i). Multiplied by |S|! everything stays
an integer. What a filter does at a step of an order is a difference of two coalitions.

DataFrame functions only. Texts do not move: rows are shuffled as digests and bits, equal ones
counted first.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import with_salted_lookup

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_SPACE = "[\\x20\\x09-\\x0D]+"


def own_failures(text: Column) -> Column:
    """Bits of A to D for one text, A in bit 0: under 100 words; fewer than 80 different
    words in 100; over 10 capitals in 100 code points; one of the signs # $ % & * |."""
    words = F.array_remove(F.split(text, _SPACE), "")

    def judged(w: Column) -> Column:
        few = F.size(w) < 100
        repeated = 100 * F.size(F.array_distinct(w)) < 80 * F.size(w)
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
        loud = 100 * capitals > 10 * F.char_length(text).cast("bigint")
        signs = text.rlike("[#$%&*|]")
        return sum((x.cast("int") * (1 << i) for i, x in enumerate((few, repeated, loud, signs))), F.lit(0))

    return F.get(F.transform(F.array(words), judged), F.lit(0))


def verdicts(documents: DataFrame) -> DataFrame:
    """(doc_id, part, failed, n): how many rows of an id and part fail which filters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own_failures(text).alias("failed"),
    )
    # Read three times below, so texts are judged once.
    rows = cut_lineage(rows.groupBy("digest", "doc_id", "part", "failed").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    rows = with_salted_lookup(rows, first, "digest", F.coalesce("doc_id", F.lit(-1)))
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    return rows.select("doc_id", "part", "digest", (F.col("failed") + copy * 16).alias("failed"), "n")


def coalition_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each part, counts by the set of failed filters, as arrays
    of 32."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = with_salted_lookup(verdicts(documents), marks, "doc_id", "digest")

    def counts(weight: Column, name: str) -> Column:
        sums = [F.sum(F.when(F.col("failed") == m, weight).otherwise(F.lit(0).cast("bigint"))) for m in range(_ALL + 1)]
        return F.array(*sums).alias(name)

    n = F.col("n")
    return rows.groupBy("part").agg(
        counts(n, "n"), counts(n * F.coalesce("good", F.lit(0)), "good"), counts(n * F.coalesce("toxic", F.lit(0)), "toxic")
    )


def _removed(counts: str) -> Column:
    """v(S) for S = 0 to 31: documents that fail a filter of S."""
    masks = F.sequence(F.lit(0), F.lit(_ALL))
    zero = F.lit(0).cast("bigint")
    return F.transform(
        masks,
        lambda s: F.aggregate(
            masks, zero, lambda total, m: total + F.when(m.bitwiseAND(s) != 0, F.get(F.col(counts), m)).otherwise(zero)
        ),
    )


def _potentials(game: str) -> Column:
    """|S|! P(S) for S = 0 to 31, each from the coalitions with one filter less."""
    weights = F.array(*[F.lit(factorial(max(bin(s).count("1") - 1, 0))).cast("bigint") for s in range(_ALL + 1)])
    zero = F.lit(0).cast("bigint")

    def grown(known: Column, s: Column) -> Column:
        smaller = sum(
            (F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - (1 << i))).otherwise(zero) for i in range(len(FILTERS))),
            zero,
        )
        return F.concat(known, F.array(F.get(weights, s) * F.get(F.col(game), s) + smaller))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ALL)), F.array(zero), grown)


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step.

    ``part`` is the ``lang`` (null: empty string), ``filter_order`` a permutation of ABCDE,
    ``step`` 1 to 5. Counts within the part: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (its filter fails, removed earlier), ``unique_fails`` (only its filter
    fails), ``good_lost`` and ``toxic_lost`` (removed here, labelled quality 1, toxic 1) and
    ``shapley``, the filter's removals summed over all 120 orders.

    E is failed by a text that a row with a smaller ``doc_id`` has too, anywhere in the table;
    a null id is neither smaller nor larger. A null text counts as empty: it fails A only
    (and E). Repeated rows count each; of several labels of a document one with 1 is enough.
    An empty table gives no rows; other columns are ignored.
    """
    games = coalition_counts(documents, labels).select(
        "part", F.col("n").alias("counts"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"),
        *[_removed(c).alias(f"v_{c}") for c in ("n", "good", "toxic")],
    )
    games = games.withColumn("potential", _potentials("v_n"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = games.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )

    def bit(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring("filter_order", k, F.lit(1))) - 1)

    before = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda s, k: s + F.when(k < F.col("step"), bit(k)).otherwise(0)
    )
    steps = steps.withColumns({"own": bit(F.col("step")), "before": before})
    after = F.col("own") + F.col("before")

    def gained(game: str) -> Column:
        return F.get(F.col(game), after) - F.get(F.col(game), F.col("before"))

    removed, grand = gained("v_n"), F.lit(_ALL)
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get(F.col("v_n"), after)).alias("kept"), removed.alias("removed"),
        (F.get(F.col("v_n"), F.col("own")) - removed).alias("redundant"),
        F.get(F.col("counts"), F.col("own")).alias("unique_fails"),
        gained("v_good").alias("good_lost"), gained("v_toxic").alias("toxic_lost"),
        # 5! P(all) - 5! P(all without it); the array holds 4! P of the latter.
        (F.get(F.col("potential"), grand) - 5 * F.get(F.col("potential"), grand - F.col("own"))).alias("shapley"),
    )
