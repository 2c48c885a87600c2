"""Content sort against grouping in plain Python."""

import hashlib
import random
import re

from newsgrist.llm.exactdedup import drop_exact_duplicates, exact_duplicates


def expected(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, plain):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, plain):
        known = [x for x in groups[t] if x is not None]
        out.append((i, min(known) if known else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


def check(docs, rows):
    got = exact_duplicates(docs(rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(expected(rows), key=key)
    for sha in {r.text_sha256 for r in got}:
        kept = [r for r in got if r.kept and r.text_sha256 == sha]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_white_space_nulls_and_ties(docs):
    check(docs, [
        (3, "a  b"), (1, "a\t\nb"), (2, "a b"), (9, "a b "), (5, None), (4, ""), (6, " "), (8, "\x0b\x0c "),
        (7, "a b"), (7, "a b"), (None, "a b"), (None, "only"), (10, "A b"), (11, "x" * 200_000),
        (12, "x" * 200_000), (13, "x" * 199_999 + "y"),
    ])


def test_a_group_goes_over_many_ranges(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rnd = random.Random(3)
        same_head = "h" * 60
        rows = [(i, rnd.choice(["hot", "hot", same_head + "a", same_head + "b", f"t{i % 50}"])) for i in range(900)]
        rows.append(rows[0])
        check(docs, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(docs):
    assert exact_duplicates(docs([])).count() == 0
    assert drop_exact_duplicates(docs([])).count() == 0


def test_dropping_keeps_rows_as_they_are(docs):
    table = docs([(2, "a  b"), (1, "a b"), (None, "c"), (None, "c"), (3, "c"), (4, None)])
    got = drop_exact_duplicates(table)
    assert got.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(1, "a b"), (3, "c")]
    assert got.count() == 3
