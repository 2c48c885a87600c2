"""Even shards, whole groups."""

import random
import zlib
from collections import Counter

from newsgrist.llm.sharding import assign_shards, propagate


def check(docs, rows, shards=8):
    got = assign_shards(docs(rows), shards).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts.get(s, 0)))
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}
    return got


def spread(got):
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, Counter())[r.shard] += 1
    return by


def test_small_groups_stay_whole(docs):
    rnd = random.Random(1)
    rows, i = [], 0
    for g in range(120):
        for _ in range(rnd.choice([1, 1, 1, 2, 3, 5])):
            rows.append((i, f"text {g}"))
            i += 1
    by = spread(check(docs, rows))
    linked = [c for c in by.values() if sum(c.values()) > 1]
    assert sum(len(c) > 1 for c in linked) <= 0.05 * len(linked)


def test_a_group_of_a_third(docs):
    rows = [(i, "hot") for i in range(400)] + [(400 + i, f"t{i // 2}") for i in range(500)] + [(2000 + i, f"s{i}") for i in range(300)]
    by = spread(check(docs, rows))
    hot = by[zlib.crc32(b"hot")]
    # 1200 rows, 150 a shard: the hot group needs three shards at least.
    assert len(hot) <= 4
    assert sum(len(c) > 1 for c in by.values()) <= 8


def test_everything_linked(docs):
    check(docs, [(i, f"t{i % 5}") for i in range(103)])
    check(docs, [(i, "one") for i in range(50)])


def test_odd_rows(docs):
    got = check(docs, [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "é" * 50_000), (3, "dup"), (3, "dup")])
    assert len(got) == 7
    check(docs, [(1, "a")])
    assert assign_shards(docs([])).count() == 0


def test_other_counts_of_shards(docs):
    for shards in (1, 2, 5):
        check(docs, [(i, f"t{i // 3}") for i in range(40)], shards)


def test_rounds_do_not_lose_rows_or_break_quotas(spark):
    rnd = random.Random(4)
    cells = [(bytes([g]), s, rnd.randint(1, 9)) for g in range(40) for s in range(4) if rnd.random() < 0.8]
    total = sum(n for _, _, n in cells)
    capacity = [max(sum(n for _, s, n in cells if s == k), total // 4) + 5 for k in range(4)]
    out = propagate(spark.createDataFrame(cells, "link binary, shard int, n bigint"), capacity, 5).collect()
    loads, sizes = Counter(), Counter()
    for r in out:
        loads[r.shard] += r.n
        sizes[bytes(r.link)] += r.n
    goal = Counter()
    for g, _, n in cells:
        goal[g] += n
    assert sizes == goal and all(loads[k] <= capacity[k] for k in range(4))
    assert len(out) < 0.6 * len(cells)


def test_no_python_in_the_plan(docs):
    plan = assign_shards(docs([(1, "a"), (2, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
