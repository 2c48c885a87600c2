"""Orchard's search against all distances, codebooks and codes against plain loops."""

import hashlib
import math
import random

import numpy as np

from newsgrist.llm.orchard import compress_vectors, nearest, neighbour_lists

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, `group` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)


def plain(rows, parts, entries, rounds):
    """Everything by its definition, on Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not order:
        return [], []
    kept = [r for r in kept if len(r[1]) == len(order[0][1])]
    order = [r for r in order if len(r[1]) == len(order[0][1])]
    w = len(order[0][1]) // parts
    books = [[r[1][p * w : (p + 1) * w] for r in order[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                x = v[p * w : (p + 1) * w]
                groups.setdefault(best(x, books[p])[1], []).append(x)
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, label in kept:
        found = [best(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    totals = {}
    for r in out:
        totals[r[3]] = totals.get(r[3], 0) + r[2]
    return [(r[0], r[1], r[2], totals[r[3]]) for r in out], [x for b in books for e in b for x in e]


def check(spark, rows, parts=4, entries=8, rounds=2):
    got = compress_vectors(table(spark, rows), parts, entries, rounds).collect()
    want, numbers = plain(rows, parts, entries, rounds)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key) == sorted(want, key=key)
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_search_equals_all_distances():
    rng = np.random.default_rng(5)
    for entries, spread in ((1, 9), (2, 3), (17, 3), (64, 4), (64, 300), (200, 2)):
        book = rng.integers(-spread, spread, (entries, 3))  # small spreads: ties and equal entries
        queries = rng.integers(-spread - 2, spread + 2, (500, 3))
        chosen, far = nearest(queries, book, neighbour_lists(book))
        every = ((queries[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (chosen == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_codes(spark):
    rnd = random.Random(2)
    f = lambda: np.float32(rnd.uniform(-0.5, 0.5)).item()
    check(spark, [(i, [f() for _ in range(8)], rnd.choice([None, 1, 1, 2])) for i in rnd.sample(range(1000), 150)])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, None, 1), (6, [], 1), (7, [0.5, None, 0.0, 0.0], 1), (8, [nan, 0.0, 0.0, 0.0], 1), (9, [0.0, inf, 0.0, 0.0], 1),
        (1, [0.5, -0.25, 0.0, 1.0], 3), (1, [0.5, -0.25, 0.0, 1.0], 3), (1, [-0.5, 0.25, 0.0, 1.0], None),
        (None, [0.125, 0.0, 0.0, -1.0], None), (None, [0.125, 0.0, 0.0, -1.0], None), (12, [1.0] * 8, 3), (13, [1.0] * 3, 3),
    ]
    check(spark, rows, entries=3)
    check(spark, rows, entries=64)
    check(spark, rows[:5])
    check(spark, [])
    huge = compress_vectors(table(spark, [(1, [3e38, 0.0, 0.0, 0.0], 1), (2, [0.0] * 4, 1)]), 4, 1, 0).collect()
    assert {r.vec_id: r.error for r in huge} == {1: 0, 2: 1 << 52}
