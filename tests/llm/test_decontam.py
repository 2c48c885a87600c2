"""Every window of every document in plain Python."""

import random
import re
from collections import Counter

import numpy as np

from newsgrist.llm.decontam import RADIUS, build_index, drop_leaking, find_leaks, simhash


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if 0 < len(words) < 5:
        return [tuple(words)]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def weighted(a, b):
    a, b = Counter(a), Counter(b)
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def expected(documents, items, threshold=0.8):
    out = {}
    for doc, text in documents:
        own = shingles(text)
        for item, passage in items:
            goal = shingles(passage)
            if not own or not goal:
                continue
            n = min(len(own), len(goal))
            best = max(weighted(own[s : s + n], goal) for s in range(len(own) - n + 1))
            if best >= threshold:
                out[doc, item] = best
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, text(rnd.randint(5, 60))) for i in range(25)]
    documents = []
    for d in range(120):
        body = text(rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 2)):
            _, passage = rnd.choice(items)
            passage = list(passage)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                at = rnd.randrange(len(passage))
                change = rnd.choice(["swap", "cut", "add"])
                if change == "swap":
                    passage[at] = "changed"
                elif change == "cut":
                    del passage[at]
                else:
                    passage.insert(at, "added")
            at = rnd.randint(0, len(body))
            body[at:at] = passage
        documents.append((d, ", ".join(body).title()))
    return documents, [(i, " ".join(t)) for i, t in items]


def test_all_windows(spark, docs):
    documents, items = corpus(7)
    goal = expected(documents, items)
    assert len(goal) > 40 and any(x < 1 for x in goal.values())
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(spark, docs(documents), benchmark).collect()}
    assert got.keys() == goal.keys()
    assert all(abs(got[k] - goal[k]) < 1e-9 for k in goal)
    clean = {r.doc_id for r in drop_leaking(spark, docs(documents), benchmark).collect()}
    assert clean == {d for d, _ in documents} - {d for d, _ in goal}


def test_edge_cases(spark, docs):
    item = " ".join(f"k{i}" for i in range(20))
    benchmark = spark.createDataFrame(
        [(1, item), (1, item), (2, None), (None, "z y x w v u"), (3, ""), (4, "two words"), (5, "rep " * 30)],
        "item_id bigint, text string",
    )
    long = "filler " * 200_000 + item
    rows = [(1, None), (2, ""), (3, item.upper()), (3, item.upper()), (None, item), (4, "Two words!"), (5, "some two words here"), (6, "rep " * 400), (7, long), (8, "z y x w v u")]
    got = sorted((str(r.doc_id), r.item_id) for r in find_leaks(spark, docs(rows), benchmark).collect())
    assert got == [("3", 1), ("3", 1), ("4", 4), ("6", 5), ("7", 1), ("None", 1)]
    table = docs(rows)
    kept = drop_leaking(spark, table, benchmark)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 8]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert find_leaks(spark, docs([(1, "a b c d e f")]), none).count() == 0
    assert find_leaks(spark, docs([]), some).count() == 0
    assert drop_leaking(spark, docs([(1, "x")]), none).count() == 1


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = build_index([1], ["q w e r t z u i o p"])
    for bits in (0, 1, RADIUS - 1, RADIUS, RADIUS + 1, 120):
        flips = np.zeros(256, dtype=np.uint8)
        flips[rng.choice(256, bits, replace=False)] = 1
        other = index.prints[0] ^ np.packbits(flips)
        assert (0 in index.near(other)) == (bits <= RADIUS)


def test_fingerprints_of_similar_windows_are_near():
    rng = np.random.default_rng(2)
    for n in (10, 25, 55):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = a.copy()
            change = int(n - np.ceil(0.8 * 2 * n / 1.8))
            if change:
                b[rng.choice(n, change, replace=False)] = rng.integers(0, 1 << 63, change).astype(np.uint64)
            assert np.unpackbits(simhash(a) ^ simhash(b)).sum() <= RADIUS


def test_repeated_runs(spark, docs):
    """A long run of one word that became another word: few shingles differ, many times."""
    items, documents = [], []
    for n, (words, run) in enumerate([(250, 20), (400, 30), (180, 15)] * 3):
        body = [f"p{n}w{k}" for k in range(words - run)]
        at = len(body) * (n + 1) // 11
        items.append((n, " ".join(body[:at] + ["old"] * run + body[at:])))
        documents.append((n, " ".join(["before"] * 7 + body[:at] + ["new"] * run + body[at:] + ["after"] * 7)))
        documents.append((100 + n, " ".join(body[:at] + ["new"] * (3 * run) + body[at:])))
    goal = expected(documents, items)
    assert all((n, n) in goal for n in range(9)) and all(x < 0.9 for x in goal.values())
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(spark, docs(documents), benchmark).collect()}
    assert got.keys() == goal.keys() and all(abs(got[k] - goal[k]) < 1e-9 for k in goal)
