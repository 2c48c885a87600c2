"""Near-dedup against all pairs, and the signatures against exact similarities."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from newsgrist.llm.minhash import bags, drop_near_duplicates, features, near_duplicates, overlap, overlaps, signatures


def bag(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def weighted(a, b):
    shared = sum((a & b).values())
    every = sum(a.values()) + sum(b.values()) - shared
    return shared / every if every else 1.0


def classes(rows, threshold=0.8):
    found = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if weighted(found[i], found[j]) >= threshold:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def texts(seed, n_base, n_copies, edits):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n_base):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 120))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, n_copies)):
            copy = list(base)
            for _ in range(rnd.randint(0, edits)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy))
    rnd.shuffle(out)
    return list(enumerate(out))


def check(docs, rows):
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(docs(rows)).collect()}
    roots = classes(rows)
    for i, (doc, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i]]
        assert got[doc] == (min(members), len(members)), doc


def test_random_copies(docs):
    check(docs, texts(1, 30, 4, 3))


def test_one_large_group_of_near_copies(docs):
    # Pairs lie on both sides of the threshold, so most links do not touch a bucket's centre.
    check(docs, texts(2, 1, 90, 6) + [(1000 + i, t) for i, t in texts(3, 10, 1, 1)])


def test_edge_cases(docs):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "... !!"), (4, "one two"), (5, "One, two."), (6, "two one"), (7, "a " * 200),
        (8, "a " * 200 + "b"), (9, long), (10, long + " tail"), (11, "A a a a a"), (12, "x" * 100_000),
    ]
    check(docs, rows)


def test_repeated_rows_and_null_ids(docs):
    rows = [(5, "p q r s t u"), (5, "p q r s t u"), (None, "p q r s t u"), (None, "solo text of five words")]
    got = sorted(near_duplicates(docs(rows)).select("doc_id", "class_id", "class_size").collect(), key=str)
    assert sorted((r.doc_id is None, r.class_id, r.class_size) for r in got if r.class_size == 3) == [(False, 5, 3), (False, 5, 3), (True, 5, 3)]
    assert [r.class_id for r in got if r.class_size == 1] == [None]
    table = docs(rows)
    kept = drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None"]


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0
    assert drop_near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("counts", [(1, 1), (1, 3), (2, 5), (7, 4), (100, 60)])
def test_signatures_are_unbiased(counts):
    rng = np.random.default_rng(5)
    found, exact = [], []
    for _ in range(60):
        keys = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64))
        a, b = np.full(40, counts[0]), np.full(40, counts[1])
        b[rng.random(40) < 0.3] = counts[0]
        both = signatures(np.concatenate([keys, keys]), np.concatenate([a, b]), np.array([0, 40, 80]))
        found.append((both[0] == both[1]).mean())
        exact.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(found) - np.mean(exact)) < 0.025


def test_matrix_overlaps_equal_single_ones():
    sets = []
    shingles, counts, first = bags([t for _, t in texts(4, 4, 3, 2)] + ["a a a a a a a a a", "a a a a a a a"])
    for a, b in zip(first[:-1], first[1:]):
        sets.append(features(shingles[a:b], counts[a:b]))
    found = overlaps(sets[:4], sets[4:])
    for i in range(4):
        for j in range(4, len(sets)):
            assert found[i, j - 4] == pytest.approx(overlap(sets[i], sets[j]))
