"""The suffix sort against every passage looked up in a dictionary."""

import hashlib
import random

import numpy as np

from newsgrist.llm.suffixes import Limits, SuffixSort, _order, _text_groups, anchors, group_anchors, remove_repeats

# Few letters, short blocks and ranges: several levels, many borders.
SMALL = Limits(length=12, block=60, part=40)


def plain(rows, length):
    starts = {}
    for k, (_, t) in enumerate(rows):
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            starts.setdefault(data[i : i + length], []).append((k, i))
    gone = [set() for _ in rows]
    for places in starts.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + length))
    out = []
    for (i, t), bytes_gone in zip(rows, gone):
        data = (t or "").encode()
        runs = [b for b in sorted(bytes_gone) if b - 1 not in bytes_gone]
        kept = bytes(x for b, x in enumerate(data) if b not in bytes_gone)
        out.append((i, len(data), len(bytes_gone), len(runs), hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(docs, rows, limits=SMALL):
    got = remove_repeats(docs(rows), limits).collect()
    key = lambda r: tuple(str(x) for x in r)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got]
    assert sorted(found, key=key) == sorted(plain(rows, limits.length), key=key)
    assert all(r.n_removed == sum(s.end - s.start for s in r.removed) and r.n_spans == len(r.removed) for r in got)


def test_equal_passages_have_equal_anchors():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 40):
        text = rng.integers(97, 97 + letters, 700).astype(np.uint8)
        text = np.concatenate([text, text[100:400], rng.integers(97, 99, 50).astype(np.uint8), text[300:420]])
        limits = Limits(length=24)
        by_start = {}
        for hashes, first, last in anchors(text, limits):
            for h, a, b in zip(hashes.tolist(), first.tolist(), last.tolist()):
                by_start.update(dict.fromkeys(range(a, b + 1), h))
        assert sorted(by_start) == list(range(len(text) - 23))
        known = {}
        for i, h in by_start.items():
            assert known.setdefault(text[i : i + 24].tobytes(), h) == h


def test_anchors_of_texts_side_by_side():
    rng = np.random.default_rng(2)
    limits = Limits(length=10)
    sizes = [0, 9, 10, 11, 0, 300, 5, 40, 0]
    raw = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    rows = lambda k, found: [(k, *x) for x in zip(*(a.tolist() for a in found))]
    want = [r for k in range(len(sizes)) for found in anchors(raw[edges[k] : edges[k + 1]], limits) for r in rows(k, found)]
    got = [tuple(x) for found in group_anchors(raw, edges, limits) for x in zip(*(a.tolist() for a in found))]
    assert got == want
    groups = list(_text_groups(np.array([0, 10, 1 << 20, 1 << 20, (1 << 20) + 1, 5 << 20, 5 << 20])))
    assert [g[0] for g in groups[1:]] == [g[1] for g in groups[:-1]] and groups[-1][1] == 6


def test_random_texts(docs):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abc") for _ in range(9)) for _ in range(12)]
    rows = []
    for i in range(60):
        t = "".join(rnd.choice([rnd.choice(words), rnd.choice("abcdefghäß€")]) for _ in range(rnd.randrange(0, 25)))
        rows.append((i, t))
    check(docs, rows)


def test_repeats_inside_and_overlapping(docs):
    check(docs, [(1, "a" * 40), (2, "xy" * 30), (3, "q" * 11), (4, "b" * 12), (5, "0123456789abXX0123456789ab")])


def test_odd_rows(docs):
    same = "the same text in several rows"
    check(docs, [
        (1, same), (2, same), (2, same), (None, same), (None, "and " + same + " here"), (5, None), (6, ""), (7, None),
        (8, "short one"), (8, "short one"), (9, "none like this\x00one"), (10, "0123456789\x00\x00\x0001234567890123456789\x00\x00\x00"),
    ])
    check(docs, [])
    check(docs, [(1, None)])
    check(docs, [(1, "only one text of some length without repeats")])


def test_real_length_and_long_text(docs):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    long = " ".join(word() for _ in range(60_000))
    passage = " ".join(word() for _ in range(80))
    rows = [(1, long), (2, long[1000:1399]), (3, long[5000:5400]), (4, "z" + long[7000:7900] + "z"),
            (5, passage + " x " + passage[:399]), (6, passage[:400]), (7, "y" * 399), (8, "w" * 401)]
    check(docs, rows, Limits(block=40_000, part=30_000))


def test_copies_of_a_passage_do_not_grow_the_sort(docs, monkeypatch):
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage, sizes, order = word(300), [], SuffixSort.order

    def counted(self, texts, level=0):
        if level == 0:
            sizes.append(texts.agg({"n": "sum"}).first()[0])
        return order(self, texts, level)

    monkeypatch.setattr(SuffixSort, "order", counted)
    for copies in (4, 40):
        check(docs, [(i, word(40) + passage + word(40)) for i in range(copies)])
    assert sizes[1] < 3 * sizes[0]


def test_order_of_several_words():
    rng = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (1000, 3), (1000, 1 << 42), (1000, (1 << 64) - 1)):
        fields = [rng.integers(0, top, n, dtype=np.uint64) // np.uint64(max(1, top // 9)) * np.uint64(max(1, top // 9)) for _ in range(3)]
        assert _order(*fields).tolist() == np.lexsort(fields[::-1]).tolist()
