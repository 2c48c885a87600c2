"""The audit against applying the filters one after another to every document."""

import random
import re
from itertools import permutations

from newsgrist.llm.filteraudit import audit_filters

LETTERS = "ABCDE"


def failing(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        k for k, fails in zip(LETTERS, (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), copy,
        )) if fails
    )


def plain(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    parts = {}
    for i, t, lang in docs:
        parts.setdefault(lang or "", []).append((i, failing(t or "", i is not None and i > first[t or ""])))
    out = {}
    for part, rows in parts.items():
        shares = dict.fromkeys(LETTERS, 0)
        for order in map("".join, permutations(LETTERS)):
            left = rows
            for step, k in enumerate(order, 1):
                here = [r for r in left if k in r[1]]
                left = [r for r in left if k not in r[1]]
                shares[k] += len(here)
                out[part, order, step] = [
                    len(left), len(here), sum(k in r[1] for r in rows) - len(here), sum(r[1] == k for r in rows),
                    sum(r[0] in good for r in here), sum(r[0] in toxic for r in here),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shares[order[step - 1]])
    return out


def check(spark, docs, labels):
    table = spark.createDataFrame(
        [(i, t, lang, 1, "x") for i, t, lang in docs], "doc_id bigint, text string, lang string, failed int, `part` string"
    )
    marks = spark.createDataFrame([(*r, 3) for r in labels], "doc_id bigint, quality int, toxic int, n int")
    got = audit_filters(table, marks).collect()
    found = {
        (r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in got
    }
    assert len(found) == len(got) and found == plain(docs, labels)


def test_random_tables(spark):
    rnd = random.Random(8)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [long, long + " #", long.upper(), "a " * 150, "a " * 150 + "|", "Short", "", None, "SHORT $", long + "\x0b\x0cend"]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(200)]
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(80)]
    check(spark, docs, labels)


def test_borders(spark):
    words = [f"w{i}" for i in range(100)]
    eighty = words[:80] + ["w0"] * 20
    docs = [
        (1, " ".join(words), "en"), (2, " ".join(words[:99]), "en"), (3, " ".join(eighty), "en"),
        (4, " ".join([*eighty[:79], "w0", *eighty[80:]]), "en"), (5, "A" + "é" * 9, "en"), (6, "AA" + "é" * 9, "en"),
        (7, "\xa0".join(words), "en"), (8, "\t".join(words) + "\r\n ", "en"), (9, " ".join(words), "fr"),
        (9, " ".join(words), "fr"), (10, "x" * 500_000, "fr"), (11, " ".join(words * 3000), "fr"),
    ]
    check(spark, docs, [(1, 1, 0), (9, 1, 1), (9, 0, 0)])


def test_empty_tables(spark):
    check(spark, [], [])
    check(spark, [(1, None, None)], [])
