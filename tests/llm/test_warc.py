"""Archives written, damaged and read back."""

import hashlib
import gzip
import random

import pytest
from pyspark.sql import functions as F

from newsgrist.functions.lineage import scratch_path
from newsgrist.llm.warc import (
    archive_damage, archive_index, chunked, page_records, payload_of, read_records, reassemble, records_of, unchunked, write_archives,
)

SCHEMA = "page_id bigint, url string, html string, digest string, salt int"


def read_back(spark, rows, segment=1000):
    path = scratch_path(spark, "warc")
    write_archives(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), path, segment=segment)
    return read_records(spark, path)


def expected(rows):
    digests = [hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows]
    out, taken = [], set()
    first = {}
    for (page, _, h), d in zip(rows, digests):
        if len((h or "").encode()) >= 100 and page is not None:
            first[d] = min(page, first.get(d, page))
    for (page, _, h), d in sorted(zip(rows, digests), key=lambda x: (x[0][0] is None, x[0][0])):
        size = len((h or "").encode())
        if size < 100:
            out.append((page, size, d, "response", None))
        elif d not in taken:
            taken.add(d)
            out.append((page, size, d, "response", None))
        else:
            out.append((page, size, d, "revisit", first.get(d)))
    return sorted(out, key=str)


def test_round_trip(spark):
    crlf = "line\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 400
    rows = [
        (3, "http://a/x", "é" * 60), (1, "http://a/y", "é" * 60), (2, "http://b", "é" * 60), (4, None, None), (5, "u v\r\nw", ""),
        (6, "http://c", "short"), (7, "http://d", "short"), (8, "http://e", crlf), (9, "http://f", crlf), (10, "g", "x" * 99),
        (11, "g", "x" * 99), (12, "g", "x" * 100), (13, "g", "x" * 100), (14, "big", "0123456789" * 40_000),
    ]
    records = read_back(spark, rows)
    got = archive_index(records).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)
    parts = records.groupBy("origin").count().where("origin is not null").collect()
    assert max(r["count"] for r in parts) > 300
    payloads = {r.page_id: bytes(r.payload).decode() for r in reassemble(records).collect()}
    assert payloads[8] == crlf and payloads[14] == rows[-1][2] and payloads[4] == ""


def test_repeated_rows_and_null_ids(spark):
    page = "p" * 500
    rows = [(2, "u", page), (2, "u", page), (1, "u", page), (1, "u", page), (None, "u", page), (3, "u", "q"), (3, "u", "q"), (None, "n", "z" * 300), (None, "n", "z" * 300)]
    got = archive_index(read_back(spark, rows, segment=200)).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)


def test_empty_table(spark):
    assert archive_index(read_back(spark, [])).count() == 0


def test_damaged_records(spark):
    records = read_back(spark, [(1, "a", "x" * 5000), (2, "b", "y" * 5000), (3, "c", "z" * 5000), (4, "d", "w" * 5000)])
    ids = {r.page_id: r.record_id for r in records.where("page_id is not null").collect()}
    damaged = records.where(~((F.col("origin") == ids[1]) & (F.col("number") == 3)))
    damaged = damaged.withColumn("total", F.when(F.col("origin") == ids[2], F.col("total") + 1).otherwise(F.col("total")))
    damaged = damaged.where(F.col("record_id") != ids[3])
    # doubled segments are told from whole ones
    damaged = damaged.unionByName(records.where((F.col("origin") == ids[4]) & (F.col("number") == 2)))
    got = {r.page_id: r.payload for r in reassemble(damaged).collect()}
    assert got == {1: None, 2: None, 4: None}


def test_order_of_records_is_no_matter(spark):
    records = read_back(spark, [(i, "u", f"{i}" * 4000) for i in range(20)])
    mixed = records.orderBy(F.rand(3)).repartition(7)
    got = {r.page_id: bytes(r.payload).decode() for r in reassemble(mixed).collect()}
    assert got == {i: f"{i}" * 4000 for i in range(20)}


@pytest.mark.parametrize("payload", [b"", b"a", b"\r\n", b"0\r\n\r\n" * 9, bytes(range(256)) * 100])
def test_framing(payload):
    assert unchunked(chunked(payload, 7)) == payload
    assert unchunked(chunked(payload, 7) + b"Trailer: x\r\n\r\n") == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nabc", b"x\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"-3\r\nabc\r\n0\r\n\r\n",
                                  b"1_0\r\n" + b"x" * 16 + b"\r\n0\r\n\r\n", b"+1\r\nx\r\n0\r\n\r\n", b"f" * 17 + b"\r\nx"])
def test_broken_framing(body):
    assert unchunked(body) is None


def test_messages():
    assert payload_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    assert payload_of(b"no end of headers") is None


def test_files_with_a_member_for_each_record_and_cut_files():
    records = list(page_records(1, "u", b"x" * 5000, "d", 1, None, True, 2000))
    plain = b"".join(r + b"\r\n\r\n" for r in records)
    members = b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)
    assert list(records_of(plain)) == list(records_of(members)) and len(records) > 2
    assert len(list(records_of(plain[:-100]))) == len(records) - 1


HEAD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\n"


@pytest.mark.parametrize("bad", [
    b"\r\nbody", b"Content-Length: \r\n\r\n", b"Content-Length: -5\r\n\r\nabcde", b"Content-Length: 1_0\r\n\r\n0123456789",
    b"Content-Length: ten\r\n\r\n", b"Content-Length: 99999999999999999999\r\n\r\n", b"Content-Length: 4000\r\n\r\nshort", b"",
])
def test_a_bad_record_does_not_hide_the_next(bad):
    good = list(page_records(1, "u", b"x" * 50, "d", 1, None, True))[0] + b"\r\n\r\n"
    left_out = []
    found = list(records_of(good + HEAD + bad + b"\r\n\r\n" + good, left_out))
    assert [f["x-page-id"] for f, _ in found] == ["1", "1"] and left_out == [1]


def test_any_bytes_are_read(spark, tmp_path):
    """Flipped, cut and doubled bytes: no crash, and what is given back is a record written."""
    rnd = random.Random(7)
    pages = [(i, bytes(rnd.choice(b"abc \r\n") for _ in range(rnd.randrange(3000)))) for i in range(12)]
    records = [r + b"\r\n\r\n" for i, t in pages for r in page_records(i, "u", t, hashlib.sha256(t).hexdigest(), 1, None, True, 700)]
    whole = {"one": gzip.compress(b"".join(records)), "many": b"".join(map(gzip.compress, records)), "plain": b"".join(records)}
    damage, n = 0, 0
    for name, archive in whole.items():
        assert len(list(records_of(archive))) == len(records)
        for k in range(60):
            data = bytearray(archive)
            for _ in range(rnd.randrange(1, 4)):
                at = rnd.randrange(len(data))
                kind = rnd.randrange(3)
                if kind == 0:
                    data[at] ^= 1 << rnd.randrange(8)
                elif kind == 1:
                    del data[at : at + rnd.randrange(1, 300)]
                else:
                    data[at:at] = data[at : at + rnd.randrange(1, 300)]
            left_out = []
            got = len(list(records_of(bytes(data), left_out)))
            damage += left_out[0]
            if k < 8:
                (tmp_path / f"{name}{k}.warc.gz").write_bytes(data)
                n += 1
    assert damage > 0
    payloads = dict(pages)
    found = reassemble(read_records(spark, str(tmp_path))).where("payload is not null").collect()
    assert found and archive_damage(spark, str(tmp_path)).count() == n
    same = [bytes(r.payload) == payloads.get(r.page_id) for r in found]
    assert sum(same) > 0.9 * len(same)
