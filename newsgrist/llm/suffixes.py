"""Repeated passages by a distributed difference-cover suffix sort.

Every byte that a passage of ``length`` bytes covers which also starts elsewhere is removed.
The suffixes of the texts are sorted far enough to tell passages of that length apart; equal
passages are then neighbours.

* **Candidates.** Of the hashes of short strings in each passage the least marks its anchor:
  that string with as much around it as all passages have that hold it in the same third.
  Equal passages have equal anchors, so a passage whose anchor occurs once in the table occurs
  once. Only the others go into the sort; equal texts enter
  once, by their smallest id. This decides nothing but what is sorted.
* **Stretches.** A run of candidate passages with one anchor, as text, is a stretch. Of equal
  stretches two enter the sort, which then finds all their passages repeated, and the same
  holds for the others.
* **Blocks.** What is left of the texts is laid out in blocks of half a million bytes, each a
  string of its own: segments with a separator after each. A block's reduced string of names
  stays with the block, so only keys and names are shuffled.
* **Recursion.** The suffixes at places 1 and 2 modulo 3 are the sample. Their triples are
  sorted by sampled splitters and named; the string of names is sorted the same way. It ends
  where a triple spans ``length`` bytes: names that are still equal are then equal passages,
  and any order among them will do.
* **Merge.** Sample suffixes are dealt by rank, the remaining ones (first letter, rank of the
  next) by comparison with splitters from class 1, and each range is merged by itself.
* **Neighbours.** On the top level every suffix brings a 64-bit hash of its first ``length``
  bytes, with which neighbours are compared, also over the borders of ranges.

Arrays travel as binary columns, one row for each block and range, in numbers as narrow as
they allow. Written tables are deleted once the next one stands. The driver sees splitters (64
numbers a block), a total for each range, and the two ends of each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData, SparkSession, functions as F

from newsgrist.functions.lineage import scratch_path
from newsgrist.functions.skew import fits, with_salted_lookup
from newsgrist.llm.shingles import mix

U = np.uint64
# Names and ranks are below 2**42, so a triple fits two words.
_BITS, _HALF = U(42), U(21)
_LOW = U((1 << 21) - 1)
_NO_ID = (1 << 63) - 1
SAMPLES = 64
SIDES = 3
GROUP = 1 << 17
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FOUND_ROWS = 1_000_000


@dataclass(frozen=True)
class Limits:
    """``length`` of a passage in bytes; bytes of a block; suffixes of a range; into how many
    rounds a merge is cut on the top level, the second, ..., which bounds the disk it takes."""

    length: int = 400
    block: int = 1 << 19
    part: int = 1 << 19
    rounds: tuple[int, ...] = (4, 3, 2)

    @property
    def gram(self) -> int:
        return max(1, self.length // 4)


# ---- hashes and anchors -------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 21), base, dtype=U)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


def _sums(raw: np.ndarray) -> np.ndarray:
    """What ``string_hashes`` and ``_stretch_hashes`` are differences of."""
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * _powers(len(raw) + 1)[0][: len(raw)], out=total[1:])
    return total


def string_hashes(raw: np.ndarray, width: int, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes in a row."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    total = _sums(raw) if total is None else total
    return mix((total[width:] - total[:-width]) * _powers(len(raw) + 1)[1][:n])


def _stretch_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each ``start`` to its ``end``."""
    return mix((total[end] - total[start]) * _powers(len(total))[1][start])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(U).max, dtype=U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _runs(total: np.ndarray, starts: np.ndarray, least: np.ndarray, limits: Limits) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, stretch): runs of passages with one anchor, from their ``starts``
    and the places of their least hashes, and a hash of all that each run covers."""
    length, gram = limits.length, limits.gram
    widest = length - gram
    step = widest // SIDES + 1
    place = (least & _LOW).astype(np.int64)
    side = (place - starts) // step
    new = np.flatnonzero(_changes(place) | _changes(side))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1] if len(new) else starts[:0]
    at, before = place[new], side[new] * step
    found = _stretch_hashes(total, at - before, at - np.minimum(before + step - 1, widest) + length)
    own = _stretch_hashes(total, first, last + length)
    return found, first, last, mix(found ^ mix(own + (last - first).astype(U)))


def _text_runs(raw: np.ndarray, limits: Limits) -> Iterator[tuple[np.ndarray, ...]]:
    """``_runs`` of one text, about a million starts at a time."""
    length = limits.length
    for start in range(0, len(raw) - length + 1, 1 << 20):
        piece = raw[start : min(start + (1 << 20), len(raw) - length + 1) + length - 1]
        total = _sums(piece)
        # The place takes the low bits: ties go to the first, in equal passages alike.
        placed = (string_hashes(piece, limits.gram, total) & ~_LOW) | np.arange(len(piece) - limits.gram + 1, dtype=U)
        least = _window_minima(placed, length - limits.gram + 1)
        found, first, last, stretch = _runs(total, np.arange(len(least)), least, limits)
        yield found, first + start, last + start, stretch


def anchors(raw: np.ndarray, limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first, last): anchors of one text, and the first and last start of the passages
    each of them stands for; about a million starts at a time."""
    for *found, _ in _text_runs(raw, limits):
        yield tuple(found)


def _text_groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows in a row of at most ``GROUP`` bytes together; a longer text by itself."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + GROUP, "right")) - 1)
        yield start, end
        start = end


def _group_runs(raw: np.ndarray, edges: np.ndarray, limits: Limits) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor, first, last, stretch) for the texts between ``edges`` of ``raw``."""
    length = limits.length
    if len(edges) == 2:
        for found in _text_runs(raw, limits):
            yield np.zeros(len(found[0]), dtype=np.int64), *found
        return
    if len(raw) < length:
        return
    total = _sums(raw)
    placed = (string_hashes(raw, limits.gram, total) & ~_LOW) | np.arange(len(raw) - limits.gram + 1, dtype=U)
    least = _window_minima(placed, length - limits.gram + 1)
    # Passages within one text; their anchors lie in it too, so runs end with it.
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    long = np.diff(edges) >= length
    np.add.at(inside, edges[:-1][long], 1)
    np.add.at(inside, edges[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
    found, first, last, stretch = _runs(total, starts, least[starts], limits)
    text = np.searchsorted(edges, first, "right") - 1
    yield text, found, first - edges[text], last - edges[text], stretch


def group_anchors(raw: np.ndarray, edges: np.ndarray, limits: Limits) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, hash, first, last) for the texts between ``edges`` of ``raw``, as ``anchors``."""
    for *found, _ in _group_runs(raw, edges, limits):
        yield tuple(found)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the edges of its values in them."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8), edges


_RUN_SCHEMA = "batch bigint, n bigint, keys array<binary>, ids array<bigint>, data array<binary>"
_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _run_rows(limits: Limits) -> Callable:
    """Texts -> their runs, one row for many texts: of each run text, first start, width, anchor,
    stretch, and a hash of its place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, edges = _bytes_of(batch.column("text"))
            known = np.array([int.from_bytes(k[:8], "little") for k in batch.column("key").to_pylist()], dtype=U)
            parts, begin, size = [], 0, 0
            for start, end in _text_groups(edges):
                here = edges[start : end + 1]
                for text, found, first, last, stretch in _group_runs(raw[here[0] : here[-1]], here - here[0], limits):
                    text = text + start
                    parts.append((text, first, last - first, found, stretch, mix(known[text] + mix(first.astype(U)))))
                    size += len(text)
                    if size >= limits.part // 2:
                        yield _run_row(base + number, batch, begin, end, parts)
                        number, parts, begin, size = number + 1, [], start, 0
            if size:
                yield _run_row(base + number, batch, begin, len(edges) - 1, parts)
                number += 1

    return rows


def _run_row(number: int, batch: pa.RecordBatch, begin: int, end: int, parts: list[tuple]) -> pa.RecordBatch:
    text, *columns = (np.concatenate(x) for x in zip(*parts))
    keys, ids = (batch.column(c).slice(begin, end - begin) for c in ("key", "id"))
    return pa.record_batch(
        [pa.array([number], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([keys.to_pylist()], pa.list_(pa.binary())),
         pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([[_dump(x) for x in (text - begin, *columns)]], pa.list_(pa.binary()))],
        ["batch", "n", "keys", "ids", "data"],
    )


def _outer(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by key and place, and in it: where a new place begins, whether the place is the
    least or greatest of its key, and whether the key has several places."""
    order = _order(keys, places)
    key, place = keys[order], places[order]
    new = _changes(key)
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least, most = place[first], place[np.append(first[1:], len(key)) - 1] if len(first) else place[:0]
    return order, new | _changes(place), (place == least[group]) | (place == most[group]), (least != most)[group]


def _asked(data: list[bytes], parts: int) -> tuple:
    """What a row of runs asks: (order, whether a run asks, the number of its question, the
    questions by part, edges of the parts). Of equal stretches two places are enough."""
    anchor, stretch, place = (_load(x) for x in data[3:])
    order, new, outer, _ = _outer(stretch, place)
    asked = order[new & outer]
    part = anchor[asked] % U(parts)
    dealt = _order(part)
    number = np.empty(len(asked), dtype=np.int64)
    number[dealt] = np.arange(len(asked))
    edges = np.searchsorted(part[dealt], np.arange(parts + 1, dtype=U))
    return order, outer, number[np.cumsum(new & outer) - 1], [x[asked[dealt]] for x in (anchor, stretch, place)], edges


def _questions(parts: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *_, columns, edges = _asked(batch.column("data")[i].as_py(), parts)
                full = np.flatnonzero(np.diff(edges) > 0)
                out = list(zip(*(_dump_parts(x, edges) for x in columns)))
                numbers = [batch.column("batch")[i].as_py()] * len(full)
                yield pa.record_batch(
                    [pa.array(full, pa.int32()), pa.array(numbers, pa.int64()), pa.array([list(out[k]) for k in full], pa.list_(pa.binary()))],
                    ["part", "batch", "data"],
                )

    return rows


def _answers(table: pa.Table) -> pa.Table:
    """One part of the anchors -> for each run 0: its anchor has no other place, 1: it is to be
    sorted, 2: two equal stretches are."""
    rows = table.column("data").to_pylist()
    (anchor, lengths), (stretch, _), (place, _) = (_load_all([r[k] for r in rows]) for k in range(3))
    answer = np.zeros(len(anchor), dtype=U)
    order, _, outer, _ = _outer(stretch, place)
    answer[order] = np.where(outer, U(1), U(2))
    order, *_, shared = _outer(anchor, place)
    answer[order[~shared]] = 0
    return pa.table(
        {"part": table.column("part"), "batch": table.column("batch"),
         "data": pa.array([[x] for x in _dump_parts(answer, np.concatenate([[0], np.cumsum(lengths)]))], pa.list_(pa.binary()))}
    )


def _marked(parts: int, length: int) -> Callable:
    """A row of runs and its answers -> (key, id, spans, others): the runs of each text that are
    to be sorted, and those of which two equal ones are."""

    def marked(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["part", "data", "keys", "ids"]).to_pylist(), key=lambda r: r["part"])
        own, rows = rows[0], rows[1:]
        order, outer, number, *_ = _asked(own["data"], parts)
        told = np.concatenate([_load(r["data"][0]) for r in rows])
        answer = np.empty(len(order), dtype=U)
        answer[order] = np.where(outer, told[number], U(2))
        text, first, width = (_load(x).astype(np.int64) for x in own["data"][:3])
        texts = np.unique(text[answer > 0])
        columns = [pa.array([own["keys"][k] for k in texts], pa.binary()), pa.array([own["ids"][k] for k in texts], pa.int64())]
        last = first + width
        for kind, space in ((1, 1), (2, length)):
            here = np.flatnonzero(answer == kind)
            # Runs side by side are one; of the others only what they cover matters.
            apart = first[here][1:] > last[here][:-1] + space
            new = np.flatnonzero(np.concatenate([np.ones(min(len(here), 1), bool), (text[here][1:] != text[here][:-1]) | apart]))
            ends = here[np.append(new[1:], len(here)) - 1] if len(new) else here
            here = here[new]
            offsets = np.append(np.searchsorted(text[here], texts), len(here))
            runs = pa.StructArray.from_arrays([pa.array(first[here]), pa.array(last[ends])], fields=list(_RUN))
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs))
        return pa.table(columns, ["key", "id", "spans", "others"])

    return marked


# ---- blocks -------------------------------------------------------------------------------

_BLOCK_SCHEMA = "block bigint, n bigint, data binary, open binary, keys array<binary>, starts array<bigint>, places array<bigint>"


def _segments(spans: list[tuple[int, int]], limits: Limits) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, open): stretches of a text that passages cover which start in ``spans``;
    ``open`` marks those starts. Longer stretches than a block are cut, each start in one."""
    merged: list[list[int]] = []
    for first, last in sorted(spans):
        if merged and first < merged[-1][1] + limits.length:
            merged[-1][1] = max(merged[-1][1], last)
            merged[-1][2].append((first, last))
        else:
            merged.append([first, last, [(first, last)]])
    for start, end, inner in merged:
        marks = np.zeros(end - start + 1, dtype=bool)
        for first, last in inner:
            marks[first - start : last - start + 1] = True
        for at in range(0, len(marks), limits.block):
            here = marks[at : at + limits.block]
            yield start + at, start + at + len(here) + limits.length - 1, here


def _block_rows(limits: Limits) -> Callable:
    """Texts with the starts of their candidate passages -> blocks, filled in turn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        parts: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        keys, starts, places, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            data = np.concatenate(parts)
            return pa.record_batch(
                [pa.array([base + number], pa.int64()), pa.array([size], pa.int64()), pa.array([data.tobytes()], pa.binary()),
                 pa.array([np.packbits(np.concatenate(marks)).tobytes()], pa.binary()), pa.array([keys], pa.list_(pa.binary())),
                 pa.array([starts], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.int64()))],
                ["block", "n", "data", "open", "keys", "starts", "places"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("text")[i].as_py(), dtype=np.uint8)
                spans = [(s["first"], s["last"]) for s in batch.column("spans")[i].as_py()]
                for start, end, here in _segments(spans, limits):
                    # Bytes of UTF-8 are below 0xF8; 0 parts the segments.
                    parts.append(np.concatenate([raw[start:end] + np.uint8(1), np.zeros(1, np.uint8)]))
                    marks.append(np.concatenate([here, np.zeros(end - start + 1 - len(here), bool)]))
                    keys.append(batch.column("key")[i].as_py())
                    starts.append(start)
                    places.append(size)
                    size += end - start + 1
                    if size >= limits.block:
                        yield block()
                        number += 1
                        parts, marks, keys, starts, places, size = [], [], [], [], [], 0
        if size:
            yield block()

    return rows


# ---- arrays in columns --------------------------------------------------------------------

def _narrow(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The narrowest width that holds the numbers, and the numbers in it."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in ("u1", "u2", "u4", "u8") if top < 1 << (8 * int(k[1])))
    return kind.encode(), values.astype(kind)


def _dump(values: np.ndarray) -> bytes:
    kind, numbers = _narrow(values)
    return kind + numbers.tobytes()


def _load(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=data[:2].decode(), offset=2).astype(U)


def _dump_parts(values: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """``_dump`` of what lies between each two ``edges``, in one width."""
    kind, numbers = _narrow(values)
    return [kind + numbers[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _load_all(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the parts, and how many each has."""
    lengths = np.array([(len(x) - 2) // (x[1] - 48) for x in parts], dtype=np.int64)
    if len({x[:2] for x in parts}) == 1:
        whole = b"".join(x[2:] for x in parts)
        return np.frombuffer(whole, dtype=parts[0][:2].decode()).astype(U), lengths
    return np.concatenate([_load(x) for x in parts]), lengths


def _gaps(places: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Differences of neighbours; the first between two ``edges`` is a place."""
    out = np.diff(places, prepend=0)
    first = edges[:-1][edges[:-1] < edges[1:]]
    out[first] = places[first]
    return out


def _places_of(gaps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places again, from ``_gaps`` of parts of these lengths."""
    total = np.cumsum(gaps.astype(np.int64))
    ends = np.cumsum(lengths)
    before = np.concatenate([np.zeros(1, np.int64), total])[ends - lengths]
    return total - np.repeat(before, lengths)


def _sample_places(n: int) -> np.ndarray:
    return np.concatenate([np.arange(1, n, 3), np.arange(2, n, 3)])


def _reduced(names: np.ndarray, n: int) -> np.ndarray:
    """The string of names: class 1, an end, class 2, an end."""
    ones, end = len(range(1, n, 3)), np.zeros(1, dtype=U)
    return np.concatenate([names[:ones], end, names[ones:], end])


def _letters(data: bytes, level: int) -> np.ndarray:
    """The string of a block on its level; those of the first two come from the bytes."""
    if level >= 2:
        return _load(data)
    text = np.frombuffer(data, dtype=np.uint8).astype(U)
    if level == 0:
        return text
    at, padded = _sample_places(len(text)), np.concatenate([text, np.zeros(3, dtype=U)])
    return _reduced((padded[at] << U(16)) | (padded[at + 1] << U(8)) | padded[at + 2], len(text))


# ---- names of triples ---------------------------------------------------------------------

def _triples(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([text, np.zeros(3, dtype=U)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    return (a << _HALF) | (b >> _HALF), ((b & _LOW) << _BITS) | c


def _order(*fields: np.ndarray) -> np.ndarray:
    """A stable sorting order by ``fields``, the first before the others. As many bits as fit
    are sorted in one word with their place, which is much faster than an argsort."""
    n = len(fields[0])
    low = max(0, n - 1).bit_length()
    room, words, filled = 64 - low, [], 64
    for field in reversed(fields):
        width, done = int(field.max()).bit_length() if n else 0, 0
        while done < width:
            if filled >= room:
                words.append(np.zeros(n, dtype=U))
                filled = 0
            some = min(width - done, room - filled)
            words[-1] |= ((field >> U(done)) & U((1 << some) - 1)) << U(filled)
            filled, done = filled + some, done + some
    at, order = np.arange(n, dtype=U), np.arange(n)
    for k, word in enumerate(words):
        placed = ((word[order] if k else word) << U(low)) | at
        placed.sort()
        here = (placed & U((1 << low) - 1)).view(np.int64)
        order = order[here] if k else here
    return order


def _ordered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order, and where a new key begins in it."""
    order = _order(high >> _HALF, ((high & _LOW) << _HALF) | (low >> _BITS), low & U((1 << 42) - 1))
    return order, _changes(high[order]) | _changes(low[order])


def _own_keys(text: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> tuple:
    """Different triples of a block in order, their numbers, the key of every sample place,
    and the first key of each range."""
    high, low = _triples(text, _sample_places(len(text)))
    order, new = _ordered(high, low)
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    high, low = high[order][new], low[order][new]
    counts = np.bincount(inverse, minlength=len(high)).astype(U)
    left, right = (np.searchsorted(high, splitters[0], side) for side in ("left", "right"))
    edges = left.copy()
    for k in np.flatnonzero(left < right):
        edges[k] += np.searchsorted(low[left[k] : right[k]], splitters[1][k])
    return high, low, counts, inverse, np.concatenate([[0], edges, [len(high)]])


def _named(last: bool) -> Callable:
    """One range of keys -> their names; on the ``last`` level the ranks of their first."""

    def names(table: pa.Table) -> pa.Table:
        loaded = [_load_all(table.column(c).to_pylist()) for c in ("high", "low", "counts")]
        high, low, counts = (x for x, _ in loaded)
        order, new = _ordered(high, low)
        numbers = np.empty(len(order), dtype=U)
        if last:
            upto = np.cumsum(counts[order])
            numbers[order] = upto - counts[order] + U(1)
            total = int(upto[-1])
        else:
            numbers[order] = np.cumsum(new).astype(U)
            total = int(new.sum())
        edges = np.concatenate([[0], np.cumsum(loaded[0][1])])
        return pa.table(
            {"part": table.column("part"), "block": table.column("block"),
             "data": pa.array([[x] for x in _dump_parts(numbers, edges)], pa.list_(pa.binary())),
             "total": pa.array([total] * table.num_rows, pa.int64())}
        )

    return names


def _occurrences(inverse: np.ndarray) -> np.ndarray:
    """0, 1, ... for the first, second, ... place of a key."""
    order = _order(inverse.astype(U))
    run = inverse[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(run), 1), bool), run[1:] != run[:-1]]))
    out = np.empty(len(run), dtype=np.int64)
    out[order] = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
    return out.astype(U)


# ---- merging ------------------------------------------------------------------------------

def _classes(text: np.ndarray, ranks: np.ndarray) -> list[list[np.ndarray]]:
    """Of each class modulo 3: places, then what a comparison needs. 0: letter, next letter,
    the ranks after one and two letters. 1: rank, letter, rank after it. 2: rank, letter, next
    letter, the rank after both."""
    n = len(text)
    ones, twos = len(range(1, n, 3)), len(range(2, n, 3))
    end = np.zeros(2, dtype=U)
    first, second = ranks[:ones], ranks[ones + 1 : ones + 1 + twos]
    after1, after2 = np.concatenate([first, end]), np.concatenate([second, end])
    padded = np.concatenate([text, end, end])
    at = [np.arange(c, n, 3) for c in range(3)]
    zeros = len(at[0])
    return [
        [at[0], padded[at[0]], padded[at[0] + 1], after1[:zeros], after2[:zeros]],
        [at[1], first, padded[at[1]], after2[:ones]],
        [at[2], second, padded[at[2]], padded[at[2] + 1], after1[1 : 1 + twos]],
    ]


def _codes(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odd codes for values among the sorted ``known`` ones, even ones between; and which."""
    at = np.searchsorted(known, values)
    equal = known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)
    return (2 * at + equal).astype(U), equal


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    return np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]])


def _joined(codes: np.ndarray, equal: np.ndarray, then: np.ndarray) -> np.ndarray:
    return (codes << _BITS) | np.where(equal, then, U(0))


def _places(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many suffixes of ``other`` come before each of ``own``: by one or two letters and
    the rank after them. Both are in suffix order, so letters are sorted as they are."""
    mine, equal, theirs = own[0], None, other[0]
    for k in range(1, len(own)):
        new = _changes(theirs)
        code = (2 * np.cumsum(new) - 1).astype(U)
        own_code, equal = _codes(theirs[new], mine)
        theirs, mine = (code << _BITS) | other[k], _joined(own_code, equal, own[k])
    return np.searchsorted(theirs, mine)


def _merged(zero: list, one: list, two: list) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the class 0 suffixes, and of classes 1 and 2 together, in their common
    order."""
    order1, order2 = _order(one[0]), _order(two[0])
    own = _order(zero[0], zero[2])
    letter, after_letter, after1, after2 = (x[own] for x in zero)
    place = _places([letter, after1], [x[order1] for x in one[1:]])
    place = place + _places([letter, after_letter, after2], [x[order2] for x in two[1:]])
    # Sorted already but for suffixes that no comparison tells apart.
    again = np.argsort(place, kind="stable")
    own, place = own[again], place[again]
    first = np.empty(len(own), dtype=np.int64)
    first[own] = place + np.arange(len(own))
    total = len(order1) + len(order2)
    merged = _order(np.concatenate([one[0][order1], two[0][order2]]))
    sample = np.concatenate([order1, order2 + len(order1)])[merged]
    rest = np.empty(total, dtype=np.int64)
    rest[sample] = np.arange(total) + np.cumsum(np.bincount(place, minlength=total + 1))[:total]
    return first, rest


_WIDTHS = (5, 4, 5)


def _of_round(suffixes: list[np.ndarray], k: int, splitters: list[np.ndarray], parts: range) -> np.ndarray | None:
    """Which suffixes of class ``k`` fall into the ranges of this round; None for all."""

    def from_on(border: int) -> np.ndarray:
        rank, letter, after = (x[border] for x in splitters)
        if k:
            return suffixes[1] >= rank
        return (suffixes[1] > letter) | ((suffixes[1] == letter) & (suffixes[3] >= after))

    out = None
    if parts.start > 0:
        out = from_on(parts.start - 1)
    if parts.stop <= len(splitters[0]):
        below = ~from_on(parts.stop - 1)
        out = below if out is None else out & below
    return out


def _exchange_rows(level: int, splitters: list[np.ndarray], parts: range, limits: Limits) -> Callable:
    """Blocks with ranks of their sample -> (part, block, data), all suffixes by range. On the
    top level only those that may start a repeated passage, with its hash."""
    rank, letter, after = splitters
    known = np.unique(letter)
    borders = _joined(*_codes(known, letter), after)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_py()
                text = _letters(data, level)
                classes = _classes(text, _load(batch.column("ranks")[i].as_py()))
                if level == 0:
                    starts = np.unpackbits(np.frombuffer(batch.column("open")[i].as_py(), np.uint8), count=len(text)).astype(bool)
                    hashes = np.concatenate([string_hashes(np.frombuffer(data, np.uint8), limits.length), np.zeros(limits.length, U)])
                    classes = [[x[starts[c[0]]] for x in c] + [hashes[c[0][starts[c[0]]]]] for c in classes]
                dealt = []
                for k, c in enumerate(classes):
                    mine = _of_round(c, k, splitters, parts)
                    c = c if mine is None else [x[mine] for x in c]
                    if k:
                        part = np.searchsorted(rank, c[1], "right")
                    else:
                        part = np.searchsorted(borders, _joined(*_codes(known, c[1]), c[3]), "right")
                    order = _order(part.astype(U))
                    edges = np.searchsorted(part[order], np.arange(parts.start, parts.stop + 1))
                    dealt.append((order, edges, c))
                columns = []
                for order, edges, c in dealt:
                    order, edges = order[edges[0] : edges[-1]], edges - edges[0]
                    places = _gaps(c[0][order], edges)
                    columns += [_dump_parts(x, edges) for x in (places, *(v[order] for v in c[1:]))]
                full = [k for k in range(len(parts)) if any(edges[k] < edges[k + 1] for _, edges, _ in dealt)]
                numbers, out = [parts[k] for k in full], [[x[k] for x in columns] for k in full]
                block = batch.column("block")[i].as_py()
                yield pa.record_batch(
                    [pa.array(numbers, pa.int32()), pa.array([block] * len(numbers), pa.int64()), pa.array(out, pa.list_(pa.binary()))],
                    ["part", "block", "data"],
                )

    return rows


def _loaded_classes(table: pa.Table, extra: int) -> tuple[list, list]:
    """The arrays of each class over all blocks (places as gaps), and the lengths by block."""
    rows = table.column("data").to_pylist()
    classes, lengths, at = [], [], 0
    for width in _WIDTHS:
        loaded = [_load_all([row[at + m] for row in rows]) for m in range(width + extra)]
        classes.append([x for x, _ in loaded])
        lengths.append(loaded[0][1])
        at += width + extra
    return classes, lengths


def _ranked(table: pa.Table) -> pa.Table:
    """One range of suffixes -> their ranks in it, in the order they came."""
    classes, lengths = _loaded_classes(table, 0)
    first, rest = _merged(*[c[1:] for c in classes])
    ones, columns = len(classes[1][0]), []
    for c, ranks, n in zip(classes, (first, rest[:ones], rest[ones:]), lengths):
        edges = np.concatenate([[0], np.cumsum(n)])
        columns += [_dump_parts(c[0], edges), _dump_parts(ranks + 1, edges)]
    data = [list(x) for x in zip(*columns)]
    total = len(first) + len(rest)
    return pa.table(
        {"part": table.column("part"), "block": table.column("block"), "data": pa.array(data, pa.list_(pa.binary())),
         "total": pa.array([total] * table.num_rows, pa.int64())}
    )


def _compared(table: pa.Table) -> pa.Table:
    """One range of the top level -> places whose passage equals a neighbour's, by block; and
    a row (block -1) with hash, block and place of the range's first and last suffix."""
    classes, lengths = _loaded_classes(table, 1)
    first, rest = _merged(*[c[1:-1] for c in classes])
    order = np.empty(len(first) + len(rest), dtype=np.int64)
    position = np.concatenate([first, rest])
    order[position] = np.arange(len(position))
    blocks = np.array(table.column("block").to_pylist(), dtype=np.int64)
    owner = np.concatenate([np.repeat(np.arange(len(blocks)), n) for n in lengths])
    place = np.concatenate([_places_of(c[0], n) for c, n in zip(classes, lengths)])
    hashes = np.concatenate([c[-1] for c in classes])[order]
    same = hashes[1:] == hashes[:-1]
    equal = np.zeros(len(order), bool)
    equal[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    part = table.column("part")[0].as_py()
    ends = [[int(hashes[k]), int(blocks[owner[order[k]]]), int(place[order[k]])] for k in (0, -1)]
    rows = [(part, -1, [_dump(np.array([x], dtype=U)) for end in ends for x in end])]
    at, own = place[equal], owner[equal]
    by_block = _order(own.astype(U))
    at, own = at[by_block], own[by_block]
    cuts = np.flatnonzero(_changes(own))
    for i, here in zip(own[cuts], np.split(at, cuts[1:])):
        rows.append((part, int(blocks[i]), [_dump(here)]))
    return pa.table(
        {"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()),
         "data": pa.array([r[2] for r in rows], pa.list_(pa.binary())), "total": pa.array([0] * len(rows), pa.int64())}
    )


# ---- the jobs -----------------------------------------------------------------------------

_REPLIES = "part int, block bigint, data array<binary>, total bigint"
_STATE = "block bigint, n bigint, data binary, open binary, ranks binary, samples array<binary>"


def _state_row(block: int, data: bytes, opened: bytes | None, ranks: np.ndarray, level: int) -> pa.Table:
    """A block with the ranks of its sample, and some of class 1 to split by."""
    text = _letters(data, level)
    one = _classes(text, ranks)[1]
    some = slice(0, None, max(1, len(one[0]) // SAMPLES))
    return pa.table(
        {"block": pa.array([block], pa.int64()), "n": pa.array([len(text)], pa.int64()), "data": pa.array([data], pa.binary()),
         "open": pa.array([opened], pa.binary()), "ranks": pa.array([_dump(ranks)], pa.binary()),
         "samples": pa.array([[_dump(x[some]) for x in one[1:]]], pa.list_(pa.binary()))}
    )


class SuffixSort:
    """The jobs of one sort: tables at rest in the shared folder, deleted when used up."""

    def __init__(self, spark: SparkSession, limits: Limits):
        self.spark, self.limits = spark, limits
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, *, blocks: bool = True) -> DataFrame:
        """``df`` as a table. Its shuffle files go with the job, not with the driver's next
        collection of garbage; rows that are ``blocks`` reach Python a few at a time."""
        path, conf = scratch_path(self.spark, "suffixes"), self.spark.conf
        settings = {_SHUFFLE_CLEANUP: "true"} | ({_BATCH_ROWS: "4"} if blocks else {})
        before = {k: conf.get(k, None) for k in settings}
        for k, v in settings.items():
            conf.set(k, v)
        try:
            # Few values are equal, so no dictionary of them is tried.
            df.write.option("parquet.enable.dictionary", "false").option("compression", "none").parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def forget(self, *tables: DataFrame) -> None:
        for table in tables:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _parts(self, suffixes: int) -> int:
        return max(1, -(-suffixes // self.limits.part))

    @staticmethod
    def _bases(replies: list[DataFrame]) -> np.ndarray:
        """What stands before each range: a number for each."""
        totals: dict[int, int] = {}
        for table in replies:
            totals |= {r.part: r.total for r in table.select("part", "total").distinct().collect()}
        counts = np.zeros(max(totals, default=-1) + 1, dtype=U)
        for part, total in totals.items():
            counts[part] = total
        if counts.sum() >= U(1) << _BITS:
            raise ValueError("more than 2**42 suffixes")
        return np.concatenate([[U(0)], np.cumsum(counts)[:-1]]) if len(counts) else counts

    def _with_replies(self, texts: DataFrame, replies: list[DataFrame]) -> GroupedData:
        """Each block's own row (part -1) together with what came back for it."""
        own = texts.select(F.lit(-1).alias("part"), "block", F.array("data", "open").alias("data"))
        for table in replies:
            own = own.unionByName(table.select("part", "block", "data"))
        return own.groupBy("block")

    def names(self, texts: DataFrame, level: int, last: bool) -> tuple[DataFrame, tuple]:
        """Triples of all samples, sorted and named, and the splitters that dealt them."""
        suffixes = texts.agg(F.sum("n").alias("n")).first().n * 2 // 3
        wanted = self._parts(suffixes) - 1

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    text = _letters(batch.column("data")[i].as_py(), level)
                    at = np.random.default_rng(batch.column("block")[i].as_py() & 0xFFFFFFFF).integers(0, len(text), SAMPLES)
                    high, low = _triples(text, np.unique(at))
                    yield pa.record_batch([pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], ["high", "low"])

        high = low = np.empty(0, dtype=U)
        if wanted:
            found = texts.select("block", "data").mapInArrow(some, "high bigint, low bigint").distinct().toPandas()
            high, low = found["high"].to_numpy().view(U), found["low"].to_numpy().view(U)
            order = np.lexsort((low, high))
            order = order[np.linspace(0, len(order), wanted + 2).astype(int)[1:-1]]
            high, low = high[order], low[order]
        splitters = (high, low)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    own = _own_keys(_letters(batch.column("data")[i].as_py(), level), splitters)
                    edges = own[4]
                    full = np.flatnonzero(np.diff(edges) > 0)
                    block = batch.column("block")[i].as_py()
                    cut = [[parts[p] for p in full] for parts in (_dump_parts(x, edges) for x in own[:3])]
                    yield pa.record_batch(
                        [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), *[pa.array(x, pa.binary()) for x in cut]],
                        ["part", "block", "high", "low", "counts"],
                    )

        keys = texts.select("block", "data").mapInArrow(emit, "part int, block bigint, high binary, low binary, counts binary")
        return self.write(keys.groupBy("part").applyInArrow(_named(last), _REPLIES)), splitters

    def name_blocks(self, texts: DataFrame, replies: DataFrame, splitters: tuple, level: int, last: bool) -> DataFrame:
        """The reduced string of every block; on the ``last`` level its state."""
        bases = self._bases([replies])

        def back(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("part").to_pylist(), table.column("data").to_pylist()), key=lambda r: r[0])
            (data, opened), rows = rows[0][1], rows[1:]
            text = _letters(data, level)
            inverse = _own_keys(text, splitters)[3]
            found = np.concatenate([np.empty(0, dtype=U), *[_load(d[0]) + bases[p] for p, d in rows]])[inverse]
            block = table.column("block")[0].as_py()
            if last:
                return _state_row(block, data, opened, _reduced(found + _occurrences(inverse), len(text)), level)
            reduced = _reduced(found, len(text))
            return pa.table(
                {"block": pa.array([block], pa.int64()), "n": pa.array([len(reduced)], pa.int64()),
                 "data": pa.array([_dump(reduced)], pa.binary()), "open": pa.array([None], pa.binary())}
            )

        schema = _STATE if last else "block bigint, n bigint, data binary, open binary"
        return self.write(self._with_replies(texts, [replies]).applyInArrow(back, schema))

    def rank_blocks(self, texts: DataFrame, replies: list[DataFrame], level: int) -> DataFrame:
        """The state of every block on ``level``, from the ranks of its reduced string."""
        bases = self._bases(replies)

        def back(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("part").to_pylist(), table.column("data").to_pylist()), key=lambda r: r[0])
            (data, opened), rows = rows[0][1], rows[1:]
            parts = np.array([r[0] for r in rows])
            at, ranks = [], []
            for c in range(3):
                gaps, lengths = _load_all([r[1][2 * c] for r in rows])
                at.append(_places_of(gaps, lengths))
                ranks.append(_load_all([r[1][2 * c + 1] for r in rows])[0] + np.repeat(bases[parts], lengths))
            whole = np.zeros(sum(map(len, at)), dtype=U)
            whole[np.concatenate(at)] = np.concatenate(ranks)
            return _state_row(table.column("block")[0].as_py(), data, opened, whole, level)

        return self.write(self._with_replies(texts, replies).applyInArrow(back, _STATE))

    def merge(self, state: DataFrame, level: int) -> list[DataFrame]:
        """All suffixes of ``level`` in order: ranks, or on the top level equal neighbours."""
        suffixes = state.agg(F.sum("n").alias("n")).first().n
        parts = self._parts(suffixes)
        samples = [r.samples for r in state.select("samples").collect()] if parts > 1 else []
        some = [np.concatenate([np.empty(0, dtype=U), *[_load(s[k]) for s in samples]]) for k in range(3)]
        order = np.argsort(some[0])
        order = order[np.linspace(0, len(order), parts + 1).astype(int)[1:-1]] if len(order) else order
        splitters = [x[order] for x in some]
        parts = len(order) + 1
        rounds = min(parts, self.limits.rounds[level] if level < len(self.limits.rounds) else 1)
        out = []
        for k in range(rounds):
            here = range(parts * k // rounds, parts * (k + 1) // rounds)
            dealt = state.select("block", "data", "open", "ranks").mapInArrow(
                _exchange_rows(level, splitters, here, self.limits), "part int, block bigint, data array<binary>"
            )
            out.append(self.write(dealt.groupBy("part").applyInArrow(_ranked if level else _compared, _REPLIES)))
        return out

    def order(self, texts: DataFrame, level: int = 0) -> list[DataFrame]:
        """Sorts the suffixes of ``texts``, strings of ``level``: sample, names, recursion,
        merge. A letter of this level spans 3**level bytes."""
        if level == 0:
            # Three bytes are a name by themselves, without a sort.
            ranked = self.order(texts, 1)
            state = self.rank_blocks(texts, ranked, 0)
            self.forget(*ranked)
        else:
            last = 3 ** (level + 1) >= self.limits.length
            named, splitters = self.names(texts, level, last)
            found = self.name_blocks(texts, named, splitters, level, last)
            self.forget(named)
            if last:
                state = found
            else:
                ranked = self.order(found, level + 1)
                state = self.rank_blocks(texts, ranked, level)
                self.forget(*ranked)
            if level > 1:
                self.forget(texts)
        out = self.merge(state, level)
        self.forget(state)
        return out


def _spans(limits: Limits) -> Callable:
    """A block and its repeated places -> (key, spans) in the texts."""

    def spans(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["places"] is not None)
        hits = [_load(x) for r in rows if r["places"] is None for x in r["data"]]
        at = np.sort(np.concatenate([np.empty(0, dtype=U), *hits])).astype(np.int64)
        at = at[_changes(at)]
        keys, found = [], []
        edges = np.searchsorted(at, [*own["places"], np.iinfo(np.int64).max])
        for k, (key, start, place) in enumerate(zip(own["keys"], own["starts"], own["places"])):
            here = at[edges[k] : edges[k + 1]] - place + start
            if len(here):
                new = np.flatnonzero(np.concatenate([[True], np.diff(here) > limits.length]))
                last = np.append(new[1:], len(here)) - 1
                keys.append(key)
                found.append([{"start": int(a), "end": int(b) + limits.length} for a, b in zip(here[new], here[last])])
        return pa.table(
            {"key": pa.array(keys, pa.binary()), "spans": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        )

    return spans


def repeated_spans(documents: DataFrame, limits: Limits) -> DataFrame:
    """(key, spans): for texts (known by the MD5 of their bytes) the stretches covered by
    passages that start more than once among the different texts."""
    spark = documents.sparkSession
    sort = SuffixSort(spark, limits)
    rows = documents.select("key", "id", "text")
    runs = sort.write(rows.mapInArrow(_run_rows(limits), _RUN_SCHEMA), blocks=False)
    parts = max(1, -(-(runs.agg(F.sum("n").alias("n")).first().n or 0) // limits.part))
    answer = "part int, batch bigint, data array<binary>"
    asked = runs.select("batch", "data").mapInArrow(_questions(parts), answer)
    told = sort.write(asked.groupBy("part").applyInArrow(_answers, answer))
    none = {c: F.lit(None).cast(k) for c, k in (("keys", "array<binary>"), ("ids", "array<bigint>"))}
    both = runs.select(F.lit(-1).alias("part"), "batch", "data", "keys", "ids").unionByName(told.withColumns(none))
    span = "array<struct<first: bigint, last: bigint>>"
    found = both.groupBy("batch").applyInArrow(_marked(parts, limits.length), f"key binary, id bigint, spans {span}, others {span}")
    # Equal texts have equal runs; a long text is in several rows.
    once = [F.flatten(F.collect_set(c)).alias(c) for c in ("spans", "others")]
    marked = sort.write(found.groupBy("key").agg(F.min("id").alias("id"), *once))
    sort.forget(runs, told)
    spans = marked.where(F.size("spans") > 0).select("key", "id", "spans")
    # Within the bounds texts stay where they are, or only those with candidates move.
    if fits(spans, FOUND_ROWS):
        rows = rows.join(F.broadcast(spans), ["key", "id"])
    elif fits(spans.select("key"), FOUND_ROWS):
        rows = rows.join(F.broadcast(spans.select("key")), "key", "left_semi").join(spans, ["key", "id"])
    else:
        rows = rows.join(spans, ["key", "id"])
    blocks = sort.write(rows.select("key", "text", "spans").mapInArrow(_block_rows(limits), _BLOCK_SCHEMA), blocks=False)
    schema = "key binary, spans array<struct<start: bigint, end: bigint>>"
    if blocks.select("block").isEmpty():
        return spark.createDataFrame([], schema)
    compared = sort.order(blocks.select("block", "n", "data", "open"))
    ends = sorted(
        (r.part, [int(_load(x)[0]) for x in r.data]) for t in compared for r in t.where("block = -1").select("part", "data").collect()
    )
    # Neighbours over the border of two ranges.
    over = [e for (_, a), (_, b) in zip(ends, ends[1:]) if a[3] == b[0] for e in (a[4:6], b[1:3])]
    extra = spark.createDataFrame([(b, [_dump(np.array([p], dtype=U))]) for b, p in over], "block bigint, data array<binary>")
    for table in compared:
        extra = extra.unionByName(table.where("block <> -1").select("block", "data"))
    none = {c: F.lit(None).cast(k) for c, k in (("keys", "array<binary>"), ("starts", "array<bigint>"), ("places", "array<bigint>"))}
    own = blocks.select("block", F.lit(None).cast("array<binary>").alias("data"), "keys", "starts", "places")
    out = own.unionByName(extra.withColumns(none)).groupBy("block").applyInArrow(_spans(limits), schema)
    whole = F.transform("others", lambda x: F.struct(x["first"].alias("start"), (x["last"] + limits.length).alias("end")))
    out = out.unionByName(marked.where(F.size("others") > 0).select("key", whole.alias("spans")))
    out = sort.write(out.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    sort.forget(marked, blocks, *compared)
    return out


def _kept(limits: Limits, keep_text: bool) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "removed": []}
            texts = []
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_py()
                spans = [(s["start"], s["end"]) for s in batch.column("spans")[i].as_py() or ()]
                if batch.column("copies")[i].as_py() and len(data) >= limits.length:
                    spans = [(0, len(data))]
                merged: list[list[int]] = []
                for start, end in sorted(spans):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                edges = [0, *[x for span in merged for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["removed"].append([{"start": a, "end": b} for a, b in merged])
                texts.append(kept if keep_text else None)
            yield pa.record_batch(
                [batch.column("doc_id"), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")],
                 pa.array(out["kept_sha256"], pa.string()),
                 pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"],
            )

    return rows


def remove_repeats(documents: DataFrame, limits: Limits = Limits(), *, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept`` for every row.

    Texts count as UTF-8 bytes, a null text as none. A byte goes if a passage of
    ``limits.length`` bytes covers it that also starts elsewhere: in another row, another place
    of the same text, or an overlapping one. Passages end with their text and are judged on
    the input. ``removed`` lists the runs taken out as (start, end), ``kept`` holds the bytes
    left (null without ``keep_text``); since a passage may begin or end inside a character,
    they need not be valid UTF-8. Rows with equal texts are copies of each other whatever
    their ids; a copied text of at least that length is removed whole. Every input row gives
    one row; an empty table gives none; other columns are ignored, whatever their names.
    """
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    own = F.col("doc_id").cast("bigint")
    rows = documents.select(own.alias("doc_id"), F.coalesce(own, F.lit(_NO_ID)).alias("id"), data.alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    spans = repeated_spans(rows.where(F.octet_length("text") >= limits.length), limits)
    copies = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copies"))
    sort = SuffixSort(documents.sparkSession, limits)
    found = sort.write(spans.join(copies, "key", "full"), blocks=False)
    if fits(found, FOUND_ROWS):
        joined = rows.join(F.broadcast(found), "key", "left")
    else:
        joined = with_salted_lookup(rows, found, "key", "id")
    return joined.select("doc_id", "text", "spans", "copies").mapInArrow(
        _kept(limits, keep_text),
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "removed array<struct<start: bigint, end: bigint>>, kept binary",
    )
