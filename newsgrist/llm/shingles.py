"""Word and shingle hashes of whole texts, a batch of texts at a time.

Words are the runs of letters and digits of the lower-case text. A shingle is ``WIDTH``
words in a row; a text with fewer words is one shingle, a text without words has none.
"""

from __future__ import annotations

import re

import numpy as np

from newsgrist.llm.common import STEP_BYTES

WIDTH = 5
U = np.uint64

_BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
# Signs outside ASCII that part words: Latin-1 signs, general punctuation, arrows to
# symbols, CJK punctuation, full-width signs.
_SIGNS = re.compile(
    "[\u0080-©«-´¶-¹»-¿×÷ -⁯"
    "₠-⃏←-⯿　-〄〈-〠︰-﹯＀-／]"
)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * STEP_BYTES)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, dtype=U)
            steps[0] = U(1)
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``: differences of one running polynomial."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _plain(text: str) -> str:
    lower = text.lower()
    return lower if lower.isascii() else _SIGNS.sub(" ", lower)


def _pieces(data: bytes) -> list[bytes]:
    """``data`` in pieces of about ``STEP_BYTES``, cut before ASCII signs, so between words."""
    out, at = [], 0
    while len(data) - at > 2 * STEP_BYTES:
        raw = np.frombuffer(data, dtype=np.uint8, count=STEP_BYTES, offset=at)
        gaps = np.flatnonzero(~_IS_WORD[raw])
        if not len(gaps) or gaps[-1] == 0:
            break  # a word of a megabyte: taken whole
        out.append(data[at : at + int(gaps[-1])])
        at += int(gaps[-1])
    out.append(data[at:])
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and ``first`` with len(texts) + 1 entries: the words
    of text i are first[i] to first[i + 1]."""
    parts = [_plain(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if len(parts) == 1 and len(parts[0]) > 2 * STEP_BYTES:
        hashes = np.concatenate([_hash_bytes(p)[0] for p in _pieces(parts[0])])
        return hashes, np.array([0, len(hashes)])
    hashes, starts = _hash_bytes(b"\n".join(parts))
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return hashes, np.searchsorted(starts, offsets)


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` words in a row."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, U(width), dtype=U)
    for k in range(width):
        out = out * _BASE + words[k : k + n]
    return mix(out)


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in reading order, and ``first`` as in ``word_hashes``."""
    words, first = word_hashes(texts)
    counts = np.diff(first)
    long = np.maximum(counts - WIDTH + 1, 0)
    sizes = np.where(counts >= WIDTH, long, np.minimum(counts, 1))
    out_first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out_first[1:])
    out = np.empty(out_first[-1], dtype=U)
    # position in the words of each shingle: start of its text plus its number there
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(out)) - out_first[owner] + first[owner]
    whole = counts[owner] >= WIDTH
    wide = combine(words, WIDTH)
    out[whole] = wide[at[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < WIDTH)):
        out[out_first[i]] = combine(words[first[i] : first[i + 1]], int(counts[i]))[0]
    return out, out_first
