"""BPE encoding by backtracking, decoding by an offset table.

A word is covered from the left with the longest token that fits (Aho-Corasick over the
vocabulary). Two neighbours may stand side by side only if merging their joined text by rank
would leave exactly these two; otherwise the last token gives way to its longest shorter
prefix. Merge rules are never replayed on a text, and a word costs time in proportion to its
length. Results are those of the ``tokenizers`` library for files of this kind: NFC, white
space to one space, lower case, a pattern split, byte symbols, word ends marked.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgrist.llm.common import small_batches

# A word end within the automaton's alphabet; byte symbols are 0 to 255.
_END = chr(256)
# Words that each of a task's two memories holds (the older one makes way when the newer is
# full), and the longest word they hold; longer words are just encoded.
MEMO_WORDS = 400_000
MEMO_CHARS = 40


def byte_symbols() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies: printable
    Latin-1 signs stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _class(points: Iterable[int]) -> str:
    """The inside of a character class of sorted code points."""
    spans: list[list[int]] = []
    for point in points:
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


# The letters and digits that Unicode 16.0 added to 15.1, first and last of each
# range, and the capitals that 16.0 and 17.0 added, with the distance to their small letters.
# The library splits by 16.0 and lowers by 17.0; this interpreter's tables may be older and
# the regex package's newer.
_LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_DIGITS_16 = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
_CAPITALS = {0x1C89: 1, 0xA7CB: 0x264 - 0xA7CB, 0xA7CC: 1, 0xA7CE: 1, 0xA7D2: 1, 0xA7D4: 1, 0xA7DA: 1, 0xA7DC: 0x19B - 0xA7DC}
_CAPITALS |= dict.fromkeys(range(0x10D50, 0x10D66), 0x20) | dict.fromkeys(range(0x16EA0, 0x16EB9), 0x1B)


@cache
def _known(kind: str) -> list[int]:
    """Letters or digits the library knows."""
    added = {p for first, last in (_LETTERS_16 if kind == "L" else _DIGITS_16) for p in range(first, last + 1)}
    return [p for p in range(0x110000) if p in added or unicodedata.category(chr(p)).startswith(kind)]


@cache
def _newer() -> re.Pattern:
    """Signs that the regex package counts as letters or digits and the library does not know."""
    known = {*_known("L"), *_known("N")}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if ord(c) not in known]
    return re.compile(f"[{_class(found)}]" if found else r"(?!)")


_CAPITAL = re.compile(f"[{_class(sorted(_CAPITALS))}]")


class BackTrackingBpe:
    """Encoder and decoder of one vocabulary file, given as its JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._check(spec)
        names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.size = max(names) + 1
        self._set_offsets(names)
        self._set_merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._split = split
        self._words = regex.compile(split, regex.V0)
        marks = sorted(self.special, key=len, reverse=True)
        self._specials = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _check(self, spec: dict) -> None:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        steps = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"]:
            raise ValueError(f"unsupported vocabulary file: {kinds}, {steps}")
        if not self.suffix or spec.get("decoder") is not None:
            raise ValueError("only vocabularies with word ends and no decoder are supported")

    def _set_offsets(self, names: dict[int, str]) -> None:
        """All tokens in one buffer, each after a space; ``starts`` tells where each begins."""
        texts = [(" " + names[i]).encode() if i in names else b"" for i in range(self.size)]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def _set_merges(self, merges: list[tuple[str, str]]) -> None:
        vocab, symbols = self.vocab, byte_symbols()
        self.pair_rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            token = vocab[a + b]
            if token in self.made or max(self.made.get(vocab[a], -1), self.made.get(vocab[b], -1)) >= rank:
                raise ValueError("merges must build each token once, from earlier ones")
            self.made[token], self.parts[token] = rank, (vocab[a], vocab[b])

        def in_alphabet(name: str) -> str:
            end = name.endswith(self.suffix) and name != self.suffix
            body = name[: -len(self.suffix)] if end else name
            return "".join(chr(symbols[c]) for c in body) + _END * end

        automaton = ahocorasick.Automaton()
        texts: dict[int, str] = {}
        for name, token in vocab.items():
            if token in self.parts or len(name.removesuffix(self.suffix) or name) == 1:
                texts[token] = in_alphabet(name)
                automaton.add_word(texts[token], (token, len(texts[token])))
        automaton.make_automaton()
        self.automaton = automaton
        ids = {text: token for token, text in texts.items()}
        self.size_of = {token: len(text) for token, text in texts.items()}
        # The longest token that is a proper prefix of each token, or -1.
        self.shorter = {
            token: next((ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in ids), -1)
            for token, text in texts.items()
        }
        self._compatible: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined text of two tokens merges back into exactly these two.

        Along the border stand the last parts of ``left`` and the first parts of ``right``,
        each there from the rank that makes it until the rank that uses it. A merge across
        the border breaks the pair if its rank falls before both are used; of equal ranks
        the one further left goes first.
        """
        key = left * self.size + right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= MEMO_WORDS:
                self._compatible.clear()
            known = self._compatible[key] = self._fits(left, right)
        return known

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        out, used = [], 1 << 60
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out
            used, token = self.made[token], self.parts[token][side]

    def _fits(self, left: int, right: int) -> bool:
        for a, a_used in self._border(left, 1):
            for b, b_used in self._border(right, 0):
                rank = self.pair_rank.get((a, b))
                if rank is not None and rank < a_used and rank <= b_used:
                    return False
        return True

    def _longest(self, word: str) -> list[int]:
        """The longest token that starts at each place; -1 where none does."""
        best, size = [-1] * len(word), [0] * len(word)
        for end, (token, n) in self.automaton.iter(word):
            start = end - n + 1
            if n > size[start]:
                best[start], size[start] = token, n
        return best

    def _encode_symbols(self, word: str) -> list[int]:
        longest = self._longest(word)
        dead = bytearray(len(word) + 1)  # places from which no valid rest was found
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < len(word):
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + self.size_of[token]
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < len(word) else -1
            else:
                if not tokens:
                    raise ValueError("the vocabulary does not cover this word")
                dead[at] = 1
                token = tokens.pop()
                at -= self.size_of[token]
                token = self.shorter[token]
        return tokens

    def word(self, word: str) -> bytes:
        """Ids of one word of the split, as little-endian 32-bit integers."""
        symbols = word.encode().decode("latin-1") + _END
        return np.array(self._encode_symbols(symbols), dtype="<u4").tobytes()

    def _remembered(self, word: str) -> bytes:
        ids = self._memo.get(word) or self._older.get(word) or self.word(word)
        if len(word) <= MEMO_CHARS:
            if len(self._memo) >= MEMO_WORDS:
                self._memo, self._older = {}, self._memo
            self._memo[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Lower case sign by sign: no final sigma.
            text = text.replace("Σ", "σ")
            if _CAPITAL.search(text):
                text = text.translate({p: p + far for p, far in _CAPITALS.items()})
        text = text.lower()
        pattern = self._words if text.isascii() or not _newer().search(text) else self._old_words
        get, words = self._memo.get, pattern.findall(text)
        return b"".join([get(w) or self._remembered(w) for w in words])

    @cached_property
    def _old_words(self) -> regex.Pattern:
        """The split with its letters and digits spelled out: slow, for texts with newer signs."""
        split = self._split
        for kind in ("L", "N"):
            split = split.replace(f"\\p{{{kind}}}", _class(_known(kind)))
        return regex.compile(split, regex.V0)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; null is empty. Texts of
        special tokens are these tokens."""
        if not text:
            return b""
        if self._specials is None or "<|" not in text and not self._specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids: tokens with a space between, copied from the offset table."""
        tokens = np.frombuffer(ids, dtype="<u4")
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[tokens] - (ends - lengths), lengths)
        return self.buffer[at].tobytes()[1:]


_LOADED: dict[int, BackTrackingBpe] = {}


def _loaded(shared) -> BackTrackingBpe:
    """The vocabulary, built once in each Python worker."""
    if shared.value[0] not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value[0]] = BackTrackingBpe(shared.value[1])
    return _LOADED[shared.value[0]]


def encode_documents(spark: SparkSession, documents: DataFrame, vocabulary: str, *, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` for every row.

    ``vocabulary`` is the JSON file's text, a few MB that every task gets. ``ids`` holds
    little-endian 32-bit integers; ``with_ids=False`` leaves it out. Null and empty texts
    have no tokens and decode to the empty text; repeated rows and null ids pass through.
    """
    shared = spark.sparkContext.broadcast((hash(vocabulary), vocabulary))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared)
        for batch in small_batches(batches, "text"):
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]),
            }
            if not with_ids:
                del columns["ids"]
            yield pa.record_batch(list(columns.values()), list(columns))

    schema = f"doc_id bigint, n_tokens bigint, {'ids binary, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encoded, schema)


def decode_documents(spark: SparkSession, encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    shared = spark.sparkContext.broadcast((hash(vocabulary), vocabulary))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared)
        for batch in small_batches(batches, "ids"):
            texts = [bpe.decode(i or b"").decode() for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(decoded, "doc_id bigint, text string")
